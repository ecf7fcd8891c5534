"""Queries and SQL of all training-data operators."""

from statutegrid.llm import chat, importance, line_crf, line_rules, merkle, minhash, mixing, pieces, pivot_index, secret_scan, sharding, surrogates, warc

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (chat, line_rules, pivot_index, pieces, line_crf, minhash, surrogates, warc, mixing, sharding, importance, merkle, secret_scan):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
