import inspect
import re

import pytest
from pyspark.sql import functions as F

from statutegrid.llm import importance, line_crf, merkle, minhash, mixing, pieces, secret_scan, sharding, surrogates

GIVEN = ("doc_id", "text", "lang", "source", "n_chars")
TINY = pieces.Pieces(["<unk>", "a", "b"] + [f"<0x{b:02X}>" for b in range(256)], [0.0, -1.0, -2.0] + [0.0] * 256, ["unknown", "normal", "normal"] + ["byte"] * 256)


def quality(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    return line_crf.accepted(docs, labels)


#: operator, what it may add or replace by its docstring
OPERATORS = {
    "mixed_documents": (mixing, mixing.mixed_documents, ()),
    "mix": (mixing, lambda d: mixing.mix(d, F.col("source"), F.col("n_chars"), F.col("doc_id")), ("source_size", "target", "taken")),
    "shard_by_bytes": (sharding, lambda d: sharding.shard_by_bytes(d, F.col("text"), F.col("doc_id"), F.col("n_chars"), 4), ("shard", "slot")),
    "deduplicated": (minhash, minhash.deduplicated, ()),
    "private_documents": (surrogates, lambda d: surrogates.private_documents(d, "k"), ()),
    "pseudonymised": (surrogates, lambda d: surrogates.pseudonymised(d, "k"), ("n_entities",)),
    "accepted": (line_crf, quality, ()),
    "drawn": (importance, lambda d: importance.drawn(d, d.select("text"), percent=100, min_words=1), ()),
    "manifest": (merkle, lambda d: merkle.manifest(d, F.col("doc_id"), F.col("source"), merkle.leaf(F.col("doc_id"), F.col("text"))), ("leaf", "subroot", "root", "path")),
    "scan": (secret_scan, secret_scan.scan, ("secrets",)),
    "without_secrets": (secret_scan, secret_scan.without_secrets, ()),
    "encode": (pieces, lambda d: pieces.encode(d, TINY), ("pieces", "n_pieces", "n_byte_pieces", "round_trip")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_named_like_any_helper_come_through(spark, name):
    module, operator, own = OPERATORS[name]
    words = set(re.findall(r"[\"'.](_?[a-z][a-z0-9_]*)[\"'\].]", inspect.getsource(module)))
    more = sorted((words | {"a.b", "with space", "row", "score", "kept"}) - {*GIVEN, *own})
    texts = ["8.8.8.8 is here, one two three four five", "8.8.8.8 is here, one two three four five", "a b c d e f g h", None]
    rows = [(i, t, "en", "s", 10, *[f"{c}-{i}" for c in more]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more))
    out = operator(docs)
    assert [c for c in out.columns if c not in own] == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in more)
