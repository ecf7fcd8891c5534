"""The corpus pipeline: documents through five operators, each stage over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statutegrid.llm import line_crf, minhash, mixing, pieces, surrogates
from statutegrid.llm.common import cut, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labelled ones among them, accepts.

    Texts that are null, empty or blank score the prior, so a corpus of mostly good documents keeps them; repeated rows fare alike;
    an empty table stays empty; columns of any name come through.
    """
    return line_crf.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Texts without words and rows without an id are nobody's copies and stay; rows that repeat an id stay or go together; an empty
    table stays empty; columns of any name come through.
    """
    return minhash.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates under the session's key, where it names none under one drawn for this run (`surrogates.run_key`); n_chars follows the text.

    Every row stays; null and empty texts stay as they are; equal entities get equal surrogates in all rows; an empty table stays empty.
    """
    return surrogates.private_documents(docs, surrogates.run_key(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one on a source's cut in part, with its own n_chars.

    A null source is a source of its own; texts without words weigh nothing and are not taken; repeated rows share out alike on every run; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces; decoding is checked on every one.

    Null and empty texts have no pieces; every row stays; an empty table stays empty.
    """
    return pieces.encode(docs, pieces.Pieces.unigram())


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("PII surrogates", private),
    ("mix to target weights", mixture),
    ("unigram pieces", encoded),
]

#: No SQL for a fitted classifier, hashing with a secret key or Viterbi paths; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input; a stage's own scratch tables go when it is written."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with scratch():
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{n}", outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
