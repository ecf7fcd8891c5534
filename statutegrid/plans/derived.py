"""Carriers for the queries: regulations derived from the supplied documents, by one rule for Spark and DuckDB.

The supplied prose has no articles, lists or formulas, so every line of a document becomes one of twelve kinds of line. All documents are carried over, in whatever language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.spread import balanced, by_document

#: {p}: place of the line from 1, moved on by the document's number. Read by both engines.
LINE = """CASE {p} % 12
  WHEN 1 THEN '## Capítulo ' || CAST(1 + doc_id % 9 AS STRING) || '. Reglas'
  WHEN 2 THEN 'Artículo ' || CAST({p} AS STRING) || '. ' || line
  WHEN 3 THEN regexp_replace(line, '[.]+$', '') || ':'
  WHEN 4 THEN '- a) ' || line
  WHEN 5 THEN '- b) ' || line
  WHEN 6 THEN '1) ' || line
  WHEN 7 THEN line
  WHEN 8 THEN 'CONSIDERANDO ' || line
  WHEN 9 THEN CASE WHEN lang = 'es' THEN 'Los miembros deberán aprobar ' ELSE 'Members shall approve ' END || line
  WHEN 10 THEN 'El Presidente'
  WHEN 11 THEN 'Las reglas: a) uno dos; b) tres cuatro.'
  ELSE '<!-- audit --> Section ' || CAST({p} AS STRING) || ' ' || line END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return balanced(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def regulations(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """doc_id, lang, source_base, text. whole: by document, for what looks at a document's events together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    docs = by_document(docs) if whole else balanced(docs)
    text = F.expr(f"array_join(transform(split(text, '\\n'), (line, i) -> {LINE.format(p='(i + 1 + doc_id)')}), '\\n')")
    return docs.select("doc_id", "lang", F.format_string("%d. Reglamento.md", "doc_id").alias("source_base"), text.alias("text"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, text, 21 tokens of three scores, offsets (the first token special), three ordinal scores, from the 64 numbers of a vector."""
    scores = "transform(sequence(0, 20), i -> transform(slice(embedding, 3 * i + 1, 3), x -> CAST(x AS DOUBLE)))"
    offsets = "transform(sequence(0, 20), i -> CASE WHEN i = 0 THEN named_struct('start', 0, 'end', 0) ELSE named_struct('start', 4 * (i - 1), 'end', 4 * i - 1) END)"
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.expr("substring(repeat('abc ', 20), 1, 79)").alias("text"), F.expr(scores).alias("logits"), F.expr(offsets).alias("offsets"),
        F.expr("transform(slice(embedding, 62, 3), x -> CAST(x AS DOUBLE))").alias("ordinals"),
    )


TRANSITIONS = [[0.1, 0.0, -1.0], [0.0, -0.2, 0.3], [0.05, 0.0, 0.2]]
