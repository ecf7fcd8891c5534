"""Per-document summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTIONS = ("segment_type", "is_substantive", "needs_review", "review_reason", "aim_n_suggested")


def _text(value: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(value, "True").otherwise("False")
    return F.coalesce(value.cast("string"), F.lit("nan"))


def reason_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    split = rows.where("review_reason <> ''").select(key, F.explode(F.split("review_reason", ";")).alias("reason")).where("reason <> ''")
    return split.groupBy(key, "reason").agg(F.count("*").alias("n"))


def summary(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section_no, rank, section, key_text, value): document facts, then counts by section in a reviewer's order.

    One pass: each row becomes its section keys, and one that stands for the document; one aggregation with map-side combining counts them
    and keeps the first row's facts. Counts come largest first, ties by key; AIM counts by their text, over substantive rows alone.
    """
    kinds = dict(rows.dtypes)
    entry = lambda n, value: F.struct(F.lit(n).alias("section_no"), value.alias("key_text"))
    keys = F.concat(
        F.array(entry(0, F.lit("n_segments")), *[entry(n, _text(F.col(c), kinds[c])) for n, c in enumerate(SECTIONS, 1) if c not in ("review_reason", "aim_n_suggested")]),
        F.transform(F.filter(F.split("review_reason", ";"), lambda x: x != ""), lambda x: entry(4, x)),
        F.when(F.col("is_substantive"), F.array(entry(5, _text(F.col("aim_n_suggested"), "int")))).otherwise(F.array()),
    )
    first = F.struct("segment_order", F.col("case_id").cast("string").alias("case_id"), "source_base", "model_version")
    each = rows.select(key, first.alias("f"), F.explode(keys).alias("k")).select(key, "k.*", F.when(F.col("k.section_no") == 0, F.col("f")).alias("f"))
    counted = each.groupBy(key, "section_no", "key_text").agg(F.count("*").alias("n"), F.min("f").alias("f"))
    order = Window.partitionBy(key, "section_no").orderBy(F.when(F.col("section_no") == 5, F.lit(0)).otherwise(-F.col("n")), "key_text")
    ranked = counted.withColumn("rank", F.row_number().over(order))
    fact = lambda n, name, value: F.struct(F.lit(n).alias("rank"), F.lit(name).alias("key_text"), value.alias("value"))
    facts = F.array(
        fact(1, "case_id", F.col("f.case_id")), fact(2, "source_base", F.col("f.source_base")), fact(3, "model_version", F.col("f.model_version")),
        fact(4, "n_segments", F.col("n").cast("string")),
    )
    own = F.array(F.struct("rank", "key_text", F.col("n").cast("string").alias("value")))
    names = F.element_at(F.array(*[F.lit(s) for s in ("document", *SECTIONS)]), F.col("section_no") + 1)
    shown = ranked.select(key, "section_no", names.alias("section"), F.explode(F.when(F.col("section_no") == 0, facts).otherwise(own)).alias("x"))
    return shown.select(key, "section_no", "x.rank", "section", "x.key_text", "x.value")


def smoke_metrics(rows: DataFrame) -> DataFrame:
    """One row over a table: segments, of them substantive, substantive with an own candidate, list items and to be reviewed; and that share."""
    count = lambda c: F.count(F.when(c, 1))
    review, substantive = F.col("needs_review"), F.col("is_substantive")
    return rows.agg(
        F.count("*").alias("n_segments"), count(substantive).alias("n_substantive"), count(substantive & F.col("has_own_aim_candidate")).alias("n_with_candidate"),
        count(F.col("is_list_item")).alias("n_list_items"), count(review).alias("n_needs_review"), (count(review) / F.count("*")).alias("share_needs_review"),
    )
