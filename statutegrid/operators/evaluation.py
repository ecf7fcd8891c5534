"""Predictions held against annotations: F1 of counts, of spans by overlap, recall of sentences with and without an aim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P


def annotated_count(value: Column) -> Column:
    """An annotated count of any type as a whole number; null where it is missing, no number, negative or not whole."""
    number = value.cast("string").try_cast("double")
    return F.when((number >= 0) & (number == F.floor(number)) & (number < 2**31), number).cast("int")


def overlapping(spans: Column, others: Column) -> Column:
    """How many of spans (start, end) have a character in common with one of others."""
    return F.size(F.filter(spans, lambda s: F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))))


def _f1(right: Column, wrong: Column) -> Column:
    """2 right / (2 right + wrong), null of nothing."""
    return 2 * right / F.nullif(2 * right + wrong, F.lit(0))


def scores(rows: DataFrame, by: str = "model_version", cap: int = P.BUCKET_CAP) -> DataFrame:
    """(by, n, n_excluded, count_macro_f1, recall_aim0, recall_aim_ge1, span_precision, span_recall, span_f1_partial) of rows
    (by, count, spans, gold_count, gold_spans), spans being arrays of (start, end, ...).

    Rows without a valid annotated count are left out and counted apart. Counts above cap are one class; a class that neither side has, and a measure over
    nothing, is null and left out of the mean. A predicted span is right if it overlaps an annotated one, an annotated one is found if it overlaps a predicted one,
    so adjoining spans do not match. A null prediction is wrong for any count; null spans are none; a null `by` is a group. One aggregation with map-side sums,
    whatever the sizes of groups; spans are compared within a sentence only, of at most MAX_TOKENS tokens.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    plain = lambda c: F.coalesce(F.transform(c, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))), none)
    sides = rows.select(
        F.col(by).alias("_by"), annotated_count(F.col("gold_count")).alias("_gold"), F.col("count").cast("int").alias("_count"),
        plain(F.col("spans")).alias("_spans"), plain(F.col("gold_spans")).alias("_gold_spans"),
    )
    valid = F.col("_gold").isNotNull()
    gold, found = F.least("_gold", F.lit(cap)), F.when(F.col("_count").isNotNull(), F.least("_count", F.lit(cap))).otherwise(-1)
    own = lambda c: F.sum(F.when(valid, c).otherwise(0))
    summed = sides.groupBy("_by").agg(
        F.count_if(valid).alias("n"), F.count_if(~valid).alias("n_excluded"),
        *[F.count_if(valid & (gold == k) & (found == k)).alias(f"_r{k}") for k in range(cap + 1)],
        *[(F.count_if(valid & (gold == k) & (found != k)) + F.count_if(valid & (gold != k) & (found == k))).alias(f"_w{k}") for k in range(cap + 1)],
        F.count_if(F.col("_gold") == 0).alias("_none"), F.count_if((F.col("_gold") >= 1) & (found >= 1)).alias("_some_right"),
        own(overlapping(F.col("_spans"), F.col("_gold_spans"))).alias("_right"), own(F.size("_spans")).alias("_predicted"),
        own(overlapping(F.col("_gold_spans"), F.col("_spans"))).alias("_found"), own(F.size("_gold_spans")).alias("_annotated"),
    )
    classes = F.filter(F.array(*[_f1(F.col(f"_r{k}"), F.col(f"_w{k}")) for k in range(cap + 1)]), lambda x: x.isNotNull())
    mean = F.aggregate(classes, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(classes), F.lit(0))
    share = lambda part, all_: part / F.nullif(all_, F.lit(0))
    precision, recall = share(F.col("_right"), F.col("_predicted")), share(F.col("_found"), F.col("_annotated"))
    both = F.coalesce(precision, F.lit(0.0)) + F.coalesce(recall, F.lit(0.0))
    partial = F.when(F.col("_predicted") + F.col("_annotated") > 0, F.when(both > 0, 2 * F.coalesce(precision, F.lit(0.0)) * F.coalesce(recall, F.lit(0.0)) / both).otherwise(0.0))
    return summed.select(
        F.col("_by").alias(by), "n", "n_excluded", mean.alias("count_macro_f1"), share(F.col("_r0"), F.col("_none")).alias("recall_aim0"),
        share(F.col("_some_right"), F.col("n") - F.col("_none")).alias("recall_aim_ge1"), precision.alias("span_precision"), recall.alias("span_recall"), partial.alias("span_f1_partial"),
    )
