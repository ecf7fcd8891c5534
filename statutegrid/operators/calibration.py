"""The low-confidence limit from what models said before: quantile sketches by model version, stored a run and merged over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P

#: Size of a sketch: a quantile is off by some 1.65 % of the ranks at most, with probability 0.99; a few kilobytes whatever the number of rows.
K, RANK_ERROR = 200, 0.0165


def confidence_sketches(rows: DataFrame, by: str = "model_version", confidence: str = "confidence", k: int = K) -> DataFrame:
    """(by, n, sketch) of a run: one KLL sketch a version, made by map-side partial sketches. Null and NaN confidences are left out; a version without others has no row."""
    value = F.col(confidence).cast("double")
    known = rows.where(value.isNotNull() & ~F.isnan(value))
    return known.groupBy(by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(value, k).alias("sketch"))


def merged(sketches: DataFrame, by: str = "model_version") -> DataFrame:
    """Stored sketches of any number of runs as one a version, merged on the map side first, so no task holds all runs."""
    return sketches.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def confidence_limits(sketches: DataFrame, share: float = 0.2, least: int = 100, by: str = "model_version") -> DataFrame:
    """(by, n, low_confidence): the confidence that `share` of a version's rows lie below; the fixed LOW_CONFIDENCE for versions of fewer than `least` rows."""
    if not 0 < share < 1:
        raise ValueError(f"share must lie between 0 and 1, not {share}")
    found = F.kll_sketch_get_quantile_double("sketch", F.lit(share))
    return merged(sketches, by).select(by, "n", F.when(F.col("n") >= least, found).otherwise(P.LOW_CONFIDENCE).alias("low_confidence"))


def with_limits(rows: DataFrame, limits: DataFrame, by: str = "model_version") -> DataFrame:
    """rows with low_confidence, which `review_reason` takes in place of LOW_CONFIDENCE; versions without a limit keep that. One row a model version is broadcast."""
    known = limits.select(F.col(by).alias("_by"), F.col("low_confidence").alias("_limit"))
    joined = rows.join(F.broadcast(known), F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.withColumn("low_confidence", F.coalesce("_limit", F.lit(P.LOW_CONFIDENCE))).drop("_by", "_limit")


def rank_of(limit: Column, values: Column) -> Column:
    """Share of values below limit, as an aggregate."""
    return F.count_if(values < limit) / F.count(values)
