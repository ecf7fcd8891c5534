"""Spans and points of the same keys, as tables: which points lie inside which spans.

A plane sweep: starts and points of a key lie in one order, and one running value carries what was passed last, so the work is that of a sort. A key's positions are cut
into ranges, so that a long document is many windows; what a range hands to the one before it is its first point. All pairs come from an equi-join of ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statutegrid.functions.folders import working_folder

#: Positions a range.
RANGE = 1 << 16
#: Positions a bin of the join of all pairs: a span is copied once for each bin that it touches.
BIN = 1 << 10


def first_inside(spans: DataFrame, points: DataFrame, key: str, width: int = RANGE) -> DataFrame:
    """spans (key, start, end, others) with point: position and others of the row of points (key, position, others) that lies first in [start, end), null without one.

    Of points at one position the least row, in the order of its columns, counts. Rows with a null key, start or position meet nothing; spans stay as they are, empty and repeated ones too.
    Spans and points are each worked out once, however dear they are: what is read three times is a table of both, written to the shared folder.
    """
    row = lambda df: F.struct(*df.columns)
    others = [c for c in points.columns if c not in (key, "position")]
    place = F.struct(F.col("position").alias("_position"), (F.struct(*others) if others else F.lit(0)).alias("_rest"))
    known = points.where(F.col(key).isNotNull() & F.col("position").isNotNull())
    events = known.select(F.col(key).alias("_key"), F.col("position").alias("_at"), F.lit(None).cast(spans.select(row(spans).alias("r")).schema["r"].dataType).alias("_span"), place.alias("_point")).unionByName(
        spans.select(F.col(key).alias("_key"), F.col("start").alias("_at"), row(spans).alias("_span"), F.lit(None).cast(points.select(place.alias("p")).schema["p"].dataType).alias("_point"))
    )
    folder = working_folder(spans.sparkSession, "sweep")
    events.withColumn("_range", F.floor(F.col("_at") / width)).write.parquet(folder)
    events = spans.sparkSession.read.parquet(folder)
    # from the end to the start; points before the spans that begin with them, the least last
    down = Window.partitionBy("_key", "_range").orderBy(F.desc("_at"), F.col("_point").isNull().asc(), F.desc("_point"))
    swept = events.withColumn("_next", F.last("_point", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))).where("_span IS NOT NULL")
    # the first point of the nearest later range that has one
    firsts = events.where("_point IS NOT NULL").groupBy(F.col("_key").alias("_k"), F.col("_range").alias("_r")).agg(F.min("_point").alias("_first"))
    marks = firsts.select("_k", "_r", "_first").unionByName(swept.where("_next IS NULL").select(F.col("_key").alias("_k"), F.col("_range").alias("_r")).distinct().withColumn("_first", F.lit(None).cast(firsts.schema["_first"].dataType)))
    later = Window.partitionBy("_k").orderBy(F.desc("_r")).rangeBetween(Window.unboundedPreceding, -1)
    handed = marks.withColumn("_later", F.last("_first", ignorenulls=True).over(later)).where("_first IS NULL OR _later IS NOT NULL").groupBy("_k", "_r").agg(F.first("_later", ignorenulls=True).alias("_later"))
    found = swept.join(handed, (F.col("_key") == F.col("_k")) & (F.col("_range") == F.col("_r")), "left")
    next_ = F.coalesce("_next", "_later")
    inside = F.when(next_["_position"] < F.col("_span.end"), next_)
    fields = [inside["_position"].alias("position"), *[inside["_rest"][c].alias(c) for c in others]]
    return found.select("_span.*", F.when(inside.isNotNull(), F.struct(*fields)).alias("point"))


def all_inside(spans: DataFrame, points: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Every pair of a span (key, start, end, others) and a point (key, position, others) in [start, end): the columns of both, the key once.

    Both are dealt out by key and bin of positions; a pair meets in its point's bin alone. Null keys and places and empty spans meet nothing; repeated rows pair each by itself; other columns of
    the two must have different names.
    """
    bin_ = lambda c: F.floor(F.col(c) / width)
    last = F.floor((F.col("end") - 1) / width)
    touched = spans.where("start < end").withColumn("_bin", F.explode(F.sequence(bin_("start"), last)))
    placed = points.where("position IS NOT NULL").withColumn("_bin", bin_("position"))
    return touched.join(placed, [key, "_bin"]).where("position >= start AND position < end").drop("_bin")
