"""What the operators share: tables, words, the shared folder, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statutegrid.functions.spread import balanced

#: Words are runs of anything but these six ASCII blanks (space and U+0009 to U+000D).
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"

#: What a table may take, written out, to be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 64 << 20
#: Keys of more edges than this are hot, unless more than HOT_KEYS are: then the bound rises.
HOT_DEGREE, HOT_KEYS = 1_000, 100_000

_own_folder: dict[str, str] = {}
#: Scratch tables by open `scratch` block; the first list lives as long as the driver.
_written: list[list[tuple[SparkSession, str]]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return balanced(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one only on a single machine that names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own_folder:
        _own_folder["path"] = "file://" + tempfile.mkdtemp(prefix="statutegrid-")
    return _own_folder["path"]


def scratch_path(spark: SparkSession, label: str, outer: bool = False) -> str:
    """A new path under the shared folder; removed when the innermost `scratch` block (outer: the one around it) or the driver ends."""
    path = f"{shared_folder(spark)}/statutegrid/{label}-{uuid.uuid4().hex}"
    _written[-2 if outer and len(_written) > 1 else -1].append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_last() -> None:
    for spark, path in _written.pop():
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Scratch tables of operators called inside are removed at its end: results must be written by then, by `cut(df, label, outer=True)` or elsewhere."""
    _written.append([])
    try:
        yield
    finally:
        _remove_last()


@atexit.register
def _remove_all() -> None:
    while _written:
        try:
            _remove_last()
        except Exception:  # the session may be gone; the folder is scratch space
            continue


def cut(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label, outer)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its exact name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, or wanted with as many underscores as make it another name than those taken; case does not tell names apart."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows, written out, take no more than so many bytes; for tables that `cut` wrote."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def places(rows: DataFrame, within: list[str], order: list[Column], label: str) -> DataFrame:
    """rows with _place (long, from 0), how many rows of the same `within` columns come before a row in the order, and _of, how many there are; for tables that `cut` wrote.

    The order must begin with `within`, so that rows of one group lie in neighbouring ranges of it; no task holds a group. Rows are numbered inside their range, and what a range adds
    is a sum over the ranges before it: one row a range and group. Rows alike in the whole order may change places.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), f"{label}-ranges")
    range_ = F.shiftright("_at", 33)
    runs = numbered.groupBy(*within, range_.alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(*within)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_less", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("_of", F.sum("_rows").over(group))
    names = [F.col(c).alias(f"_in{n}") for n, c in enumerate(within)]
    runs = bounded(cut(runs.select(*names, "_range", "_first", "_less", "_of"), f"{label}-runs"))
    on = range_ == F.col("_range")
    for n, c in enumerate(within):
        on = on & F.col(c).eqNullSafe(F.col(f"_in{n}"))
    found = numbered.join(runs, on)
    return found.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_less")).alias("_place"), "_of")


def crc_table() -> list[int]:
    """CRC-32's table for bytes, from its polynomial, for SQL that has no such function."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def hot_limit(sizes: DataFrame, size: str, least: int, most: int) -> int:
    """The smallest of least, 4 least, 16 least and so on that no more than `most` rows exceed; for tables that `cut` wrote."""
    while sizes.where(F.col(size) > least).count() > most:
        least *= 4
    return least


def _with_least(edges: DataFrame, label: str) -> DataFrame:
    """edges (u, v) with m, the smallest v of their u.

    Hot keys are few, and their minima are broadcast, so their edges stay where they lie; the shuffle
    deals out the rest, of which no key has more than the bound. AQE would not split the hot ones: one side is an aggregate, not a shuffle.
    """
    low = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), f"{label}-least")
    limit = hot_limit(low, "degree", HOT_DEGREE, HOT_KEYS)
    hot = F.broadcast(low.where(F.col("degree") > limit).select("u", "m"))
    rest = low.where(F.col("degree") <= limit).select("u", "m")
    return edges.join(hot, "u").unionByName(edges.join(hot, "u", "left_anti").join(rest, "u"))


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long) by alternating large-star and small-star steps.

    Returns (id, component) for every id on an edge, component the smallest id reachable. Each step
    is a map-side combined minimum and a join that shuffles no hot key, so no group is gathered;
    only counts and a sum of hashes come to the driver. Loops (a = b) and nulls are ignored.
    """
    links = edges.where("a is not null and b is not null and a <> b")
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = _with_least(both, label).where("v > u")
        large = cut(nearest.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), f"{label}-large")
        # the edge to the least neighbour stays, the others' ends go over to it
        end = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        now = cut(_with_least(large, label).select(end.alias("u"), F.col("m").alias("v")).distinct(), label)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
