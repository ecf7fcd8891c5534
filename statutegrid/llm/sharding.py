"""Operator 10, sharding by histogram sort.

Rows are ordered by (hash of the group, hash of the row). Splitters that cut this order into shards of
near-equal bytes are found from histograms alone: each round counts the exact bytes and rows below the
candidate boundaries inside the brackets that still hold a target, on the executors, and brings at most
4096 counts (first round) or 256 a bracket (later ones) to the driver. A splitter is settled once the bytes
below it are within the tolerance of its target. Only then do rows move, once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statutegrid.llm.common import column, cut, table

SHARDS = 40
TOLERANCE = 0.002
ROWS_PER_BIN = 50_000
_SIGN = -(2**63)
#: Bits of a hash that lie right of the candidate boundaries, by round.
_SHIFTS = (52, 44, 36, 28, 20, 12, 4, 0)


@dataclass(frozen=True)
class Splitter:
    """First key of a shard: rows from (group, row) on, both unsigned 64-bit hashes."""

    group: int
    row: int


def _unsigned(x: int) -> int:
    return x % 2**64


def plan_splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    """Splitters for keyed (_group, _row: long hashes; _size: long). Fewer rows than shards give empty shards."""
    total, largest = keyed.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    near = max(total / shards * tolerance, 0.5)
    found: dict[int, Splitter] = {}
    #: (prefix of the group hash, prefix of the row hash) -> bytes below the bracket, targets in it
    brackets: dict[tuple[int, int], tuple[int, list[int]]] = {(0, 0): (0, list(range(1, shards)))}
    levels = [("_group", s) for s in _SHIFTS] + [("_row", s) for s in _SHIFTS]
    for n, (of, shift) in enumerate(levels):
        brackets = {k: v for k, v in brackets.items() if v[1]}
        if not brackets:
            break
        by_group = of == "_group"
        child = F.shiftrightunsigned(of, shift)
        if n == 0:
            rows = keyed.withColumn("_p", F.lit(0).cast("long"))
        else:
            before = levels[n - 1][1] if n != len(_SHIFTS) else 64
            if by_group:
                rows = keyed.withColumn("_p", F.shiftrightunsigned("_group", before))
                rows = rows.where(F.col("_p").isin([_signed(p) for p, _ in brackets]))
            else:
                group = F.col("_group").isin(sorted({_signed(g) for g, _ in brackets}))
                rows = keyed.where(group).withColumn("_p", F.shiftrightunsigned("_row", before) if before < 64 else F.lit(0).cast("long"))
                wanted = [f"(_group = {_signed(g)} and _p = {_signed(p)})" for g, p in brackets]
                rows = rows.where(" or ".join(wanted))
        keys = [F.lit(0).cast("long").alias("_g") if by_group else F.col("_group").alias("_g"), F.col("_p"), child.alias("_c")]
        counts = rows.groupBy(*keys).agg(
            F.sum("_size").alias("b"), F.count("*").alias("n"), F.min("_group").alias("g0"), F.max("_group").alias("g1")
        )
        children: dict[tuple[int, int], list[tuple[int, int, int, bool]]] = {}
        for r in counts.collect():
            key = (_unsigned(r["_p"]), 0) if by_group else (_unsigned(r["_g"]), _unsigned(r["_p"]))
            children.setdefault(key, []).append((_unsigned(r["_c"]), r["b"], r["n"], r["g0"] == r["g1"]))
        following: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for key, (base, targets) in brackets.items():
            low, todo = base, sorted(targets)
            for c, size, n_rows, one_group in sorted(children.get(key, [])):
                high = low + size
                inside = []
                while todo and total * todo[0] / shards <= high:
                    target = total * todo[0] / shards
                    # a group, or a row, that is no larger than the largest row stays whole: finer cuts can't come nearer than that
                    whole = n_rows == 1 or (one_group and size <= max(near, largest))
                    if min(target - low, high - target) <= near or whole:
                        start, end = (c << shift), ((c + 1) << shift)
                        at = start if target - low <= high - target else end
                        found[todo[0]] = Splitter(at, 0) if by_group else Splitter(key[0], at)
                    else:
                        inside.append(todo[0])
                    todo.pop(0)
                if inside:
                    following[(c, 0) if by_group else (key[0], c)] = (low, inside)
                low = high
            for j in todo:  # beyond all rows
                found[j] = Splitter(2**64, 0)
        brackets = {(k[0], 0): v for k, v in following.items()} if n == len(_SHIFTS) - 1 else following
    for key, (_, targets) in brackets.items():  # rows alike in both hashes can't be told apart: they stay together
        for j in targets:
            found[j] = Splitter(*key)
    return [found[j] for j in sorted(found)]


def _signed(x: int) -> int:
    x %= 2**64
    return x - 2**64 if x >= 2**63 else x


def shard_of(splitters: list[Splitter]) -> Column:
    """Number of splitters at or below the row's key, as a binary search inside one expression."""
    group, row = F.col("_group").bitwiseXOR(F.lit(_SIGN)), F.col("_row").bitwiseXOR(F.lit(_SIGN))

    def reaches(s: Splitter) -> Column:
        if s.group >= 2**64:
            return F.lit(False)
        g = F.lit(s.group + _SIGN)
        if s.row >= 2**64:
            return group > g
        return (group > g) | ((group == g) & (row >= F.lit(s.row + _SIGN)))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(reaches(splitters[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(splitters)).cast("int")


def bin_of(bits: int) -> Column:
    """One of 2 ** bits bins by a second hash of the key: a shard that is a narrow range of one group's rows fills all its bins alike."""
    return F.shiftrightunsigned(F.xxhash64("_row", "_group", F.lit("bin")), 64 - bits) if bits else F.lit(0).cast("long")


def shard_by_bytes(
    df: DataFrame,
    group: Column,
    row: Column,
    size: Column,
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    rows_per_bin: int = ROWS_PER_BIN,
    hashed: bool = False,
) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard); input columns of these names give way.

    Rows of equal group lie together unless the group is larger than both the tolerance and the largest row.
    hashed: group and row are 64-bit hashes already. Null groups and rows hash like any value; null sizes count as 0; repeated rows are kept, in adjacent slots.
    An empty table gives an empty result; other columns may have any names. Slots are numbered by bins of a second hash, so no task holds a shard.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    keyed = df.select(
        F.struct(*[column(c) for c in kept]).alias("row"), (group if hashed else F.xxhash64(group)).alias("_group"), (row if hashed else F.xxhash64(row, F.lit("row"))).alias("_row"),
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("_size"),
    )
    narrow = cut(keyed.select("_group", "_row", "_size"), "shard-keys")
    splitters = plan_splitters(narrow, shards, tolerance)
    rows = narrow.count()
    bits = math.ceil(math.log2(max(1.0, rows / (shards * rows_per_bin))))
    shard, bin_ = shard_of(splitters), bin_of(bits)
    counts = narrow.select(shard.alias("_s"), bin_.alias("_b")).groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    placed = keyed.select("row", "_group", "_row", shard.alias("_s"), bin_.alias("_b"))
    order = Window.partitionBy("_s", "_b").orderBy("_row", "_group")
    return (
        placed.withColumn("_k", F.row_number().over(order))
        .join(offsets, ["_s", "_b"])
        .select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("_s").alias("shard"), (F.col("_o") + F.col("_k") - 1).alias("slot"))
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Exchange once: one folder a shard, rows of a shard spread over tasks by slot."""
    placed.repartition("shard", F.floor(F.col("slot") / ROWS_PER_BIN)).write.partitionBy("shard").parquet(path)


def md5_bits(value: Column) -> Column:
    """The first 64 bits of a string's MD5, which any engine finds."""
    half = lambda at: F.conv(F.substring(F.md5(value.cast("binary")), at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes; equal texts are one group."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        md5_bits(text).alias("group_bits"),
        md5_bits(F.concat(F.lit("row:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("row_bits"),
    )
    placed = shard_by_bytes(docs, F.col("group_bits"), F.col("row_bits"), F.col("size"), hashed=True)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """CRC-32's table for bytes, from its polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


#: The splitters from cumulative bytes alone: for each target the first level whose nearest boundary is within the tolerance, or that
#: nothing finer can improve. Slots are those of a single bin, so it holds for tables of up to SHARDS * ROWS_PER_BIN rows.
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(text, '')), 1, 16))::UBIGINT AS g,
    ('0x' || substr(md5('row:' || coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT AS r FROM documents),
sized AS (SELECT doc_id, g, r, (octet_length(encode(text)) + 16)::BIGINT AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda crc, b: xor(crc >> 8, ({_crc_table()}::BIGINT[])[xor(crc, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM docs),
whole AS (SELECT sum(size)::BIGINT AS total, max(size) AS largest, greatest(sum(size)::DOUBLE / {SHARDS} * {TOLERANCE}, 0.5) AS near FROM sized),
targets AS (SELECT j, (total * j)::DOUBLE / {SHARDS} AS target, largest, near FROM whole, range(1, {SHARDS}) t(j)),
shifts AS (SELECT unnest({list(_SHIFTS)}) AS s),
by_group AS (SELECT s, (g >> s)::HUGEINT AS c, sum(size)::BIGINT AS b, count(*) AS n, min(g) = max(g) AS one FROM sized, shifts GROUP BY ALL),
group_ends AS (SELECT *, sum(b) OVER (PARTITION BY s ORDER BY c) AS high FROM by_group),
of_groups AS (SELECT j, s, target, largest, near, c, high - b AS low, high, n = 1 OR (one AND b <= greatest(near, largest)) AS rest
  FROM targets JOIN group_ends ON target > high - b AND target <= high),
inside AS (SELECT j, target, largest, near, c AS g, low AS base FROM of_groups WHERE s = 0),
by_row AS (SELECT j, s, target, largest, near, i.g, base, (r >> s)::HUGEINT AS c, sum(size)::BIGINT AS b, count(*) AS n FROM inside i JOIN sized d ON d.g = i.g, shifts GROUP BY ALL),
row_ends AS (SELECT *, base + sum(b) OVER (PARTITION BY j, s ORDER BY c) AS high FROM by_row),
levels AS (SELECT j, 0 AS part, s, target - low <= high - target AS first, least(target - low, high - target) <= near OR rest AS settled, c, NULL::HUGEINT AS g FROM of_groups
  UNION ALL SELECT j, 1, s, target - (high - b) <= high - target, least(target - (high - b), high - target) <= near OR n = 1 OR b <= greatest(near, largest), c, g
  FROM row_ends WHERE target > high - b AND target <= high),
bounds AS (SELECT *, (c + CASE WHEN first THEN 0 ELSE 1 END) * (1::HUGEINT << s) AS place FROM levels),
chosen AS (SELECT j, arg_min({{'part': part, 'g': g, 'place': CASE WHEN settled THEN place ELSE c END}}, part * 100 - s + CASE WHEN settled THEN 0 ELSE 1000 END) AS x FROM bounds WHERE settled OR (part = 1 AND s = 0) GROUP BY j),
splitters AS (SELECT j, CASE WHEN x.part = 0 THEN x.place ELSE x.g END AS sg, CASE WHEN x.part = 0 THEN 0 ELSE x.place END AS sr FROM chosen),
placed AS (SELECT d.doc_id, d.size, d.crc, d.g, d.r, (SELECT count(*) FROM splitters WHERE d.g > sg OR (d.g = sg AND d.r >= sr)) AS shard FROM sized d)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY CASE WHEN r >= 9223372036854775808 THEN r::HUGEINT - 18446744073709551616 ELSE r::HUGEINT END,
    CASE WHEN g >= 9223372036854775808 THEN g::HUGEINT - 18446744073709551616 ELSE g::HUGEINT END) - 1 AS slot, NULL::INT AS grown_shard FROM placed
"""

QUERIES = {"op10_histogram_shards": op10_histogram_shards}
ORACLES = {"op10_histogram_shards": SQL}
