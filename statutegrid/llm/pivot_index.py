"""Operator 3, near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors: about 4 sqrt(n), at most MAX_PIVOTS and PIVOT_BYTES, the rows of the smallest id hashes, without those
that nearly repeat another pivot; the mean of the drawn rows is taken off first, so a direction that all vectors share neither thins out
the pivots nor fills a few lists. A vector is described by its nearest pivots in order, as many as pairs at the threshold need: probes on
the drawn rows tell (`prefix_length`). An inverted list a pivot holds the
vectors that name it; two vectors become candidates if their prefixes share at least MIN_SHARED pivots, and are judged in the list of
the first one that they share. Tables of any size go this way; where prefixes of two shared pivots would be too long, one is enough. Lists are cut into blocks, so each task holds two bounded blocks and counts links by matrix products; what
leaves it are counts by vector and an edge from each linked vector to the smallest id of its part of the block.
Every vector is indexed; equal vectors are one, with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.ship import map_arrow, ship
from statutegrid.llm.blocks import block_labels, grouped, matrix, paired_blocks
from statutegrid.llm.common import bounded, components, cut, table

COSINE = 0.9
#: PREFIX is the shortest prefix; longer ones follow from the share of PROBES pairs at the threshold that must become candidates.
PREFIX, MIN_SHARED = 12, 2
PROBES, TARGET = 512, 0.995
#: Longest prefix, in roots of the number of pivots.
REACH = 2.5
BLOCK = 1024
MIN_PIVOTS, MAX_PIVOTS, PIVOT_GAP = 64, 65_536, 0.8
#: What pivots may take in the precision that vectors came in; twice as much is drawn.
PIVOT_BYTES = 64 << 20


def unit(vector: list | None) -> np.ndarray | None:
    """The vector in double precision at length 1; None if it links with nothing: null, empty, zero, or with null or non-finite components."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    largest = np.abs(v).max()
    if not np.isfinite(v).all() or largest == 0:
        return None
    v = v / largest
    return v / np.linalg.norm(v)


def choose_pivots(points: np.ndarray, wanted: int) -> np.ndarray:
    """At most `wanted` rows, none closer than PIVOT_GAP to one before it; a copy of one vector is no second reference point."""
    kept: list[int] = []
    for start in range(0, len(points), 256):
        part = points[start : start + 256]
        far = (part @ points[kept].T < PIVOT_GAP).all(1) if kept else np.ones(len(part), bool)
        own = part @ part.T
        mine: list[int] = []
        for i in np.flatnonzero(far):
            if not mine or (own[i, mine] < PIVOT_GAP).all():
                mine.append(int(i))
        kept += [start + i for i in mine]
        if len(kept) >= wanted:
            break
    return points[kept[:wanted]]


def prefixes(units: np.ndarray, pivots: np.ndarray, length: int = PREFIX) -> np.ndarray:
    """Ordered nearest pivots of each row; ties go to the pivot of the lower number."""
    near = -(units @ pivots.T)
    length = min(length, len(pivots))
    if length < len(pivots):
        part = np.sort(np.argpartition(near, length - 1, axis=1)[:, :length], axis=1)
    else:
        part = np.tile(np.arange(len(pivots)), (len(units), 1))
    order = np.argsort(np.take_along_axis(near, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1).astype(np.int32)


def centred(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Directions as seen from the centre; rows at the centre have none and go."""
    v = units - centre
    length = np.linalg.norm(v, axis=1, keepdims=True)
    far = length[:, 0] > 1e-6
    return v[far] / length[far]


def prefix_length(units: np.ndarray, centre: np.ndarray, pivots: np.ndarray, cosine: float, shared: int, least: int) -> tuple[int, int]:
    """Shortest prefix, `least` at least, with which TARGET of the probes share `shared` pivots, and that number; where no prefix of REACH * sqrt(pivots) is enough, one shared pivot must do.

    A probe is a row and what lies at the threshold from it, in the direction of the row before it: pairs as hard as the table's own can be.
    A row that is a pivot itself is probed without that pivot. Prefixes of REACH * sqrt(pivots) share a pivot with probability 1 - exp(-REACH ** 2), 0.998, even if
    they are drawn at random, so recall holds where permutations say nothing; such a table's vectors mostly link with each other.
    """
    most = min(len(pivots), max(least, math.ceil(REACH * math.sqrt(len(pivots)))))
    least = min(least, most)
    other = np.roll(units, 1, axis=0)
    side = other - (units * other).sum(1, keepdims=True) * units
    size = np.linalg.norm(side, axis=1, keepdims=True)
    usable = np.flatnonzero(size[:, 0] > 1e-6)[-PROBES:]
    if not len(usable):
        return most, 1
    one = units[usable]
    two = cosine * one + math.sqrt(max(0.0, 1 - cosine * cosine)) * side[usable] / size[usable]
    place = np.arange(1, most + 1)
    later = np.maximum(place[:, None], place[None, :])
    needed = []
    for i in range(0, len(one), 64):
        a, b = (prefixes(v[i : i + 64] - centre, pivots, most) for v in (one, two))
        seen = one[i : i + 64] - centre
        own = (seen * pivots[a[:, 0]]).sum(1) > (1 - 1e-9) * np.linalg.norm(seen, axis=1)
        a[own, 0] = -1
        met = np.where(a[:, :, None] == b[:, None, :], later, most + 1).reshape(len(a), -1)
        needed.append(np.partition(met, shared - 1, axis=1)[:, :shared] if met.shape[1] >= shared else np.full((len(a), shared), most + 1))
    for n in dict.fromkeys((shared, 1)):
        length = int(np.quantile(np.concatenate(needed).max(1) if n == shared else np.concatenate(needed).min(1), TARGET, method="higher"))
        if length <= most:
            return max(least, length), n
    return most, 1


def _units(raw: list[bytes], dtype: str) -> np.ndarray:
    """Rows in double precision at length 1."""
    v = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _links(batches: Iterator[pa.RecordBatch], cosine: float, shared: dict[int, int], dtype: str) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks of a list: links by vector, and its edge to the smallest id of its part."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "n"])

    for t in grouped(batches, ["dim", "pivot", "_i", "_j"]):
        n = t.num_rows
        if n < 2:
            continue
        pivot = t.column("pivot")[0].as_py()
        one_block = t.column("_i")[0].as_py() == t.column("_j")[0].as_py()
        ids, times, at = (t.column(c).to_numpy() for c in ("vec_id", "times", "_at"))
        vectors, prefix = _units(t.column("raw").to_pylist(), dtype), matrix(t.column("prefix"), np.int32)
        names, where = np.unique(prefix, return_inverse=True)
        marks = np.zeros((n, len(names)), np.float32)
        np.put_along_axis(marks, where.reshape(prefix.shape), 1.0, axis=1)
        common = marks @ marks.T
        before = marks * (names < pivot)
        own_list = (before @ before.T) == 0  # lists of smaller pivots have seen the other pairs
        near = (common >= min(shared.get(t.column("dim")[0].as_py(), 1), prefix.shape[1])) & own_list
        np.fill_diagonal(near, False)
        if not one_block:
            near &= at[:, None] != at[None, :]
        if not near.any():
            continue
        near &= vectors @ vectors.T >= cosine
        linked = near.any(1)
        if not linked.any():
            continue
        label = block_labels(near)
        smallest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, ids)
        out.append((ids[linked], smallest[label][linked], (near @ times)[linked]))
        if sum(len(x[0]) for x in out) > 20_000:
            yield flush()
            out.clear()
    if out:
        yield flush()


def near_vectors(vectors: DataFrame, cosine: float = COSINE, prefix: int = PREFIX, shared: int = MIN_SHARED) -> DataFrame:
    """vectors (vec_id, embedding) as one row a row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of different
    length. `prefix` is the shortest prefix used. Rows that repeat an id and its vector are one vector, and all get its result; a null id links with nothing and is kept. No
    rows, no result. Equal vectors are linked with each other whatever rounding says. Other columns are ignored.
    """
    # components travel in the precision that they came in, and are worked on in double
    dtype = "float32" if dict(vectors.dtypes)["embedding"] == "array<float>" else "float64"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("embedding").to_pylist()
            raw = [None if unit(v) is None else np.array(v, dtype).tobytes() for v in given]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    usable_rows = cut(map_arrow(rows, units, "vec_id long, raw binary"), "vectors")
    usable = usable_rows.where("raw is not null and vec_id is not null").distinct()
    classes = cut(usable.groupBy("raw").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")), "vector-classes")
    n, widest = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("raw")), F.lit(1))).first()
    wanted = max(MIN_PIVOTS, min(MAX_PIVOTS, PIVOT_BYTES // widest, math.ceil(4 * math.sqrt(n))))
    size = np.dtype(dtype).itemsize
    drawn: dict[int, list[bytes]] = {}
    for r in classes.select("vec_id", "raw").orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * wanted).collect():
        drawn.setdefault(len(r["raw"]) // size, []).append(bytes(r["raw"]))
    ranking: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    enough: dict[int, int] = {}
    for dim, raw in drawn.items():
        sample = _units(raw, dtype)
        centre = sample.mean(0)
        pivots = choose_pivots(centred(sample, centre), wanted)
        if len(pivots):
            length, enough[dim] = prefix_length(sample, centre, pivots, cosine, shared, prefix)
            ranking[dim] = (centre, pivots.astype(dtype), length)
    spark = vectors.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(ranking)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = {dim: (centre, pivots.astype(np.float64), length) for dim, (centre, pivots, length) in sent.value.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                data = batch.column("raw").to_pylist()
                dims = np.array([len(x) // size for x in data])
                marks: list[bytes | None] = [None] * len(data)
                for dim in set(dims.tolist()):
                    at = np.flatnonzero(dims == dim)
                    # a length that the draw missed, or of a single vector, has one list
                    if dim in ranking:
                        centre, pivots, length = ranking[dim]
                        found = prefixes(_units([data[i] for i in at], dtype) - centre, pivots, length)
                    else:
                        found = np.zeros((len(at), 1), np.int32)
                    for i, p in zip(at, found, strict=True):
                        marks[i] = p.tobytes()
                lists = [np.frombuffer(m, np.int32).tolist() for m in marks]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("times"), batch.column("raw"), pa.array(dims, pa.int32()), pa.array(marks, pa.binary()), pa.array(lists, pa.list_(pa.int32()))],
                    ["vec_id", "times", "raw", "dim", "prefix", "pivots"],
                )

    described = cut(map_arrow(classes, describe, "vec_id long, times long, raw binary, dim int, prefix binary, pivots array<int>"), "vector-index")
    lists = described.select("vec_id", "times", "raw", "dim", "prefix", F.explode("pivots").alias("pivot"))
    sizes = described.select("dim", F.explode("pivots").alias("pivot")).groupBy("dim", "pivot").agg(F.count("*").alias("size")).where("size > 1")
    # as many rows as pivots; known before the join, so that vectors are not shuffled for it
    sizes = bounded(cut(sizes, "vector-list-sizes"))
    posted = lists.join(sizes, ["dim", "pivot"]).withColumn("list", F.xxhash64("dim", "pivot"))
    spread = paired_blocks(posted, "list", "size", "vec_id", BLOCK).drop("list", "size")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links(batches, cosine, enough, dtype)

    found = cut(map_arrow(spread, links, "a long, b long, n long"), "vector-links")
    joined = components(found.select("a", "b"), "vector-components")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    by_class = (
        classes.select("raw", F.col("vec_id").alias("first"), "times")
        .join(counts, F.col("first") == F.col("a"), "left")
        .join(joined, F.col("first") == F.col("id"), "left")
        .select(
            F.col("raw").alias("_raw"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")
        )
    )
    usable_row = F.col("vec_id").isNotNull()
    result = usable_rows.join(by_class, (F.col("raw") == F.col("_raw")) & usable_row, "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, for tables as small as the SQL check's.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
low AS (SELECT id, min(c) AS c FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN low ON id = vec_id LEFT JOIN n ON a = vec_id
"""

QUERIES = {"op3_pivot_index": op3_pivot_index}
ORACLES = {"op3_pivot_index": SQL}
