"""Operator 9, MinHash near-dedup with sequential Bayesian verification.

Each whole text becomes its set of hashed 5-word shingles, a signature of 128 minimum hashes and 32 bands of four. Equal sets are one
class. Band buckets of the same members are one bucket. Inside a bucket, block by block, signatures are compared in
batches of 32; a pair goes as soon as the posterior probability that its similarity reaches the threshold falls below MISS.
Survivors are verified on full sets. First each block names a spanning forest of its likeliest pairs, among its own rows and with the
block that represents the bucket; the links among them join most of a group, with two copies of a row whatever the bucket's size.
The second round first tells by signatures alone which rows have a surviving pair with another component, and in which bucket: of those that both rows are in, the
first in one order of all buckets. Only these rows' full sets move, and only there. It then goes through every such pair, the likeliest first, where the blocks' full sets lie, and
passes over pairs that links found there have joined; only links leave a block, never pairs. Rows of a bucket's largest component meet only the
other components' rows, so a large group of copies costs a copy of a row a block of outsiders. Buckets of many rows are salted where they are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.ship import map_arrow
from statutegrid.llm.blocks import BLOCK, grouped, matrix, minor_blocks, represented_blocks
from statutegrid.llm.common import bounded, components, cut, hot_limit, table

SHINGLE = 5
PERCENT = 75
HASHES, BAND_ROWS, BATCH = 128, 4, 32
#: Chance, by the posterior, that a pruned pair reaches the threshold all the same.
MISS = 1e-4
#: Buckets of more rows than this are joined in parts of so many.
HOT_BUCKET, HOT_BUCKETS = 2_000, 1_000_000
_MASK = 2**64 - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class _Words(dict):
    """64-bit hashes of words, kept while they are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; all words as one where there are fewer than five; nothing without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    out = h[:n].copy()
    for i in range(1, size):
        out = out * _P + h[i : i + n]
    return np.unique(_mixed(out + np.uint64(size)))


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(9).integers(0, 2**64, HASHES, np.uint64, endpoint=False) | np.uint64(1)


def minimums(set_: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.uint64(_MASK))
    for i in range(0, len(set_), 1024):
        np.minimum(low, (set_[i : i + 1024, None] * _factors()).min(0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(-1, BAND_ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for i in range(BAND_ROWS):
        key = key * _P + rows[:, i]
    return _mixed(key).view(np.int64)


def signature(low: np.ndarray) -> np.ndarray:
    return (_mixed(low) >> np.uint64(48)).astype(np.uint16)


@cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest equal hashes whose posterior (uniform prior) leaves at least `miss` to a similarity of percent or more.

    P(s >= t | m of n equal) is the upper tail of Beta(m + 1, n - m + 1), a binomial sum.
    """
    t = percent / 100
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = lambda m, n=n: sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))
        found.append(next(m for m in range(n + 1) if tail(m) >= miss))
    return tuple(found)


def surviving(a: np.ndarray, b: np.ndarray, allowed: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b, equal hashes) that no batch prunes, among the allowed ones."""
    i, j = np.nonzero(allowed)
    equal = np.zeros(len(i), np.int32)
    for k, limit in enumerate(limits):
        part = slice(k * BATCH, (k + 1) * BATCH)
        for s in range(0, len(i), 1 << 17):
            e = slice(s, s + (1 << 17))
            equal[e] += (a[i[e], part] == b[j[e], part]).sum(1, dtype=np.int32)
        keep = equal >= limit
        i, j, equal = i[keep], j[keep], equal[keep]
    return i, j, equal


class _Union:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[x] = y


def forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> list[int]:
    """Positions of a maximal spanning forest's edges."""
    union, out = _Union(n), []
    for k in np.argsort(-weight, kind="stable").tolist():
        x, y = union.root(int(i[k])), union.root(int(j[k]))
        if x != y:
            union.join(x, y)
            out.append(k)
    return out


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct hashes reach the similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


_SETS = "doc_id long, n_shingles long, set1 long, set2 long, sig binary, bands array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            rows = []
            for text in part.column("text").to_pylist():
                found = shingles(text)
                if not len(found):
                    rows.append((0, 0, 0, None, None))
                    continue
                low, raw = minimums(found), found.tobytes()
                h = xxhash.xxh3_128_intdigest(raw)
                halves = np.array([h & _MASK, h >> 64], np.uint64).view(np.int64).tolist()
                rows.append((len(found), *halves, signature(low).tobytes(), bands(low).tolist()))
            n, s1, s2, sig, keys = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set1", "set2", "sig", "bands"],
            )


def _sharing(lists: pa.ChunkedArray) -> np.ndarray:
    """Which rows have a value in common, as a matrix."""
    n = len(lists)
    row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
    _, value, count = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True, return_counts=True)
    several = count[value] > 1
    row, (_, value) = row[several], np.unique(value[several], return_inverse=True)
    out = np.zeros((n, n), bool)
    for s in range(0, value.max(initial=-1) + 1, 1024):
        here = (value >= s) & (value < s + 1024)
        held = np.zeros((n, 1024), np.float32)
        held[row[here], value[here] - s] = 1
        out |= held @ held.T > 0
    return out


def _candidates(t: pa.Table, limits: tuple[int, ...], within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surviving pairs of a pair of blocks, between different parts; within: pairs inside the second block count too.

    With the buckets before this one that each row is in (earlier), pairs that meet in one of them are left to it.
    """
    part, at = (t.column(c).to_numpy() for c in ("part", "_at"))
    sigs = matrix(t.column("sig"), np.uint16)
    allowed = np.triu(part[:, None] != part[None, :], 1)
    if t.column("_i")[0].as_py() != (second := t.column("_j")[0].as_py()):
        apart = at[:, None] != at[None, :]
        allowed &= apart | (at == second)[:, None] if within else apart
    if "earlier" in t.column_names and allowed.any():
        allowed &= ~_sharing(t.column("earlier"))
    return surviving(sigs, sigs, allowed, limits)


def _suspects(batches: Iterator[pa.RecordBatch], limits: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each pair of blocks that have a surviving pair in it, by bucket."""
    for t in grouped(batches, ["bucket", "_i", "_j"]):
        if t.num_rows < 2:
            continue
        i, j, _ = _candidates(t, limits, False)
        if len(i):
            rows = pa.array(np.union1d(i, j))
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(rows) for c in ("bucket", "doc_id")], ["bucket", "doc_id"])


def _pairs(batches: Iterator[pa.RecordBatch], limits: tuple[int, ...], percent: int, within: bool = False) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks of a bucket: its likeliest pairs (a spanning forest of parts), or with full sets, its links (likewise).

    within: pairs inside the second block count too.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        cols = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["a", "b"])

    for t in grouped(batches, ["bucket", "_i", "_j"]):
        if t.num_rows < 2:
            continue
        ids, part = (t.column(c).to_numpy() for c in ("doc_id", "part"))
        i, j, equal = _candidates(t, limits, within)
        if not len(i):
            continue
        names, place = np.unique(part, return_inverse=True)
        if "set" not in t.column_names:
            keep = forest(place[i], place[j], equal, len(names))
        else:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
            union, keep = _Union(len(names)), []
            for k in np.argsort(-equal, kind="stable").tolist():
                x, y = union.root(int(place[i[k]])), union.root(int(place[j[k]]))
                if x != y and alike(sets[i[k]], sets[j[k]], percent):
                    union.join(x, y)
                    keep.append(k)
        if keep:
            i, j = i[keep], j[keep]
            out.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
            if sum(len(x[0]) for x in out) > 20_000:
                yield flush()
    if out:
        yield flush()


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            sets = zip(*([np.frombuffer(v.as_buffer(), np.uint64) for v in part.column(c)] for c in ("set_a", "set_b")), strict=True)
            mask = pa.array([alike(x, y, percent) for x, y in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            sets = pa.array([shingles(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets], ["doc_id", "set"])


def bounded_hot(buckets: DataFrame) -> DataFrame:
    """buckets (bucket, size) of many rows, to be broadcast, with the number of parts that each is joined in.

    At least HOT_BUCKET rows; more where so many buckets have as many that their list would not be small.
    """
    limit = hot_limit(buckets, "size", HOT_BUCKET, HOT_BUCKETS)
    return F.broadcast(buckets.where(F.col("size") > limit).select("bucket", F.ceil(F.col("size") / limit).cast("int").alias("parts")))


def near_documents(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """docs (doc_id, text) as one row a row: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and link with nothing. A null id links with nothing; its component is null and it is
    kept. Ids name documents: rows that repeat an id and its text are one document and all get its result. No rows, no
    result. Other columns are ignored. One row of each component is kept, that of the smallest id.
    """
    limits = least_matches(percent, miss)
    rows = docs.select("doc_id", "text")
    sets = cut(map_arrow(rows, _sets, _SETS), "minhash-sets")
    named = sets.where("doc_id is not null and n_shingles > 0")
    classes = cut(named.groupBy("set1", "set2").agg(F.min("doc_id").alias("first")), "minhash-classes")
    firsts = classes.withColumnsRenamed({"first": "_first", "set1": "_s1", "set2": "_s2"})
    same = (F.col("doc_id") == F.col("_first")) & (F.col("set1") == F.col("_s1")) & (F.col("set2") == F.col("_s2"))
    banded = named.join(firsts, same, "left_semi").dropDuplicates(["doc_id", "set1", "set2"]).select("doc_id", "sig", "bands")
    banded = cut(banded, "minhash-signatures")
    entries = banded.select("doc_id", F.explode("bands").alias("bucket"))
    own = F.xxhash64("doc_id")
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(own).alias("x"), F.min("doc_id").alias("low")).where("size > 1")
    # buckets of the same members are one
    distinct = cut(buckets.groupBy("size", "x", "low").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "minhash-distinct")
    hot = bounded_hot(distinct)
    salts = lambda rows: rows.join(hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = lambda rows: salts(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    one = F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.col("parts")).cast("int")
    salted = salts(entries).withColumn("salt", one).drop("parts")
    members = cut(salted.join(every(distinct), ["bucket", "salt"]), "minhash-buckets")
    signatures = banded.select("doc_id", "sig")

    def full_sets(ids: DataFrame, label: str) -> DataFrame:
        """Full sets of the documents with these ids (_id), each text read again where it lies."""
        ids = cut(ids.distinct(), f"{label}-ids")
        texts = rows.join(bounded(ids), F.col("doc_id") == F.col("_id"), "left_semi")
        return cut(map_arrow(texts, _full_sets, "doc_id long, set binary").dropDuplicates(["doc_id"]), f"{label}-texts")

    needed = lambda spread: spread.select("bucket", "_i", "_j", "_at", "doc_id", "part", "sig", *[c for c in spread.columns if c in ("earlier", "set")])

    def judged(spread: DataFrame, within: bool) -> DataFrame:
        return map_arrow(needed(spread), lambda it: _pairs(it, limits, percent, within), "a long, b long").distinct()

    first_round = members.join(signatures, "doc_id").withColumn("part", F.col("doc_id"))
    likely = cut(judged(represented_blocks(first_round, "bucket", "size", "doc_id"), True), "minhash-likely")
    known = full_sets(likely.select(F.col("a").alias("_id")).unionByName(likely.select(F.col("b").alias("_id"))), "minhash-likely")
    left = known.withColumnsRenamed({"doc_id": "a", "set": "set_a"})
    right = known.withColumnsRenamed({"doc_id": "b", "set": "set_b"})
    links = cut(map_arrow(likely.join(left, "a").join(right, "b"), lambda it: _verified(it, percent), "a long, b long"), "minhash-links")
    parts = cut(components(links, "minhash-parts"), "minhash-part")
    labelled = members.join(parts, F.col("doc_id") == F.col("id"), "left").select("bucket", "salt", "size", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    labelled = cut(labelled, "minhash-labelled")
    # of each bucket of several components: the one of most members, and how many it has
    by_part = labelled.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    largest = by_part.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.max("size").alias("size")).where("top.n < size")
    mixed = cut(largest.select("bucket", F.col("top.part").alias("main_part"), F.col("top.n").alias("n_main"), (F.col("size") - F.col("top.n")).alias("n_minor")), "minhash-mixed")
    rest = labelled.drop("size").join(every(mixed), ["bucket", "salt"]).withColumn("main", F.col("part") == F.col("main_part"))
    # each row's buckets in one order, largest first (those of several blocks last), and with each of them the ones before it
    n = F.col("n_minor") + F.col("n_main")
    rank = F.when(n <= BLOCK, BLOCK - n).otherwise(n).alias("rank")
    own = rest.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(rank, "bucket", "salt", "part", "main", "n_minor", "n_main"))).alias("own"))
    rest = own.select("doc_id", F.posexplode("own").alias("n", "at"), F.col("own.bucket").alias("order"))
    rest = cut(rest.select("doc_id", "at.*", F.slice("order", F.lit(1), F.col("n")).alias("earlier")).drop("rank"), "minhash-rest")
    across = lambda rows: minor_blocks(rows, "bucket", "main", "n_minor", "n_main", "doc_id")
    signed = rest.drop("salt").join(signatures, "doc_id")
    suspects = cut(map_arrow(needed(across(signed)), lambda it: _suspects(it, limits), "bucket long, doc_id long").distinct(), "minhash-suspects")
    few = cut(rest.drop("n_minor", "n_main").join(suspects, ["bucket", "doc_id"], "left_semi"), "minhash-few")
    sizes = cut(few.groupBy("bucket").agg(F.count_if(~F.col("main")).alias("n_minor"), F.count_if("main").alias("n_main")), "minhash-sizes")
    held = few.join(every(sizes), ["bucket", "salt"]).drop("salt").join(signatures, "doc_id")
    held = held.join(full_sets(few.select(F.col("doc_id").alias("_id")), "minhash-rest"), "doc_id")
    more = cut(judged(across(held), False), "minhash-more")
    joined = components(links.unionByName(more), "minhash-components")
    by_class = classes.join(joined, F.col("first") == F.col("id"), "left").select(
        F.col("set1").alias("_s1"), F.col("set2").alias("_s2"), F.coalesce("component", "first").alias("_component")
    )
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    found = sets.join(by_class, (F.col("set1") == F.col("_s1")) & (F.col("set2") == F.col("_s2")) & has, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that near_documents keeps, columns as they were; rows of one id stay or go together."""
    lost = cut(near_documents(docs).where("not kept").select(F.col("doc_id").alias("lost_id")).distinct(), "minhash-lost")
    return docs.join(bounded(lost), docs["doc_id"] == lost["lost_id"], "left_anti")


def op9_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))


#: Exact: shingles meet shingles, similarities from counts, components by recursion.
SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)) + 1)) AS i FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') || CASE WHEN len(w) < {SHINGLE} THEN ' *' || len(w) ELSE '' END AS s FROM spots),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= {PERCENT} * (x.n + y.n - c.n)),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
low AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d JOIN low ON id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

QUERIES = {"op9_minhash_bayes": op9_minhash_bayes}
ORACLES = {"op9_minhash_bayes": SQL}
