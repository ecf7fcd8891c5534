"""Operator 11, target-distribution importance resampling.

Texts become a sparse matrix of documents by hashed feature buckets, written once as CSR blocks: bounded runs of rows with their row
pointers, column indices and counts. Column sums of the corpus' matrix and of the target's give two distributions over buckets; their log ratio is a bucket's
gain. A sparse matrix-vector product with the gains, block by block, weighs every document; keyed Gumbel noise on the
weights makes the highest scores a draw without replacement, and a sort by ranges numbers them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.ship import map_arrow
from statutegrid.llm.common import crc_table, cut, places, table

BUCKETS, MAX_RUN, SCALE = 10_000, 1, 1000
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"
#: A block ends behind so many rows or entries; a single row has at most one entry a bucket. Blocks are small, as readers, writers and Arrow batches hold thousands of table rows at once.
BLOCK_ROWS, BLOCK_ENTRIES = 64, 1 << 10
#: Blocks that are multiplied together.
TOGETHER = 256
#: Features that a worker keeps the buckets of.
REMEMBERED = 1 << 18

#: What is no word sign, as a blank; A-Z in lower case. Bytes of other letters than ASCII's are word signs.
_FOLD = bytes((b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32) for b in range(256))

BLOCK = "doc_id array<long>, n_words array<long>, row_at array<int>, bucket array<int>, n array<long>"


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of whatever is not ASCII, A-Z in lower case; null has none."""
    return (text or "").encode().translate(_FOLD).split()


def features(found: list[bytes], max_run: int) -> Iterator[bytes]:
    """All runs of 1 to max_run consecutive words, joined by one space."""
    yield from found
    for n in range(2, max_run + 1):
        for at in range(len(found) - n + 1):
            yield b" ".join(found[at : at + n])


def _counter(buckets: int):
    known: dict[bytes, int] = {}

    def row(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Buckets in ascending order and the counts of their features."""
        if len(known) > REMEMBERED:
            known.clear()
        at = np.empty(len(counts), np.int64)
        for i, f in enumerate(counts):
            b = known.get(f)
            if b is None:
                b = known[f] = zlib.crc32(f) % buckets
            at[i] = b
        held, which = np.unique(at, return_inverse=True)
        n = np.zeros(len(held), np.int64)
        np.add.at(n, which, np.fromiter(counts.values(), np.int64, len(counts)))
        return held, n

    return row


def count_matrix(docs: DataFrame, label: str, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """docs (doc_id, text) as CSR blocks, written to the shared folder: row r of a block has entries row_at[r] to row_at[r + 1] of bucket and n.

    Null, empty and wordless texts are rows without entries; ids may be null or repeat; an empty table has no blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = _counter(buckets)
        ids, sizes, ends, held, counts = [], [], [0], [], []

        def block() -> pa.RecordBatch:
            put = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int32()))]
            columns += [pa.array([put(held)], pa.list_(pa.int32())), pa.array([put(counts)], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "row_at", "bucket", "n"])

        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = words(text.as_py())
                at, n = row(Counter(features(found, max_run)))
                ids.append(key.as_py())
                sizes.append(len(found))
                ends.append(ends[-1] + len(at))
                held.append(at)
                counts.append(n)
                if len(ids) >= BLOCK_ROWS or ends[-1] >= BLOCK_ENTRIES:
                    yield block()
                    ids, sizes, ends, held, counts = [], [], [0], [], []
        if ids:
            yield block()

    return cut(map_arrow(docs.select("doc_id", "text"), blocks, BLOCK), label)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features a bucket over all rows; each task adds up its blocks, so at most one row a task and bucket is shuffled and one a bucket reaches the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, _flat(batch, "bucket"), _flat(batch, "n"))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_arrow(matrix.select("bucket", "n"), sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of how much likelier a bucket is in the target), both distributions smoothed by one feature a bucket."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: (t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(scale * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(key: int | None, seed: str = SEED, scale: int = SCALE) -> int:
    """A Gumbel draw that seed and id decide, times scale; a null id counts as an empty one."""
    h = int(sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(matrix: DataFrame, gain: np.ndarray, seed: str = SEED, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of the matrix: the product of its counts with the gains, and that plus noise."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(i, TOGETHER)
                size = lambda name: pc.list_value_length(some.column(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                pointers, n = size("row_at"), _flat(some, "n")
                # row pointers of all blocks, each block's behind the entries of those before it
                ends = _flat(some, "row_at") + np.repeat(np.cumsum(size("bucket")) - size("bucket"), pointers)
                last = np.cumsum(pointers)[:-1] - 1
                upto = lambda values: np.delete(np.diff(np.concatenate([[0], np.cumsum(values)])[ends]), last)  # noqa: B023, E731
                weight, held = upto(n * gain[_flat(some, "bucket")]), upto(n)
                ids = some.column("doc_id").flatten()
                drawn = np.array([noise(k, seed, scale) for k in ids.to_pylist()], np.int64)
                columns = [ids, some.column("n_words").flatten(), pa.array(held), pa.array(weight), pa.array(weight + drawn)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    return map_arrow(matrix, product, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: str = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text); rank from 1 for the drawn, null for the rest.

    floor(percent * N / 100) of the N rows with at least min_words words are drawn, those of the highest scores, ties to smaller ids, null
    ids last. target (text): what the draw is to look like; without features in it all gains follow from the corpus alone. Null and empty texts have
    no features and weigh 0; repeated rows score alike and are drawn one by one; an empty table gives no rows; other columns are ignored.
    """
    corpus = count_matrix(docs, "importance-corpus", buckets, max_run)
    wanted = count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "importance-target", buckets, max_run)
    gain = gains(column_sums(corpus, buckets), column_sums(wanted, buckets))
    enough = F.col("n_words") >= min_words
    scored = cut(weigh(corpus, gain, seed).withColumn("_enough", enough), "importance-scores")
    order = [F.desc("_enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("n_words")]
    ranked = places(scored, ["_enough"], order, "importance")
    rank = F.when(F.col("_enough") & (F.col("_place") < F.floor(percent * F.col("_of") / 100)), F.col("_place") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **settings: object) -> DataFrame:
    """The rows of docs that the draw takes, all their columns; ids are taken to name rows."""
    taken = resample(docs, target, **settings).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(taken, "doc_id", "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the benchmark's texts; a tenth of those with 20 words is drawn."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
corpus AS (SELECT doc_id, f, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(w) AS f FROM w) GROUP BY doc_id, f),
target AS (SELECT f, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}')) AS f FROM benchmark) GROUP BY f),
buckets AS (SELECT f, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda crc, b: xor(crc >> 8, ({crc_table()}::BIGINT[])[xor(crc, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS b FROM (SELECT f FROM corpus UNION SELECT f FROM target)),
s AS (SELECT b, sum(n)::BIGINT AS s FROM corpus JOIN buckets USING (f) GROUP BY b),
t AS (SELECT b, sum(n)::BIGINT AS t FROM target JOIN buckets USING (f) GROUP BY b),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS sa, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS ta),
gain AS (SELECT s.b, floor({SCALE} * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + {BUCKETS}) / ((s + 1)::DOUBLE * (ta + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t ON s.b = t.b, totals),
weights AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM corpus JOIN buckets USING (f) JOIN gain USING (b) GROUP BY doc_id),
scores AS (SELECT w.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN weights USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scores WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT {PERCENT} * count(*) // 100 FROM ranks) THEN r END AS rank FROM scores LEFT JOIN ranks USING (doc_id)
"""

QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {"op11_importance_resampling": SQL}
