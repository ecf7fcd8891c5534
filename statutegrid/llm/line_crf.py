"""Operator 7, quality classifier: a linear-chain conditional random field over a document's lines.

Each line with a word is good or bad. Its score adds up weights of its own binned features and of those of the lines before
and after it; transition weights tie neighbours. Forward-backward gives each line's probability of being good; a document's
quality is their mean, weighted by length. Training maximises the likelihood of the labelled documents, whose lines all carry their
document's label, with Adam on a bounded sample (SAMPLE documents of the smallest id hashes); scoring covers every text.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.ship import map_arrow
from statutegrid.llm.common import column, free_name, table

#: Labelled rows that training takes at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 3000, 32 << 20
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.7
STEPS, RATE, L2 = 150, 0.15, 1e-3
#: Upper bin edges of each feature of a line.
BINS = (
    ("symbols a word", (0.0, 0.02, 0.1, 0.3, 0.8, 1.6)),
    ("exclamations a word", (0.0, 0.1, 0.5, 1.2)),
    ("bars a word", (0.0, 0.05, 0.2, 0.4)),
    ("capitals a byte", (0.0, 0.01, 0.02, 0.04, 0.08, 0.2, 0.4)),
    ("digits a byte", (0.0, 0.02, 0.1)),
    ("repeats of the word before", (0.0, 0.03, 0.1, 0.3, 0.6)),
    ("distinct words a word", (0.15, 0.3, 0.5, 0.7, 0.85, 0.95, 0.999)),
    ("bytes a word", (3.5, 4.5, 5.5, 6.5, 7.5, 9.0, 12.0)),
    ("short words a word", (0.0, 0.1, 0.2, 0.3, 0.45)),
    ("words", (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)),
    ("seen before", (0.0,)),
)
_OFFSETS = np.cumsum([0] + [len(e) + 1 for _, e in BINS])
#: One more index for "no line there".
WIDTH = int(_OFFSETS[-1]) + 1
_SHORT = frozenset((1, 2, 3))
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&<>~^=_@\\{}[]", bytes(range(65, 91)), bytes(range(48, 58))


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, bytes a line) for the lines with a word."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        if not (n := len(words)):
            continue
        size = len(line)
        repeats = sum(map(operator.eq, words, islice(words, 1, None)))
        rows.append((
            (size - len(line.translate(None, _SYMBOLS))) / n, line.count(b"!") / n, line.count(b"|") / n,
            (size - len(line.translate(None, _UPPER))) / size, (size - len(line.translate(None, _DIGITS))) / size,
            repeats / n, len(set(words)) / n, (size - n + 1) / n, sum(map(_SHORT.__contains__, map(len, words))) / n,
            n, line in seen,
        ))
        seen.add(line)
        sizes.append(size)
    return np.array(rows, float).reshape(-1, len(BINS)), np.array(sizes, float)


def bins(raw: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, raw[:, i], "left") + _OFFSETS[i] for i, (_, e) in enumerate(BINS)], 1).astype(np.int32)


def neighbours(own: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the line before and after each line; WIDTH - 1 where a document ends."""
    none = np.full((1, own.shape[1]), WIDTH - 1, np.int32)
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    ends = np.cumsum(lengths[lengths > 0])
    before[np.concatenate([[0], ends[:-1]])] = WIDTH - 1
    after[ends - 1] = WIDTH - 1
    return before, after


@dataclass
class Model:
    weights: np.ndarray  # 3 x WIDTH: own, before, after
    bias: float
    edges: np.ndarray  # 2 x 2, from bad or good to bad or good
    prior: float

    def scores(self, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[0][own].sum(1) + self.weights[1][before].sum(1) + self.weights[2][after].sum(1)

    def document_scores(self, texts: list[str | None]) -> np.ndarray:
        found = [line_features(t) for t in texts]
        lengths = np.array([len(s) for _, s in found])
        out = np.full(len(texts), self.prior)
        if lengths.sum():
            own = bins(np.vstack([r for r, _ in found]))
            good = marginals(self.scores(own, *neighbours(own, lengths)), lengths, self.edges)[0]
            sizes, at = np.concatenate([s for _, s in found]), np.flatnonzero(lengths)
            starts = np.concatenate([[0], np.cumsum(lengths[at])[:-1]])
            out[at] = np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts)
        return np.clip(out, 0.0, 1.0)


def marginals(score: np.ndarray, lengths: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that each line is good, expected counts of transitions, log partition; all documents step by step at once."""
    lengths = lengths[lengths > 0]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]))]  # documents of more than t lines
    top = np.maximum(score, 0)
    node = np.stack([np.exp(-top), np.exp(score - top)], 1)
    move, n = np.exp(edges), len(score)
    alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    for t, k in enumerate(active):
        i = starts[:k] + t
        a = node[i] if t == 0 else (alpha[i - 1] @ move) * node[i]
        scale[i] = s = a.sum(1)
        alpha[i] = a / s[:, None]
    expected = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        i = starts[: active[t]] + t
        out = node[i] * beta[i] / scale[i][:, None]
        expected += (alpha[i - 1].T @ out) * move
        beta[i - 1] = out @ move.T
    good = alpha * beta
    return good[:, 1] / good.sum(1), expected, float(np.log(scale).sum() + top.sum())


def fit(texts: list[str | None], labels: list[int], steps: int = STEPS) -> Model:
    """Weights from labelled texts; with one class or no text only the prior, (good + 1) / (all + 2), tells."""
    prior = (sum(labels) + 1) / (len(labels) + 2)
    model = Model(np.zeros((3, WIDTH)), float(np.log(prior / (1 - prior))), np.zeros((2, 2)), prior)
    found = [line_features(t)[0] for t in texts]
    keep = [i for i, r in enumerate(found) if len(r)]
    if len({labels[i] for i in keep}) < 2:
        return model
    lengths = np.array([len(found[i]) for i in keep])
    own = bins(np.vstack([found[i] for i in keep]))
    parts = (own, *neighbours(own, lengths))
    y = np.repeat(np.array([labels[i] for i in keep]), lengths)
    within = np.array([[(lengths - 1)[np.array([labels[i] for i in keep]) == a].sum() if a == b else 0 for b in (0, 1)] for a in (0, 1)], float)
    n = len(keep)
    values = [model.weights, np.zeros(1) + model.bias, model.edges]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        model.weights, model.bias, model.edges = values[0], float(values[1][0]), values[2]
        good, expected, _ = marginals(model.scores(*parts), lengths, model.edges)
        off = y - good
        gradients = [
            np.stack([np.bincount(p.ravel(), np.repeat(off, p.shape[1]), WIDTH) for p in parts]) / n - L2 * values[0],
            np.array([off.sum() / n]),
            (within - expected) / n - L2 * values[2],
        ]
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            values[i] = values[i] + RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias, model.edges = values[0], float(values[1][0]), values[2]
    return model


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def longest_that_fits(sizes: list[int], limit: int) -> int:
    """Largest size such that all texts of that size and less take no more than `limit` bytes; -1 if there is none."""
    fits, taken = -1, 0
    for size, times in sorted(Counter(sizes).items()):
        taken += size * times
        if taken > limit:
            break
        fits = size
    return fits


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most `sample` labelled rows outside the held-out fold, whose texts take at most `sample_bytes`; only these, a documented bound, come to the driver.

    Where the drawn texts take more, the longest ones are left out, whole.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), "quality").where(fold(F.col("_id")) != HELD_OUT)
    drawn = marked.orderBy(F.xxhash64("_id"), "_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    rows = rows.select("text", "quality", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.struct(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "quality").alias("place"))
    sizes = [r["size"] for r in rows.select("size", "place").orderBy("place", "size").limit(sample).collect()]
    got = rows.where(F.col("size") <= longest_that_fits(sizes, sample_bytes)).orderBy("place", "size").limit(sample).collect()
    return fit([r["text"] for r in got], [r["quality"] for r in got])


def score(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs, without the columns in drop, and score (double; replaces a column of that name).

    Null, empty and blank texts score the prior; a row's score depends on its text alone; no rows, no result.
    """
    names = [c for c in docs.columns if c not in ("score", *drop)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = model.document_scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(found)], [*names, "score"])

    return map_arrow(docs, scored, docs.select(*map(column, names)).schema.add("score", "double"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, columns as they were."""
    given, spare = docs.columns, free_name(docs.columns, "given_score")
    rows = score(docs.withColumnRenamed("score", spare), train(docs, labels)).where(F.col("score") >= THRESHOLD)
    return rows.drop("score").withColumnRenamed(spare, "score").select(*[column(c) for c in given])


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), drop=("text",)).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op7_line_crf": op7_line_crf}
ORACLES: dict[str, str] = {}
