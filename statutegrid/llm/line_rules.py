"""Operator 2, quality rules: cross-document line frequency, after base rules on each text.

Each whole text is read once, in Python: base counts, and for each line with a word the hash of its normalised form
(A-Z lower-cased, digits as 0, blanks collapsed) and its words. Then Spark counts the distinct documents of each host that hold a line
(equal texts are one document), pre-aggregated before each shuffle; lines above the host's limit go, and documents that
lose more than MAX_LOST of their words are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.ship import map_arrow
from statutegrid.llm.common import bounded, cut, table

#: A line is common on a host if more than this share of the host's documents hold it, counted as if the host had so many more documents without the line: one law for hosts
#: of any size, under which few documents are little evidence.
MAX_SHARE, MORE_DOCS = 0.02, 150
#: Share of words that a document may lose.
MAX_LOST = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice, by exact ids: pairs of words, of pairs, of fours."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(names) == len(words):
        return 0
    step = 1
    while step < window:
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a line's normalised form."""
    h = xxhash.xxh64_intdigest(b" ".join(line.lower().translate(_DIGITS).split()))
    return h - 2**64 if h >= 2**63 else h


def text_stats(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """(words, word_chars, symbols, duplicate lines, repeated words, line hashes, words a line); null has none."""
    data = (text or "").encode()
    words = data.split()
    blanks = len(data) - len(data.translate(None, _BLANKS))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen, dup, hashes, counts = set(), 0, [], []
    for line in data.split(b"\n"):
        if n := len(line.split()):
            hashes.append(line_hash(line))
            counts.append(n)
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), len(text or "") - blanks, symbols, dup, repeat_words(words), hashes, counts


_STATS = "doc_id long, host long, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, counts array<long>"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [re.match(r"\w+", x.strip())[0] for x in _STATS.split(",")]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows = list(zip(*[text_stats(t) for t in part.column("text").to_pylist()], strict=True))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            columns = [part.column("doc_id"), part.column("host"), part.column("content")]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)


def _same_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, left-joined to b by id, host and text."""
    b = b.withColumnsRenamed({"doc_id": "_id", "host": "_host", "content": "_content"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.col("content") == F.col("_content"))
    return a.join(b, on, "left").drop("_id", "_host", "_content")


def judge(
    docs: DataFrame, host: Column, max_share: float = MAX_SHARE, more_docs: int = MORE_DOCS, max_lost: float = MAX_LOST
) -> DataFrame:
    """docs (doc_id, text) as one row a row: the counts, base_failed, lines_removed, words_removed, kept, and `removed`, the hashes of lines that go.

    A line goes if n / (docs + more_docs) > max_share, n being the host's documents that hold it. Null hosts are one host; null and blank texts have no words and fail the base rules; repeated rows get equal verdicts;
    ids may repeat (rows go by id and text); no rows, no result; other columns are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64(host).alias("host"), F.xxhash64("text").alias("content"), "text")
    stats = cut(map_arrow(rows, _stats, _STATS), "line-stats")
    held = stats.select("host", "content", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    by_line = held.groupBy("host", "line").agg(F.count("*").alias("n"))
    hosts = stats.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    common = (
        by_line.where(F.col("n") > more_docs * max_share).join(hosts, "host").where(F.col("n") > (F.col("docs") + more_docs) * max_share).select("host", "line")
    )
    common = bounded(cut(common, "line-common"))
    pairs = stats.select("doc_id", "host", "content", F.explode(F.arrays_zip("lines", "counts")).alias("x"))
    lost = (
        pairs.select("doc_id", "host", "content", F.col("x.lines").alias("line"), F.col("x.counts").alias("words"))
        .join(common, ["host", "line"])
        .groupBy("doc_id", "host", "content")
        .agg(F.count("*").alias("l"), F.sum("words").alias("w"), F.collect_set("line").alias("removed"))
    )
    # repeated rows were added up together: each has its share
    repeated = stats.groupBy("doc_id", "host", "content").agg(F.count("*").alias("_rows")).where("_rows > 1")
    lost = _same_row(lost, repeated).select(
        "doc_id", "host", "content", "removed",
        (F.col("l") / F.coalesce("_rows", F.lit(1))).cast("long").alias("lines_removed"),
        (F.col("w") / F.coalesce("_rows", F.lit(1))).cast("long").alias("words_removed"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce("words_removed", F.lit(0))
    return _same_row(stats, lost).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.coalesce("lines_removed", F.lit(0)).alias("lines_removed"), removed.alias("words_removed"),
        (~failed & (removed <= F.col("n_words") * max_lost)).alias("kept"),
        F.coalesce("removed", F.array().cast("array<long>")).alias("removed"), "content",
    )


def clean(text: str | None, removed: list[int]) -> str | None:
    """A text without the lines of these hashes; what `judge` decided, applied."""
    if text is None or not removed:
        return text
    gone = set(removed)
    return "\n".join(x for x in text.split("\n") if not x.encode().split() or line_hash(x.encode()) not in gone)


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs, F.col("source")).drop("removed", "content")


SQL = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM spots),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
full_lines AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
    regexp_replace(translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[1-9]', '0', 'g') AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM docs GROUP BY source),
common AS (
  SELECT l.source, norm FROM full_lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, norm, docs HAVING count(DISTINCT text) > (docs + {MORE_DOCS}) * {MAX_SHARE}::DOUBLE),
lost AS (
  SELECT doc_id, count(*) AS l, sum(len(lw)) AS w FROM full_lines f
  JOIN common c ON f.norm = c.norm AND f.source IS NOT DISTINCT FROM c.source GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words.w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.l, 0) AS lines_removed, coalesce(lost.w, 0) AS words_removed
  FROM words LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  lines_removed::BIGINT AS lines_removed, words_removed::BIGINT AS words_removed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND words_removed <= n_words * {MAX_LOST} AS kept
FROM counted
"""

QUERIES = {"op2_line_frequency": op2_line_frequency}
ORACLES = {"op2_line_frequency": SQL}
