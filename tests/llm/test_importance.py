import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pandas as pd

from statutegrid.llm import importance


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_features(text, max_run=1):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]


def plain_rows(docs, target, buckets, max_run=1, percent=10, min_words=20):
    """(doc_id, n_features, weight, score, rank) by loops."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    corpus, wanted = Counter(), Counter()
    for _, text in docs:
        corpus.update(map(of, plain_features(text, max_run)))
    for text in target:
        wanted.update(map(of, plain_features(text, max_run)))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    rows = []
    for key, text in docs:
        found = plain_features(text, max_run)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in map(of, found))
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text)) >= min_words))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): n + 1 for n, r in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = np.array(["alpha", "Beta", "gamma7", "déjà", "straße", "x", "Ωmega", "two-part", "naïve_case", "日本語"])
    return [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(n)]


def as_rows(found):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()), key=repr)


def test_against_plain_loops_for_words_and_runs(spark):
    docs = list(enumerate(texts(300, 1)))
    target = texts(20, 2)
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")
    for buckets, max_run in ((10_000, 1), (7, 1), (50, 3)):
        got = importance.resample(frame, wanted, buckets=buckets, max_run=max_run)
        assert as_rows(got) == sorted(plain_rows(docs, target, buckets, max_run), key=repr)


def test_blocks_hold_the_whole_matrix(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_ROWS", 3)
    docs = list(enumerate(texts(40, 3)))
    matrix = importance.count_matrix(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "test-matrix", 100)
    seen = {}
    for b in matrix.collect():
        assert len(b["row_at"]) == len(b["doc_id"]) + 1 and b["row_at"][-1] == len(b["bucket"]) == len(b["n"])
        for n, key in enumerate(b["doc_id"]):
            seen[key] = dict(zip(b["bucket"][b["row_at"][n] : b["row_at"][n + 1]], b["n"][b["row_at"][n] : b["row_at"][n + 1]], strict=True))
    want = {k: dict(Counter(zlib.crc32(f.encode()) % 100 for f in plain_features(t))) for k, t in docs}
    assert seen == want
    sums = importance.column_sums(matrix, 100)
    assert sums.tolist() == [sum(w.get(b, 0) for w in want.values()) for b in range(100)]


def test_no_row_of_the_matrix_grows_with_the_table(spark):
    docs = [(i, " ".join(f"w{i % 97}x{j}" for j in range(20))) for i in range(5000)]
    matrix = importance.count_matrix(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "test-matrix")
    # thousands of rows are in memory at once where the matrix is written and read
    sizes = [(len(b["doc_id"]), len(b["bucket"])) for b in matrix.collect()]
    assert sum(n for n, _ in sizes) == 5000 and max(n for _, n in sizes) < 2048 and max(n for n, _ in sizes) <= 64


def test_sql_equals_the_operator(spark):
    docs, target = list(enumerate(texts(120, 4))), texts(9, 5)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame({"text": target}))
    want = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({importance.SQL})").fetchall()
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
    assert as_rows(got) == sorted(want, key=repr)


def test_draw_leans_towards_the_target(spark):
    like = ["red green blue " * 10] * 50
    other = ["stone paper wood " * 10] * 950
    docs = spark.createDataFrame(list(enumerate(like + other)), "doc_id long, text string")
    got = importance.resample(docs, spark.createDataFrame([("blue green red",)], "text string")).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 101)) and {r["doc_id"] for r in got} >= set(range(50))


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("one two",), (None,)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = importance.resample(odd_docs, target, min_words=5, percent=50)
    assert as_rows(got) == sorted(plain_rows(rows, ["one two", None], 10_000, 1, 50, 5), key=repr)
    assert importance.resample(no_docs, target).count() == 0
    assert importance.resample(odd_docs, target.limit(0)).count() == 10
    taken = importance.drawn(odd_docs, target, min_words=5, percent=50)
    assert taken.columns[0] == "doc_id" and set(taken.columns) == set(odd_docs.columns)
