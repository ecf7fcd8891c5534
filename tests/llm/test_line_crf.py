import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statutegrid.llm import line_crf


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 5, 2])
    score, edges = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    good, expected, log_z = line_crf.marginals(score, lengths, edges)
    at, want_edges, want_z = 0, np.zeros((2, 2)), 0.0
    for n in lengths:
        z, p, e = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + i] for i in range(n) if y[i]) + sum(edges[a, b] for a, b in itertools.pairwise(y)))
            z += w
            p += w * np.array(y)
            for a, b in itertools.pairwise(y):
                e[a, b] += w
        assert good[at : at + n] == pytest.approx(p / z)
        want_edges += e / z
        want_z += np.log(z)
        at += n
    assert expected == pytest.approx(want_edges) and log_z == pytest.approx(want_z)


def test_neighbours_stop_at_documents():
    own = np.arange(4, dtype=np.int32).reshape(4, 1)
    before, after = line_crf.neighbours(own, np.array([1, 0, 3]))
    none = line_crf.WIDTH - 1
    assert before.ravel().tolist() == [none, none, 1, 2] and after.ravel().tolist() == [none, 2, 3, none]


def documents():
    good = ["Plain prose about number %d goes on for a while.\nIt has lines, and they end well." % i for i in range(120)]
    bad = ["buy!! now!! %d!! ###\n$$$ $$$ %% %% || ||\nwin win win win win win" % i for i in range(120)]
    return [(i, t) for i, t in enumerate(good + bad)], {i: int(i < 120) for i in range(240)}


def test_held_out_accuracy_and_labels_stay_out(spark):
    rows, quality = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    fold = docs.select("doc_id", line_crf.fold(F.col("doc_id")).alias("f"))
    held = {r["doc_id"] for r in fold.collect() if r["f"] == line_crf.HELD_OUT}
    assert 30 < len(held) < 90
    model = line_crf.train(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in line_crf.score(docs, model).collect()}
    assert all((scored[i] >= line_crf.THRESHOLD) == bool(quality[i]) for i in held)
    # wrong labels in the held-out fold, and none at all there, change nothing
    wrong = labels.join(fold, "doc_id").select("doc_id", F.when(F.col("f") == line_crf.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    other = {r["doc_id"]: r["score"] for r in line_crf.score(docs, line_crf.train(docs, wrong)).collect()}
    assert other == pytest.approx(scored)


def test_odd_rows(spark, odd_docs, no_docs):
    rows, quality = documents()
    model = line_crf.fit([t for _, t in rows], list(quality.values()))
    out = line_crf.score(odd_docs, model)
    got = out.collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if not (r["text"] or "").strip(" \t\n\r\x0b\x0c")} == {model.prior}
    assert len({r["score"] for r in got if r["doc_id"] in (8, 9)}) == 1
    assert line_crf.score(no_docs, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    kept = line_crf.accepted(odd_docs, labels)  # one class: only the prior tells
    assert kept.columns == odd_docs.columns
    assert line_crf.train(no_docs, labels).prior == 0.5


def test_lines_without_words_do_not_count():
    raw, sizes = line_crf.line_features("a b\n\n \t\nc\n")
    assert len(raw) == len(sizes) == 2
    assert line_crf.line_features(None)[0].shape == (0, len(line_crf.BINS))


def plain_score(model, text):
    """Forward and backward sums over one document's lines, in loops."""
    raw, sizes = line_crf.line_features(text)
    if not len(sizes):
        return model.prior
    own = line_crf.bins(raw).tolist()
    none = [line_crf.WIDTH - 1] * len(line_crf.BINS)
    node = []
    for i, row in enumerate(own):
        before, after = own[i - 1] if i else none, own[i + 1] if i + 1 < len(own) else none
        s = model.bias + sum(model.weights[0][f] for f in row) + sum(model.weights[1][f] for f in before) + sum(model.weights[2][f] for f in after)
        node.append((0.0, float(s)))
    add = lambda a, b: max(a, b) + np.log1p(np.exp(-abs(a - b)))
    e, n = model.edges, len(node)
    forward, backward = [node[0]], [(0.0, 0.0)]
    for i in range(1, n):
        forward.append(tuple(node[i][y] + add(forward[-1][0] + e[0][y], forward[-1][1] + e[1][y]) for y in (0, 1)))
        later = [node[n - i][y] + backward[0][y] for y in (0, 1)]
        backward.insert(0, tuple(add(e[x][0] + later[0], e[x][1] + later[1]) for x in (0, 1)))
    good = [1 / (1 + np.exp((f[0] + b[0]) - (f[1] + b[1]))) for f, b in zip(forward, backward, strict=True)]
    return sum(g * s for g, s in zip(good, sizes, strict=True)) / sum(sizes)


def test_the_query_s_scores_are_those_of_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = line_crf.op7_line_crf(spark, sf).collect()
    assert len(got) == len(texts) == 1000
    for r in got:
        assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_training_texts_are_bounded_by_bytes(spark):
    rows = [(i, ("good words in a line of text " if i % 2 else "### | ### | ") * (500 if i in (3, 8) else 1), i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    short = docs.where("length(text) < 100")
    bounded, plain = line_crf.train(docs, labels, sample_bytes=2000), line_crf.train(short, labels)
    assert np.array_equal(bounded.weights, plain.weights) and bounded.prior == plain.prior
    assert line_crf.train(docs, labels, sample_bytes=0).prior == 0.5
    assert line_crf.longest_that_fits([5, 5, 1, 0], 10) == 1
    assert line_crf.longest_that_fits([5, 5, 1, 0], 11) == 5
    assert line_crf.longest_that_fits([], 10) == -1
