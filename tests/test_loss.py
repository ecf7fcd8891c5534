"""The loss against sums over all labellings and against formulas written out."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from statutegrid.operators import loss as K

MOVES = [[0.4, -0.3, -2.0], [0.1, 0.2, 0.7], [-0.5, 0.0, 0.3]]
BEGIN, FINISH = [0.3, -0.2, -5.0], [0.0, 0.4, 0.1]
SCHEMA = "b int, logits array<array<double>>, labels array<int>, ordinal_logits array<double>, ordinal_labels array<int>, aim_n int"


def path(x, y):
    if not y:
        return 0.0
    return sum(t[k] for t, k in zip(x, y, strict=True)) + sum(MOVES[a][b] for a, b in zip(y, y[1:], strict=False)) + BEGIN[y[0]] + FINISH[y[-1]]


def soft_plus(x):
    return max(x, 0) + math.log1p(math.exp(-abs(x)))


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randrange(0, 6)
        aim = rng.choice([0, 0, 1, 2, 5, None])
        logits = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(size)]
        rows.append((i % 3, logits, [rng.choice([-100, 0, 1, 2]) for _ in range(size)], [rng.uniform(-40, 40) for _ in range(3)], [int((aim or 0) >= k) for k in (1, 2, 3)], aim))
    return rows


@pytest.mark.parametrize("crf", [True, False])
def test_losses_written_out(spark, crf):
    rows = made(1, 60)
    got = {r["b"]: r for r in K.losses(spark.createDataFrame(rows, SCHEMA), "b", MOVES if crf else None, BEGIN, FINISH).collect()}
    for b in range(3):
        own = [r for r in rows if r[0] == b]
        kept = [([t for t, y in zip(r[1], r[2], strict=True) if y >= 0], [y for y in r[2] if y >= 0]) for r in own]
        if crf:
            z = lambda x: math.log(sum(math.exp(path(x, list(y))) for y in itertools.product(range(3), repeat=len(x)))) if x else 0.0
            span = sum(z(x) - path(x, y) for x, y in kept) / len(own)
        else:
            span = sum(math.log(sum(map(math.exp, t))) - t[k] for x, y in kept for t, k in zip(x, y, strict=True)) / sum(len(y) for _, y in kept)
        ordinal = 0.0
        for j in range(3):
            n_pos = max(sum(r[4][j] for r in own), 1)
            w = min(max(len(own) - n_pos, 1) / n_pos, 50)
            ordinal += sum(w * r[4][j] * soft_plus(-r[3][j]) + (1 - r[4][j]) * soft_plus(r[3][j]) for r in own)
        ordinal /= 3 * len(own)
        none = [r for r in own if r[5] == 0]
        penalty = sum(t[1] + t[2] for r in none for t in r[1]) / max(sum(len(r[1]) for r in none), 1)
        assert got[b]["n"] == len(own) and got[b]["span_loss"] == pytest.approx(span) and got[b]["ordinal_loss"] == pytest.approx(ordinal) and got[b]["penalty"] == pytest.approx(penalty)
        assert got[b]["loss"] == pytest.approx(span + 0.3 * ordinal + 0.5 * penalty)


def test_batches_without_sentences_of_no_aim_have_no_penalty(spark):
    rows = [(0, [[1.0, 2.0, 3.0]], [1], [0.0, 0.0, 0.0], [1, 0, 0], 1), (0, [], [], [1.0, 1.0, 1.0], [1, 1, 1], None)]
    r = K.losses(spark.createDataFrame(rows, SCHEMA), "b", MOVES).first()
    assert r["penalty"] is None and r["loss"] == pytest.approx(r["span_loss"] + 0.3 * r["ordinal_loss"])
    assert K.losses(spark.createDataFrame([], SCHEMA), "b", MOVES).count() == 0


def test_scores_of_any_size_stay_finite(spark):
    df = spark.createDataFrame([([[900.0, -900.0, 0.0]] * 50,)], "x array<array<double>>")
    assert df.select(K.log_partition(F.col("x"), [[0.0] * 3] * 3)).first()[0] == pytest.approx(45_000.0)
