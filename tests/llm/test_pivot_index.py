import numpy as np
import pyarrow as pa
import pytest

from statutegrid.llm import pivot_index
from statutegrid.llm.blocks import block_labels
from tests.llm.brute import smallest_reachable


def expected(rows, cosine=0.9):
    units = {i: pivot_index.unit(v) for i, v in rows}

    def linked(a, b):
        x, y = units[a], units[b]
        return x is not None and y is not None and len(x) == len(y) and (float(x @ y) >= cosine or np.array_equal(x, y))

    ids = list(units)
    low = smallest_reachable(ids, linked)
    return {i: (sum(linked(i, j) for j in ids if j != i), low[i], low[i] == i) for i in ids}


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, unit string").repartition(3)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivot_index.near_vectors(df, **more).collect()}


def test_odd_vectors_link_with_nothing(spark):
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(odd)]
    rows += [(10, [1.0, 2.0, 3.0, 4.0]), (11, [1.0, 2.0, 3.0, 4.0]), (12, [1e30, 2e30, 3e30, 4e30]), (13, [1.0, 2.0, 3.0]), (14, [-1.0, -2.0, -3.0, -4.0]), (15, [1e-30, 2e-30, 3e-30, 4e-30])]
    want = expected(rows)
    got = found(spark, [(i, v, 1, "u") for i, v in rows] + [(11, rows[7][1], 1, "u"), (None, rows[6][1], 1, "u")])
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None] == (0, None, True)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_index.near_vectors(df).count() == 0


def test_recall_against_brute_force_near_the_threshold_and_a_hot_group(spark, lengths):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 64))
    rows = [(i, v) for i, v in enumerate(base)]
    for i in range(150):  # pairs of cosine 0.9 to 1
        v, other = base[i] / np.linalg.norm(base[i]), rng.normal(size=64)
        other -= other @ v * v
        c = rng.uniform(0.9, 1.0)
        rows.append((1000 + i, c * v + np.sqrt(1 - c * c) * other / np.linalg.norm(other)))
    rows += [(2000 + i, base[499] + rng.normal(size=64) * 0.05) for i in range(700)]  # more than a block, a third of all
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in rows]
    want, got = expected(rows), found(spark, [(i, v, 1, "u") for i, v in rows])
    assert 0 < lengths[0][1] < lengths[0][0]
    pairs = [i for i in want if i < 2000 and i != 499]
    print('recall of pairs', sum(got[i][0] for i in pairs) / sum(want[i][0] for i in pairs))
    assert sum(got[i][0] for i in pairs) >= 0.9 * sum(want[i][0] for i in pairs)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    hot = [i for i in want if i >= 2000]
    assert all(got[i] == want[i] for i in hot)


def test_recall_at_the_threshold_where_vectors_share_a_direction(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    n, planted = 12_000, 400
    base = unit(np.sqrt(0.7) * unit(rng.normal(size=64)) + np.sqrt(0.3) * unit(rng.normal(size=(n, 64))))  # mean cosine 0.7
    a, b = base[:planted], base[planted : 2 * planted]
    c = rng.uniform(0.90, 0.92, size=(planted, 1))
    rows = np.float32(np.concatenate([base, c * a + np.sqrt(1 - c * c) * unit(b - (a * b).sum(1, keepdims=True) * a)]))
    units = unit(rows.astype(np.float64))
    want = np.concatenate([(units[i : i + 2000] @ units.T >= 0.9).sum(1) - 1 for i in range(0, len(units), 2000)])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows), pa.list_(pa.float32()))})).repartition(4)
    got = np.array([r["n_links"] for r in pivot_index.near_vectors(df).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum()
    assert got[n:].sum() >= 0.97 * want[n:].sum() and (want[n:] > 0).mean() > 0.9


@pytest.fixture
def lengths(monkeypatch):
    """What prefix_length gave, call by call: (pivots, length, shared)."""
    seen, real = [], pivot_index.prefix_length

    def noted(units, centre, pivots, *more):
        out = real(units, centre, pivots, *more)
        seen.append((len(pivots), *out))
        return out

    monkeypatch.setattr(pivot_index, "prefix_length", noted)
    return seen


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_small_tables_go_through_the_index(spark, lengths, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = {r["vec_id"]: r["n_links"] for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(lengths) == 1 and 0 < lengths[0][1] < lengths[0][0] / 2  # lists, none of all vectors
    units = np.array([pivot_index.unit(v) for _, v in rows])
    want = dict(zip([i for i, _ in rows], (units @ units.T >= 0.9).sum(1) - 1, strict=True))
    assert sum(got.values()) >= 0.98 * sum(want.values()) and all(got[i] <= want[i] for i in got)


def test_a_table_whose_vectors_nearly_all_link_is_indexed_too(spark, lengths):
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    v = np.float32(unit(np.sqrt(0.93) * np.eye(64)[0] + np.sqrt(0.07) * unit(rng.normal(size=(1500, 64)))))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(list(v), pa.list_(pa.float32()))}))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivot_index.near_vectors(df).collect()}
    units = unit(v.astype(np.float64))
    want = (units @ units.T >= 0.9).sum(1) - 1
    assert lengths[0][1] < lengths[0][0] and sum(n for n, _ in got.values()) >= 0.95 * want.sum() > 0
    assert {c for _, c in got.values()} == {0}


def test_prefixes_are_as_long_as_the_table_needs():
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    lengths = []
    shared = []
    for share in (0.0, 0.7, 0.97):
        v = unit(np.sqrt(share) * np.eye(64)[0] + np.sqrt(1 - share) * unit(rng.normal(size=(3000, 64))))
        centre = v.mean(0)
        pivots = pivot_index.choose_pivots(pivot_index.centred(v, centre), 1500)
        assert len(pivots) == 1500
        length, n = pivot_index.prefix_length(v, centre, pivots, 0.9, 2, pivot_index.PREFIX)
        lengths.append(length)
        shared.append(n)
    assert pivot_index.PREFIX <= lengths[0] < lengths[1] <= lengths[2] <= 2.5 * 1500**0.5 + 1
    assert shared == [2, 2, 1]  # where nearly all vectors link, one shared pivot must do
    few = pivot_index.choose_pivots(pivot_index.centred(v, centre), 5)
    assert pivot_index.prefix_length(v, centre, few, 0.9, 2, pivot_index.PREFIX)[0] == 5


def test_prefixes_and_labels():
    pivots = np.eye(4)
    assert pivot_index.prefixes(np.array([[0.1, 0.9, 0.3, 0.3]]), pivots, 3).tolist() == [[1, 2, 3]]
    assert pivot_index.choose_pivots(np.array([[1.0, 0.0], [0.99, 0.14], [0.0, 1.0]]), 3).tolist() == [[1.0, 0.0], [0.0, 1.0]]
    chain = np.zeros((6, 6), bool)
    for a, b in ((5, 4), (4, 3), (3, 1)):
        chain[a, b] = chain[b, a] = True
    assert block_labels(chain).tolist() == [0, 1, 2, 1, 1, 1]
