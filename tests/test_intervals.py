"""Points inside spans: the sweep and the join of all pairs against loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from statutegrid.operators import intervals as I
from statutegrid.plans import catalog

SF = "/root/testdata/sf0.001"


def made(spark, seed, n_spans, n_points, long=300):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "b", "hot", "hot", "hot", None])
    spans = [(key(), s := rng.randrange(long), s + rng.choice([0, 1, 5, 40, long]), i) for i in range(n_spans)]
    points = [(key(), rng.choice([None, *range(long)]), f"v{i % 7}") for i in range(n_points)]
    spans += [("a", None, 5, 900), ("none", 1, 9, 901), spans[0], spans[0]]
    points += [points[1], points[1]]
    return spans, points, spark.createDataFrame(spans, "k string, start int, end int, id int"), spark.createDataFrame(points, "k string, position int, verb string")


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16])
def test_first_points_are_those_of_a_loop(spark, width):
    for seed, n in ((1, 60), (2, 5), (3, 200)):
        spans, points, s, p = made(spark, seed, n, n)
        got = sorted((repr((r["k"], r["start"], r["end"], r["id"])), None if r["point"] is None else tuple(r["point"])) for r in I.first_inside(s, p, "k", width).collect())
        want = []
        for k, a, b, i in spans:
            inside = [(x, v) for q, x, v in points if k is not None and q == k and x is not None and a is not None and a <= x < b]
            want.append((repr((k, a, b, i)), min(inside) if inside else None))
        assert got == sorted(want, key=lambda x: (x[0], repr(x[1]))) or sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [1, 16, 1024])
def test_all_pairs_are_those_of_a_loop(spark, width):
    spans, points, s, p = made(spark, 4, 80, 80)
    got = sorted(repr((r["k"], r["start"], r["end"], r["id"], r["position"], r["verb"])) for r in I.all_inside(s, p, "k", width).collect())
    want = [repr((k, a, b, i, x, v)) for k, a, b, i in spans for q, x, v in points if k is not None and q == k and x is not None and a is not None and a <= x < b]
    assert got == sorted(want)


def test_empty_tables(spark):
    _, _, s, p = made(spark, 5, 10, 10)
    assert I.first_inside(s.limit(0), p, "k").count() == 0 and I.all_inside(s, p.limit(0), "k").count() == 0
    assert all(r["point"] is None for r in I.first_inside(s, p.limit(0), "k").collect())


def test_one_long_document_is_many_windows_and_a_sort(spark):
    def seconds(n):
        spans = spark.range(n).select(F.lit("d").alias("k"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 5000).cast("int").alias("end"))
        points = spark.range(n).select(F.lit("d").alias("k"), (F.col("id") * 10 + 3).cast("int").alias("position"), F.lit("v").alias("verb"))
        began = time.time()
        found = I.first_inside(spans, points, "k", 1 << 14).agg(F.count("point"), F.min(F.col("point.position") - F.col("start")), F.max(F.col("point.position") - F.col("start"))).first()
        assert tuple(found) == (n, 3, 3)
        return time.time() - began

    seconds(1000)
    few, many = seconds(100_000), seconds(800_000)
    assert many <= 16 * few + 2


def test_each_way_to_a_span_s_verb_is_taken(spark, ):
    rows = catalog.QUERIES["model_candidates"](spark, SF).select("aim_text_candidate", "aim_trigger_candidate").collect()
    from statutegrid.operators import verbs as V

    own = spark.createDataFrame([(r[0], r[1]) for r in rows], "span string, verb string").select("span", "verb", F.size(V.extract_aims(F.col("span"), F.lit("es"))).alias("own"), V.first_verb(F.col("span"), F.lit("es"))["verb"].alias("any"))
    ways = {("own" if r["own"] else "inside" if r["verb"] and r["verb"] != r["any"] else "any" if r["verb"] else "none") for r in own.collect()}
    assert {"own", "none"} <= ways
    from types import SimpleNamespace

    import statutegrid

    def load():
        class Model:
            def predict(self, text):
                return SimpleNamespace(spans=[(0, 12, text[:12])], count=1, confidence=0.9)

        return Model()

    texts = ["Deben pagar la cuota siempre.", "Los viejos aprobarán la cuota.", "El agua es de todos siempre.", "Nada de nada en este lugar."]
    blocks = spark.createDataFrame([(f"d{n}", f"{n}. x.md", 0, None, t) for n, t in enumerate(texts)], "doc_id string, source_base string, block_no int, page int, text string")
    found = {r["doc_id"]: r["aim_trigger_candidate"] for r in statutegrid.run(blocks, "es", load)[0].collect()}
    assert found == {"d0": "Deben", "d1": "aprobarán", "d2": "es", "d3": ""}


def test_dear_spans_and_points_are_worked_out_once(spark):
    spans = spark.createDataFrame([(1, 0, 10)], "k int, start int, end int")
    points = spark.createDataFrame([(1, "abc")], "k int, t string").select("k", F.length(F.md5(F.col("t").cast("binary"))).alias("position"))
    found = I.first_inside(spans, points.withColumn("position", F.col("position") - 30), "k")
    assert [r["point"]["position"] for r in found.collect()] == [2]
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
