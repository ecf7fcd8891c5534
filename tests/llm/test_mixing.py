import pytest
from pyspark.sql import functions as F

from statutegrid.llm import mixing
from tests.llm.brute import WORDS


def reshared(sizes, weights=(5, 2, 1), most=3):
    """Targets by capping and resharing, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        total = sum(w[s] for s in free)
        share = {s: left * w[s] / total for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return share | fixed
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 500, "c": 7, "d": 300, None: 2}, {"é": 0, "z": 5, "": 9}, {"x": 0}, {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 1}])
def test_targets_against_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "_source string, _total long, _rows long")
    got = {r["_source"]: r["_target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_mix_meets_budgets_and_reruns_agree(spark):
    rows = [(i, ["hot", "b", "c", None][0 if i % 3 else i % 4], 1 + i * 37 % 90, "t", 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size int, taken string, target double")
    run = lambda n: mixing.mix(df.repartition(n), F.col("source"), F.col("size"), F.col("doc_id"), rows_per_range=50)
    got = run(3).collect()
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(run(7).collect(), key=lambda r: r["doc_id"])
    sizes = {s: sum(r[2] for r in rows if r[1] == s) for s in {r[1] for r in rows}}
    for s, target in reshared(sizes).items():
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == round(target) and own[0]["target"] == pytest.approx(target) and own[0]["source_size"] == sizes[s]
        assert sum(r["taken"] % r["size"] > 0 for r in own) <= 1  # one row on the cut
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and len(got) == 3000


def test_documents_are_repeated_and_cut(spark, odd_docs, no_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    sizes = {}
    for r in odd_docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORDS.findall(r["text"] or ""))
    taken = {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORDS.findall(r["text"] or ""))
        assert any(i == r["doc_id"] and (t or "").startswith(r["text"] or "") for i, t in texts)
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    for s, target in reshared(sizes).items():
        assert taken.get(s, 0) == round(target)
    assert mixing.mixed_documents(no_docs).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n\nc  d ", n) for n in range(6)], "text string, n int")
    got = [r[0] for r in df.orderBy("n").select(mixing.first_words(F.col("text"), F.col("n"))).collect()]
    assert got == ["", "  a", "  a b", "  a b\n\nc", "  a b\n\nc  d", "  a b\n\nc  d "]


def plain_taken(rows, sources):
    """What each row (id, source, size) takes, by one loop over a source's rows in their order; sorted."""
    import hashlib

    key = lambda i: int(hashlib.md5(":".join([str(mixing.SEED), *([] if i is None else [str(i)])]).encode()).hexdigest()[:8], 16) >> 1
    out = []
    for s, target in reshared({s: sum(r[2] for r in rows if r[1] == s) for s in sources}).items():
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (key(r[0]), r[0] is not None, r[0] or 0, r[2]))
        total = sum(r[2] for r in own)
        epochs, rest = divmod(round(target), total) if total else (0, 0)
        for r in own:
            out.append((str(r), epochs * r[2] + (part := min(rest, r[2]))))
            rest -= part
    return sorted(out)


@pytest.mark.parametrize("ids, rows_per_range", [(4000, 40), (4000, 10**6), (3, 40), (1, 40)])
def test_documents_stay_where_they_lie_and_rows_take_what_a_loop_gives(spark, ids, rows_per_range):
    """Ids that name rows, and so few ids that many rows share the place on the cut; null ids, sources without words."""
    rows = [(None if ids < 4000 and i % 7 == 0 else i % ids, ["hot", "b", None, "none"][0 if i % 3 else i % 4], 0 if i % 12 == 3 else 5 + (i % 2 if ids > 1 else 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size int").repartition(3)
    got = mixing.mix(df, F.col("source"), F.col("size"), F.col("doc_id"), rows_per_range=rows_per_range)
    found = sorted((str((r["doc_id"], r["source"], r["size"])), r["taken"]) for r in got.collect())
    assert found == plain_taken(rows, {r[1] for r in rows})
    if ids == 4000:
        df.write.mode("overwrite").parquet(path := mixing.cut(df, "mix-test").inputFiles()[0].rsplit("/", 1)[0] + "-in")
        plan = mixing.mix(spark.read.parquet(path), F.col("source"), F.col("size"), F.col("doc_id"))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
