import random
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from statutegrid.llm import merkle


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves, arity=3):
    """(root, siblings of each leaf) by loops; siblings as (left, right) a level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for n, p in enumerate(at):
            run, k = runs[p // arity], p % arity
            paths[n].append((run[:k], run[k + 1 :]))
            at[n] = p // arity
        nodes = [digest(*r) for r in runs]
    return nodes[0], paths


def plain_manifest(rows, arity=3):
    """{(key, group, leaf): (subroot, root, path)} of rows (key, group, leaf)."""
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], arity) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order], arity)
    out = {}
    for n, g in enumerate(order):
        for x, path in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.setdefault((x[1] if x[0] else None, g, x[2]), []).append((trees[g][0], root, path + upper[n]))
    return out


def check(found, want):
    rows = found.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof(F.col("path"))).collect()
    got = {}
    for r in rows:
        path = [(s["left"].hex(), s["right"].hex()) for s in r["path"]]
        got.setdefault((r["key"], r["grp"], r["leaf"]), []).append((r["subroot"], r["root"], path))
        assert r["folded"] == r["root"] and r["proof"] == digest(*[a + b for a, b in path])
    flat = {k: sorted((s, t, [("".join(a), "".join(b)) for a, b in p]) for s, t, p in v) for k, v in want.items()}
    assert {k: sorted(v) for k, v in got.items()} == flat


@pytest.mark.parametrize("arity", [2, 3])
def test_against_plain_trees(spark, arity):
    rng = random.Random(arity)
    sizes = {"a": 1, "b": 2, "ä": 3, "B": 4, "": 10, None: 28, "hot": 200, "a:b": 1, "-": 2}
    rows = [(rng.randrange(10_000), g, digest(str(rng.random()))) for g, n in sizes.items() for _ in range(n)]
    rows += [(None, "hot", digest("x")), (None, "hot", digest("y")), (5, "hot", digest("same")), (5, "hot", digest("same"))]
    df = spark.createDataFrame(rows, "key long, grp string, d string").repartition(7)
    check(merkle.manifest(df, F.col("key"), F.col("grp"), F.col("d"), arity), plain_manifest(rows, arity))


def test_one_row_one_group_and_none(spark):
    one = [(7, "g", digest("x"))]
    df = spark.createDataFrame(one, "key long, grp string, d string")
    got = merkle.manifest(df, F.col("key"), F.col("grp"), F.col("d")).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["path"]) for r in got] == [(digest("x"),) * 3 + ([],)]
    empty = merkle.manifest(df.limit(0), F.col("key"), F.col("grp"), F.col("d"))
    assert empty.count() == 0 and empty.columns == ["key", "grp", "d", "leaf", "subroot", "root", "path"]
    with pytest.raises(ValueError):
        merkle.manifest(df, F.col("key"), F.col("grp"), F.col("d"), 1)


def test_any_changed_field_changes_the_root(spark):
    rows = [(i, "s", "en", 4, f"text {i}") for i in range(5)]
    names = "doc_id long, source string, lang string, n_chars long, text string"

    def root(changed):
        df = spark.createDataFrame(changed, names)
        return merkle.manifest(df, F.col("doc_id"), F.col("source"), merkle.leaf(*[F.col(c) for c in df.columns])).first()["root"]

    first = root(rows)
    assert first == root(rows[::-1])
    for other in ((2, "s", "en", 4, "text 2 "), (2, "s", None, 4, "text 2"), (2, "s", "-", 4, "text 2"), (2, "s", "en", None, "text 2"), (2, None, "en", 4, "text 2"), (9, "s", "en", 4, "text 2")):
        assert root([*rows[:2], other, *rows[3:]]) != first


def test_odd_rows(spark, odd_docs, no_docs):
    made = odd_docs.withColumn("d", merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    raw = odd_docs.collect()
    rows = [(r["doc_id"], r["source"], digest(*[field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])) for r in raw]
    found = merkle.manifest(made, F.col("doc_id"), F.col("source"), F.col("d")).withColumnsRenamed({"doc_id": "key", "source": "grp"})
    check(found, plain_manifest(rows))
    assert set(odd_docs.columns) - {"doc_id", "source"} < set(found.columns)


def test_sql_equals_the_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a\nb\n", "no line end", None, "", "x\n"]), rng.choice(["en", None]), rng.choice(["s", "t", "long source", None]), rng.randrange(9)) for i in range(70)]
    rows += [(None, "t\n", "en", "s", 1), (None, "u", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({merkle.SQL})").fetchall()
    got = [tuple(r[c] for c in names) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    told = [r[-1] for r in got]
    assert True in told and False in told
