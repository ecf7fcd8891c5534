import zlib

import pytest
from pyspark.sql import functions as F

from statutegrid.llm import sharding


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(shards))
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize("per_bin", [10**6, 100])
def test_bytes_are_near_equal_with_a_hot_group(spark, per_bin):
    rows = [(i, f"text {i if i % 3 else 0}", 50 + i % 7, 9, "z") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, shard int, slot string").repartition(5)
    run = lambda d: sharding.shard_by_bytes(d, F.col("text"), F.col("doc_id"), F.col("size"), 8, rows_per_bin=per_bin)
    got = run(df).collect()
    assert len(got) == 6000
    check(got, 8)
    total = sum(r[2] for r in rows)
    for s in range(8):
        assert abs(sum(r["size"] for r in got if r["shard"] == s) - total / 8) <= 2 * (total / 8 * sharding.TOLERANCE + 56)
    assert sorted(map(tuple, got)) == sorted(map(tuple, run(df.repartition(3)).collect()))
    shards = {}
    for r in got:
        if r["text"] != "text 0":
            shards.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_splitters_against_a_sorted_list(spark):
    rows = [(i, f"t{i % 700 if i % 5 else 1}", 10 + (i * 7919) % 400) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    placed = sharding.shard_by_bytes(df, F.col("text"), F.col("doc_id"), F.col("size"), 16)
    keyed = placed.select("*", F.xxhash64("text").alias("g"), F.xxhash64("doc_id", F.lit("row")).alias("r")).collect()
    order = sorted(keyed, key=lambda r: (r["g"] % 2**64, r["r"] % 2**64))
    shards = [r["shard"] for r in order]
    assert shards == sorted(shards)  # shards are ranges of the order
    total, largest = sum(r[2] for r in rows), max(r[2] for r in rows)
    ends, below, groups = [0], 0, {}
    for r in order:
        below += r["size"]
        ends.append(below)
        groups[r["g"]] = groups.get(r["g"], 0) + r["size"]
    below, cuts = 0, {}
    for n, r in enumerate(order):
        if n and r["shard"] != order[n - 1]["shard"]:
            for j in range(order[n - 1]["shard"] + 1, r["shard"] + 1):
                cuts[j] = (below, r["g"] == order[n - 1]["g"], r["g"])
        below += r["size"]
    near = total / 16 * sharding.TOLERANCE
    for j, (at, inside, group) in cuts.items():
        best = min(abs(e - total * j / 16) for e in ends)
        assert abs(at - total * j / 16) <= max(best, near, largest)
        if inside:  # only a group larger than any row is cut
            assert groups[group] > max(near, largest)


def test_odd_rows_and_few_rows(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op10_histogram_shards(spark, str(tmp_path)).collect()
    check(got, 40)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    place = {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    assert place[8][0] == place[9][0]  # equal texts
    assert sharding.shard_by_bytes(no_docs, F.col("text"), F.col("doc_id"), F.lit(1)).count() == 0
    same = spark.createDataFrame([(1, "x")] * 50, "doc_id long, text string")  # nothing tells the rows apart
    check(sharding.shard_by_bytes(same, F.col("text"), F.col("doc_id"), F.lit(1), 4).collect(), 4)


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id long, text string")
    sharding.write_shards(sharding.shard_by_bytes(df, F.col("text"), F.col("doc_id"), F.lit(1), 4), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 100 and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_a_hot_group_fills_its_shards_bins_alike(spark):
    df = spark.range(30_000).select(F.lit(7).cast("long").alias("_group"), F.xxhash64("id", F.lit("row")).alias("_row"), F.lit(10).cast("long").alias("_size"))
    splitters = sharding.plan_splitters(df, 10, 0.002)
    bits, wanted = 5, 100  # 3,000 rows a shard
    counts = df.groupBy(sharding.shard_of(splitters).alias("s"), sharding.bin_of(bits).alias("b")).count().collect()
    assert len(counts) == 10 * 2**bits and max(r["count"] for r in counts) <= 2 * wanted
