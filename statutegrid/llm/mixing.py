"""Operator 6, mixing sources to target weights [native].

Each row gets a hash-random key. Keys are uniform, so ranges of equal width are balanced ranges of each
source's order: a source of n rows has ceil(n / rows_per_range) of them. Sizes are summed by range before
anything moves, prefix sums run over groups of ranges and the ranges of a group, and the rows of the one range in which a source's budget ends tell the
row on its cut. Every source is cut at its exact budget: whole epochs first, then the rows below the rest, the row on the cut in part. The cuts, a row
a source, are broadcast, so documents stay where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statutegrid.llm.common import BLANKS, WORD, bounded, column, cut, n_words, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_RANGE, RANGES_PER_GROUP = 2_000, 2_000
SEED = 20_260_101


def random_key(key: Column, seed: int) -> Column:
    """31 bits that the seed and the key decide; by MD5, so that any engine finds the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (_source, _total, _rows; a row a source) with _target.

    Sources by code point, null last, weigh as weights says, repeating. target = min(max_epochs * total, level *
    weight): capping and resharing the excess until none is above ends there. The sources that end capped are those of least total / weight, so the
    level follows from running sums over the sources in that order. One row a source, never one a document.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(n)) + 1).cast("int"))
    cap = F.lit(float(max_epochs)) * F.col("_total")
    ranked = sizes.withColumn("_weight", weight).withColumn("_cap", cap).withColumn("_reach", F.col("_cap") / F.col("_weight"))
    everything = Window.partitionBy()
    upto = Window.orderBy("_reach", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    running = (
        ranked.withColumn("_all", F.sum("_total").over(everything).cast("double"))
        .withColumn("_w", F.sum("_weight").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_capped_w", F.coalesce(F.sum("_weight").over(upto), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_w") - F.col("_capped_w")))
    )
    # the first source in this order that its level does not carry above its cap sets the level for it and all after it
    level = F.min(F.when(F.col("_level") <= F.col("_reach"), F.struct("_reach", "_level"))).over(everything)["_level"]
    return running.select(
        "_source", "_total", "_rows", F.least(F.col("_cap"), F.coalesce(level, F.lit(0.0)) * F.col("_weight")).alias("_target")
    )


def mix(
    df: DataFrame,
    source: Column,
    size: Column,
    key: Column,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    rows_per_range: int = ROWS_PER_RANGE,
    seed: int = SEED,
) -> DataFrame:
    """df with source_size, target (double) and taken (long: size times the row's whole epochs, and what the last epoch takes of it).

    The sums of taken are the rounded targets. A null source is a source of its own, the last; null sizes count
    as 0; rows of equal key are ordered by size, so repeated rows share out alike on every run; an empty table gives an empty
    result; input columns named like the three give way, others may have any names. No row is taken more than max_epochs times.
    """
    kept = [c for c in df.columns if c not in ("source_size", "target", "taken")]
    drawn = df.select(
        F.struct(*[column(c) for c in kept]).alias("row"), source.alias("source"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"),
        key.alias("id"), random_key(key, seed).alias("key"),
    )
    narrow = cut(drawn.select("source", "size", "id", "key"), "mix-sizes")
    sizes = narrow.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("_total"), F.count("*").alias("_rows"))
    budget = F.round("_target").cast("long")
    plan = targets(sizes, weights, max_epochs).select(
        F.col("_source").alias("of"), F.col("_total").alias("total"), F.col("_target").alias("goal"),
        F.when(F.col("_total") > 0, F.floor(budget / F.col("_total"))).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("_total") > 0, budget % F.col("_total")).otherwise(0).cast("long").alias("rest"),
        F.ceil(F.col("_rows") / rows_per_range).cast("long").alias("ranges"),
    )
    plan = bounded(cut(plan, "mix-plan"))

    def ranged(rows: DataFrame) -> DataFrame:
        found = rows.join(plan, rows["source"].eqNullSafe(plan["of"]))
        return found.withColumn("range", F.shiftright(F.col("key") * F.col("ranges"), 31))

    # prefix sums in three steps, so that no task goes through all ranges of a large source: groups of ranges, ranges, rows of one range
    by_range = ranged(narrow).groupBy("source", "range").agg(F.sum("size").alias("sum"))
    by_range = cut(by_range.withColumn("group", F.floor(F.col("range") / RANGES_PER_GROUP)), "mix-ranges")
    below = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, *keys: F.coalesce(F.sum(c).over(below(*keys)), F.lit(0))
    groups = by_range.groupBy("source", "group").agg(F.sum("sum").alias("sum"))
    groups = groups.select(F.col("source").alias("gs"), F.col("group").alias("gg"), before("sum", "source", "group").alias("lower"))
    bases = by_range.select("source", "group", "range", "sum", before("sum", "source", "group", "range").alias("base"))
    bases = bases.join(groups, bases["source"].eqNullSafe(groups["gs"]) & (bases["group"] == groups["gg"])).select(
        F.col("source").alias("bs"), F.col("range").alias("br"), (F.col("base") + F.col("lower")).alias("base"), "sum"
    )
    ends = lambda lower, held: (F.col(lower) <= F.col("rest")) & (F.col("rest") < F.col(lower) + held)
    last = bases.join(plan.select("of", "rest"), bases["bs"].eqNullSafe(plan["of"])).where(ends("base", F.col("sum"))).select("bs", "br", "base")
    last = bounded(cut(last, "mix-last"))
    inside = ranged(narrow).join(last, F.col("source").eqNullSafe(F.col("bs")) & (F.col("range") == F.col("br")))
    # rows of equal key, id and size are one place in the order
    places = inside.groupBy("source", "key", "id", "size").agg(F.count("*").alias("ties"), F.min("base").alias("base"), F.min("rest").alias("rest"))
    held = places["size"] * places["ties"]
    upto = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("lower", F.col("base") + F.coalesce(F.sum(held).over(upto), F.lit(0))).where(ends("lower", held))
    place = F.struct("key", "id", "size")
    places = places.select(F.col("source").alias("ps"), place.alias("edge"), "ties", (F.col("rest") - F.col("lower")).alias("left"))
    cuts = cut(plan.join(places, plan["of"].eqNullSafe(places["ps"]), "left").select("of", "total", "goal", "epochs", "edge", "ties", "left"), "mix-cuts")
    rows = drawn.join(bounded(cuts), drawn["source"].eqNullSafe(cuts["of"]))
    if cuts.where("ties > 1").isEmpty():
        rows = rows.withColumn("nth", F.lit(0))
    else:
        tied = F.coalesce((place == F.col("edge")) & (F.col("ties") > 1), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("of").orderBy("key")) - 1
        rows = rows.where(~tied).withColumn("nth", F.lit(0)).unionByName(rows.where(tied).withColumn("nth", nth))
    on_edge = F.least(F.greatest(F.col("left") - F.col("nth") * F.col("size"), F.lit(0)), F.col("size"))
    part = F.when(place < F.col("edge"), F.col("size")).when(place == F.col("edge"), on_edge).otherwise(0)
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in kept], F.col("total").alias("source_size"), F.col("goal").alias("target"),
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word: the pieces between the ends of words hold one word each."""
    pieces = F.split(text, rf"(?<=[^{BLANKS}])(?=[{BLANKS}])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: one row for each whole epoch, and the cut text for a part; same columns, whatever their names."""
    names = docs.columns
    packed = docs.select(F.struct(*[column(c) for c in names]).alias("row"), n_words(column("text")).alias("words"))
    row, words = F.col("row"), F.col("words")
    rows = mix(packed, row["source"], words, row["doc_id"])
    whole = F.when(words > 0, F.floor(F.col("taken") / words)).otherwise(0).cast("int")
    part = F.when(words > 0, F.col("taken") % words).otherwise(0)
    copies = rows.select("row", whole.alias("whole"), part.alias("part"))
    copies = copies.select("row", "whole", "part", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("copy"))
    copies = copies.where((F.col("copy") < F.col("whole")) | (F.col("part") > 0))
    text = F.when(F.col("copy") < F.col("whole"), row["text"]).otherwise(first_words(row["text"], F.col("part")))
    copies = copies.select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return copies.select(*[new.get(c, row.getField(c)).alias(c) for c in names])


def op6_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes are read more than once: words are counted before
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-words")
    return mix(docs, F.col("source"), F.col("size"), F.col("doc_id")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id)), 1, 8))::BIGINT >> 1 AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS total, {list(map(float, WEIGHTS))}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w FROM docs GROUP BY source),
caps AS (SELECT *, {MAX_EPOCHS}.0::DOUBLE * total AS cap, {MAX_EPOCHS}.0::DOUBLE * total / w AS reach FROM sources),
levels AS (SELECT *, (sum(total) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM caps
  WINDOW b AS (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT source, total, least(cap, coalesce((SELECT min_by(level, reach) FROM levels WHERE level <= reach), 0) * w) AS target FROM levels),
drawn AS (SELECT d.*, total, target, CASE WHEN total > 0 THEN round(target)::BIGINT // total ELSE 0 END AS epochs, CASE WHEN total > 0 THEN round(target)::BIGINT % total ELSE 0 END AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target, (epochs * size + least(greatest(rest - before, 0), size))::BIGINT AS taken FROM drawn
"""

QUERIES = {"op6_mix_to_weights": op6_mix_to_weights}
ORACLES = {"op6_mix_to_weights": SQL}
