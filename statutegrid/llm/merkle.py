"""Operator 12, Merkle manifest of a dataset.

A row is a leaf; leaves of a group stand in the order of their ids, and every few consecutive nodes become one of the level above. A level is one window,
partitioned by group and parent's place: the ordered list over the whole frame is the parent's preimage and, left and right of a node, its siblings.
Of each run one row goes on as the parent. On the way down a node hands its path to its children, so a level is joined to the next by the
parent's place: no more than a run's nodes share a key, however large the group, and all joins together move no more than half as many paths as there are leaves.
The groups' roots, in the order of the groups, are the leaves of one more tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statutegrid.llm.common import column, crc_table, cut, places, table

ARITY = 3
PATH = "array<struct<left:binary,right:binary>>"


def encoded(value: Column) -> Column:
    """A field as text: its bytes' number, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def proof(path: Column) -> Column:
    """Digest of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def _levels(nodes: DataFrame, arity: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Each level's nodes that have a parent (group, at, parent, left, right; row on the first), and all groups' roots (group, level, root).

    nodes (group, at, of: nodes of the group, digest, row), written by `cut`.
    """
    levels, tops = [], []
    largest = nodes.agg(F.coalesce(F.max("of"), F.lit(0))).first()[0]
    while True:
        tops.append(nodes.where("of = 1").select("group", F.lit(len(levels)).alias("level"), F.col("digest").alias("root")))
        if largest <= 1:
            break
        largest = -(-largest // arity)
        more = nodes.where("of > 1")
        whole = Window.partitionBy("group", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = more.withColumn("parent", F.expr(f"at div {arity}")).withColumn("run", F.collect_list("digest").over(whole))
        place = (F.col("at") % arity).cast("int")
        side = lambda low, n: F.unhex(F.array_join(F.slice("run", low, n), ""))
        level = cut(
            found.select(
                "group", "at", "of", "parent", side(1, place).alias("left"), side(place + 2, arity).alias("right"),
                F.when(place == 0, F.sha2(F.array_join("run", ""), 256)).alias("above"), *[c for c in nodes.columns if c == "row"],
            ),
            f"{label}-level",
        )
        levels.append(level.drop("of", "above"))
        # one row of each run goes on: the first, which holds the parent's digest
        parents = level.where("above IS NOT NULL")
        nodes = parents.select("group", F.col("parent").alias("at"), F.ceil(F.col("of") / arity).cast("long").alias("of"), F.col("above").alias("digest"))
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return levels, cut(roots, f"{label}-roots")


def _paths(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame) -> DataFrame:
    """(row, root, path) of all leaves. tops (group, level, root, path): each group's root, the level it stands on and the path above it."""
    own = lambda n: tops.where(F.col("level") == n).select("group", F.lit(0).cast("long").alias("at"), "root", "path")
    above = own(len(levels))
    step = F.array(F.struct("left", "right")).cast(PATH)
    for n in range(len(levels) - 1, -1, -1):
        above = above.withColumnsRenamed({"group": "_group", "at": "_at"})
        joined = levels[n].join(above, (F.col("group") == F.col("_group")) & (F.col("parent") == F.col("_at")))
        above = joined.select("group", "at", "root", F.concat(step, "path").alias("path"), *["row"] * (n == 0))
        if n:
            above = above.unionByName(own(n))
    single = leaves.where("of = 1").join(own(0).select("group", "root", "path"), "group").select("row", "root", "path")
    return above.select("row", "root", "path").unionByName(single) if levels else single


def manifest(rows: DataFrame, key: Column, group: Column, digest: Column, arity: int = ARITY) -> DataFrame:
    """rows with leaf (digest), subroot, root and path: the siblings (left, right: digests put together, binary) from the leaf up to the root.

    Leaves of a group ascend by key, null first, then by digest; groups by their bytes, null first; a run of one node has a parent too, but a group's only leaf is its
    subroot, and an only group's subroot is the root. Nulls in any column, empty and very long texts are what the digest makes of them; repeated rows
    are leaves of their own and share out their places alike; an empty table gives no rows; input columns named like the four give way, others may have any names.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    kept = [c for c in rows.columns if c not in ("leaf", "subroot", "root", "path")]
    packed = rows.select(F.struct(F.struct(*[column(c) for c in kept]).alias("own"), digest.alias("digest")).alias("row"), group.cast("string").alias("group"), key.alias("key"), digest.alias("digest"))
    leaves = cut(packed, "merkle-leaves")
    placed = places(leaves, ["group"], [F.asc_nulls_first("group"), F.asc_nulls_first("key"), F.asc("digest")], "merkle")
    # a group's name is never null, and tells its value
    nodes = cut(placed.select(encoded(F.col("group")).alias("group"), F.col("_place").alias("at"), F.col("_of").alias("of"), "digest", "row"), "merkle-nodes")
    levels, subroots = _levels(nodes, arity, "merkle")
    value = F.when(F.col("group") != "-", F.expr("substring(group, instr(group, ':') + 1)"))
    listed = places(subroots.withColumn("value", value), [], [F.asc_nulls_first("value")], "merkle-top")
    row = F.struct(F.col("group").alias("name"), "level", F.col("root").alias("subroot"))
    upper = cut(listed.select(F.lit("").alias("group"), F.col("_place").alias("at"), F.col("_of").alias("of"), F.col("root").alias("digest"), row.alias("row")), "merkle-upper")
    top_levels, top = _levels(upper, arity, "merkle-top")
    root = F.lit(top.agg(F.max("root")).first()[0]).cast("string")
    nothing = F.array().cast(PATH)
    tops = _paths(top_levels, top.withColumn("path", nothing), upper).select(F.col("row.name").alias("group"), F.col("row.level").alias("level"), F.col("row.subroot").alias("root"), "path")
    found = _paths(levels, cut(tops, "merkle-tops"), nodes)
    return found.select(
        *[F.col("row.own").getField(c).alias(c) for c in kept], F.col("row.digest").alias("leaf"), F.col("root").alias("subroot"), root.alias("root"), "path"
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of one manifest; every second one by hash is tampered with, and folded again."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    whole, less = leaf(*fields(F.col("text"))), leaf(*fields(F.replace("text", F.lit("\n"), F.lit(""))))
    narrow = docs.select("doc_id", "source", whole.alias("digest"), F.when(hit, less).otherwise(whole).alias("tampered"))
    found = manifest(narrow, F.col("doc_id"), F.col("source"), F.col("digest"))
    folded = found.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, source: str) -> str:
    """CTEs of a tree over source (g, i, n, digest): <name>_nodes (g, level, i, digest, run) and <name>_roots (g, level, root)."""
    return f"""
{name}_levels AS (
  SELECT g, 0 AS level, i, n, digest FROM {source}
  UNION ALL
  SELECT g, level + 1, i // {ARITY}, (n + {ARITY - 1}) // {ARITY}, above FROM
    (SELECT g, level, i, n, sha256(string_agg(digest, '' ORDER BY i) OVER (PARTITION BY g, i // {ARITY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS above FROM {name}_levels WHERE n > 1) WHERE i % {ARITY} = 0),
{name}_roots AS (SELECT g, level, digest AS root FROM {name}_levels WHERE n = 1),
{name}_nodes AS (SELECT g, level, i, n, digest, list(digest) OVER (PARTITION BY g, level, i // {ARITY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {name}_levels)"""


def _climb(name: str, tree: str, start: str) -> str:
    """CTE <name> (id, done, root of start's leaf, preimage): start (id, g, i, other) folded with the leaf's siblings up to its group's root."""
    left, right = f"x.run[:u.i % {ARITY}]", f"x.run[u.i % {ARITY} + 2:]"
    return f"""
{name}_up AS (
  SELECT id, g, 0 AS level, i, other, siblings FROM {start}
  UNION ALL
  SELECT u.id, u.g, u.level + 1, u.i // {ARITY}, sha256(array_to_string(list_concat({left}, [u.other], {right}), '')), u.siblings || array_to_string(list_concat({left}, {right}), '')
  FROM {name}_up u JOIN {tree}_nodes x ON x.g = u.g AND x.level = u.level AND x.i = u.i WHERE x.n > 1),
{name} AS (SELECT u.* FROM {name}_up u JOIN {tree}_roots r ON r.g = u.g AND r.level = u.level)"""


SQL = f"""
WITH RECURSIVE docs AS (SELECT *, row_number() OVER () AS id, replace(text, chr(10), '') AS less, doc_id::VARCHAR AS d FROM documents),
leaves AS (SELECT id, doc_id, source, {_LEAF("text")} AS leaf, {_LEAF("less")} AS other,
    coalesce(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(d)), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda crc, b: xor(crc >> 8, ({crc_table()}::BIGINT[])[xor(crc, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 2 = 0, false) AS hit FROM docs),
base AS (SELECT id, doc_id, {_FIELD.format("source")} AS g, source, leaf AS digest, CASE WHEN hit THEN other ELSE leaf END AS other, '' AS siblings,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
{_tree("low", "base").strip()},
tops AS (SELECT g, g AS name, root AS digest FROM low_roots),
heads AS (SELECT '' AS g, name, digest, row_number() OVER (ORDER BY name <> '-', encode(substr(name, instr(name, ':') + 1))) - 1 AS i, count(*) OVER () AS n FROM tops),
{_tree("high", "heads").strip()},
{_climb("inner_", "low", "base").strip()},
outer_start AS (SELECT u.id, '' AS g, h.i, u.other, u.siblings FROM inner_ u JOIN heads h ON h.name = u.g),
{_climb("outer_", "high", "outer_start").strip()}
SELECT b.doc_id, b.digest AS leaf, r.root AS subroot, t.root, sha256(u.siblings) AS proof_sha256, u.other AS folded_root, u.other = t.root AS verified
FROM base b JOIN low_roots r ON r.g = b.g JOIN outer_ u ON u.id = b.id, high_roots t
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": SQL}
