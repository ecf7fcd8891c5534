"""Blocks to segments: events where the text lies, one exchange by document, windows that share one sort.

Events of a document, in order: X a skipped or heading text, T a sentence, H a sentence that ends with a colon, L the header of a list
inside a line and C its items, I a list item, S an item that ends with a colon. X, T, H, L and S open a run; whether an item still belongs
to the run's header depends on marker families seen in the run so far. Each of these facts is a running value over the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P
from statutegrid.operators import structure as S
from statutegrid.operators.sentences import raw_sentences, split_sentences

COLUMNS = (
    "segment_id", "parent_segment_id", "segment_order", "title", "chapter", "article", "segment_type", "is_list_item", "is_substantive",
    "segment_text",
)
ORDER = ("block_no", "sub_no", "piece_no", "emit_no")
#: Sentences of a text, before fragments are put together.
Boundaries = Callable[[Column], Column]
_NO_REF = "struct<title:string,chapter:string,article:string>"


def _event(kind: str, type_: Column | str, text: Column, ref: Column | None = None, family: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), (F.lit(type_) if isinstance(type_, str) else type_).alias("type"), text.alias("text"),
        (F.lit(None).cast(_NO_REF) if ref is None else ref).alias("ref"), (F.lit(None).cast("string") if family is None else family).alias("family"),
    )


def _sentence_events(text: Column, raw: Boundaries) -> Column:
    return F.transform(
        split_sentences(text, raw),
        lambda s: F.when(s.endswith(":"), _event("H", "list_header", s)).otherwise(_event("T", "body_sentence", s)),
    )


def _text_events(piece: Column, inline: Column, raw: Boundaries) -> Column:
    """Events of a text piece that is neither skipped nor a heading; inline: its list, if it is one."""
    family = S.marker_family(inline["items"][0])
    children = F.transform(inline["items"], lambda x: _event("C", "list_item", x))
    listed = F.concat(F.array(_event("L", "list_header", inline["header"], family=family)), children)
    return F.when(inline.isNotNull(), listed).otherwise(_sentence_events(piece, raw))


def sub_blocks(blocks: DataFrame, ends: bool = False) -> DataFrame:
    """blocks without comments, large ones cut at references: a row a sub-block with its class. ends: and an empty one behind each block, even an empty block."""
    keep = [c for c in blocks.columns if c not in ("text", "page")]
    bare, cut = blocks.withColumn("text", S.strip_comments(F.col("text"))), S.page_blocks(F.col("text"))
    if ends:
        cut = F.concat(F.when(F.col("text") != "", cut).otherwise(F.array()), F.array(F.lit("")))
    else:
        bare = bare.where(F.col("text") != "")
    subs = bare.select(*keep, F.posexplode(cut).alias("sub_no", "text"))
    return subs.withColumn("class", S.classify_block(F.col("text")))


def pieces(subs: DataFrame) -> DataFrame:
    """A row a piece: the sub-block's own heading or skipped text first (piece_no 0), then the pieces of its body."""
    keep = [c for c in subs.columns if c not in ("text", "class")]
    heading = S.heading_body(F.col("text"))
    split = subs.withColumn("_h", F.when(F.col("class") == "METADATA", heading))
    own = F.when(
        F.col("class") == "SKIP", F.array(F.struct(F.lit("skip").alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("whole")))
    ).when(
        F.col("class") == "METADATA",
        F.array(F.struct(F.lit("head").alias("kind"), F.coalesce(F.nullif(F.col("_h.heading"), F.lit("")), "text").alias("text"), F.col("text").alias("whole"))),
    ).otherwise(F.array())
    body = F.when(F.col("class") == "RELEVANT", F.col("text")).when(F.col("class") == "METADATA", F.col("_h.body")).otherwise("")
    split = split.select(*keep, own.alias("_own"), S.block_pieces(body).alias("_pieces"))
    rest = F.transform("_pieces", lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), F.lit(None).cast("string").alias("whole")))
    return split.select(*keep, F.posexplode(F.concat("_own", rest)).alias("piece_no", "p")).select(*keep, "piece_no", "p.kind", "p.text", "p.whole")


def events(rows: DataFrame, raw: Boundaries = raw_sentences) -> DataFrame:
    """pieces as event rows (kind, type, text, ref, family)."""
    keep = [c for c in rows.columns if c not in ("kind", "text", "whole")]
    text = F.col("text")
    classed = rows.withColumn("_class", F.when(F.col("kind") == "text", S.classify_block(text)))
    split = classed.withColumn("_h", F.when(F.col("_class") == "METADATA", S.heading_body(text)))
    heading = _event("X", S.metadata_subtype(text), F.coalesce(F.nullif(F.col("_h.heading"), F.lit("")), text), S.article_ref(text))
    body = F.when(F.col("_class") == "METADATA", F.col("_h.body")).otherwise(text)
    flat = F.when((F.col("kind") == "text") & (F.col("_class") != "SKIP"), F.replace(body, F.lit("\n"), F.lit(" ")))
    split = split.withColumn("_body", flat).withColumn("_inline", S.inline_list(F.col("_body")))
    after = F.when(F.col("_body") != "", _text_events(F.col("_body"), F.col("_inline"), raw)).otherwise(F.array())
    item = F.when(S.ends_with_colon(text), F.array(_event("S", "list_header", text, family=S.marker_family(text)))).otherwise(
        F.array(_event("I", "list_item", text, family=S.marker_family(text)))
    )
    found = (
        F.when(F.col("kind") == "skip", F.array(_event("X", S.skip_subtype(text), text)))
        .when(F.col("kind") == "head", F.array(_event("X", S.metadata_subtype(F.col("whole")), text, S.article_ref(F.col("whole")))))
        .when(F.col("kind") == "item", item)
        .when(F.col("_class") == "SKIP", F.array(_event("X", S.skip_subtype(text), text)))
        .when(F.col("_class") == "METADATA", F.concat(F.array(heading), after))
        .otherwise(after)
    )
    return split.select(*keep, F.posexplode(found).alias("emit_no", "e")).select(*keep, "emit_no", "e.*")


def list_state(rows: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """event rows with run, opener (kind of the run that they are judged in), closed and splits (a closed long item: its sentences are body text)."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("kind").isin("X", "T", "H", "L", "S")
    item = F.col("kind") == "I"
    opener = F.struct(F.col("kind").alias("kind"), F.when(F.col("kind") == "L", F.col("family")).alias("family"))
    first = (
        rows.withColumn("run", F.sum(F.when(opens, 1).otherwise(0)).over(upto))
        .withColumn("_opener", F.last(F.when(opens, opener), ignorenulls=True).over(before))
    )
    second = first.withColumn("_seen", F.last(F.when(item, F.col("run")), ignorenulls=True).over(before))
    begins = item & (F.col("_seen").isNull() | (F.col("_seen") != F.col("run")))
    # a header S is judged in the run before its own, which is that of the row before it
    judged = F.when(F.col("kind") == "S", F.col("run") - 1).otherwise(F.col("run"))
    third = second.withColumn("_judged", judged).withColumn(
        "_first", F.last(F.when(begins, F.struct(F.col("run").alias("run"), F.col("family").alias("family"))), ignorenulls=True).over(upto)
    )
    family = F.coalesce(F.col("_opener.family"), F.when(F.col("_first.run") == F.col("_judged"), F.col("_first.family")))
    fourth = third.withColumn("_family", family).withColumn("_differs", F.col("kind").isin("I", "S") & F.coalesce(F.col("family") != F.col("_family"), F.lit(False)))
    # the last item that differed, up to this row for items, before it for headers; a header's own family counts by _differs
    broke = F.last(F.when(item & F.col("_differs"), F.col("run")), ignorenulls=True)
    fifth = fourth.withColumn("_broke", broke.over(upto))
    open_ = F.coalesce(F.col("_opener.kind").isin("H", "L", "S"), F.lit(False))
    closed = ~open_ | F.col("_differs") | F.coalesce(F.col("_broke") == F.col("_judged"), F.lit(False))
    closed = F.when(F.col("kind").isin("I", "S"), closed)
    splits = F.coalesce(item & closed & (F.length("text") >= P.PARAGRAPH_ITEM_CHARS), F.lit(False))
    helpers = ("_opener", "_seen", "_judged", "_first", "_family", "_differs", "_broke")
    return fifth.withColumn("opener", F.col("_opener.kind")).withColumn("closed", closed).withColumn("splits", splits).drop(*helpers)


def number(rows: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ORDER, raw: Boundaries = raw_sentences, parents: bool = False) -> DataFrame:
    """list_state's rows as segments: long paragraphs split, numbered, with parents (parents: and their texts) and the references in force."""
    keep = [c for c in rows.columns if c not in ("kind", "type", "text", "ref", "family", "run", "opener", "closed", "splits")]
    texts = F.when(F.col("splits"), split_sentences(F.col("text"), raw)).otherwise(F.array("text"))
    spread = rows.select("*", F.posexplode(texts).alias("part_no", "segment_text")).withColumn("type", F.when(F.col("splits"), "body_sentence").otherwise(F.col("type")))
    window = Window.partitionBy(key).orderBy(*order, "part_no")
    upto, before = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("kind").isin("X", "T", "H", "L", "S")
    numbered = spread.withColumn("segment_order", F.row_number().over(window)).withColumns(
        {c: F.last(F.col(f"ref.{c}"), ignorenulls=True).over(upto) for c in ("title", "chapter", "article")}
    )
    # a parent's place and, where asked for, its text, from the window that finds it: no join
    named = F.struct("segment_order", *([F.col("segment_text").alias("text")] if parents else []))
    linked = numbered.withColumn("_header", F.last(F.when(opens, named), ignorenulls=True).over(before)).withColumn(
        "_paragraph", F.last(F.when(F.col("splits"), F.struct("run", named.alias("at"))), ignorenulls=True).over(before)
    )
    body = F.when(F.col("_paragraph.run") == F.col("run"), F.col("_paragraph.at")).when(F.col("opener") == "T", F.col("_header"))
    parent = (
        F.when(F.col("kind") == "C", F.col("_header"))
        .when(F.col("kind").isin("I", "S") & ~F.col("closed"), F.col("_header"))
        .when((F.col("kind") == "I") & ~F.col("splits"), body)
    )
    id_ = lambda n: F.format_string("seg_%04d", n)
    return linked.select(
        *[c for c in keep if c not in order], id_(F.col("segment_order")).alias("segment_id"), F.when(parent.isNotNull(), id_(parent["segment_order"])).alias("parent_segment_id"),
        "segment_order", "title", "chapter", "article", F.col("type").alias("segment_type"), (F.col("type") == "list_item").alias("is_list_item"),
        F.col("type").isin(*P.SUBSTANTIVE).alias("is_substantive"), "segment_text", *([parent["text"].alias("parent_text")] if parents else []),
    )


def segment(blocks: DataFrame, raw: Boundaries = raw_sentences, parents: bool = False) -> DataFrame:
    """blocks (doc_id, ..., block_no, page, text) as segments; columns that come with doc_id stay. parents: with parent_text."""
    return number(list_state(events(pieces(sub_blocks(blocks)), raw)), raw=raw, parents=parents)


def parent_text(segments: DataFrame) -> DataFrame:
    """Segments read back from tables with the text of their parents: an equi-join by document and id. `segment` finds it without."""
    parents = segments.select("doc_id", F.col("segment_id").alias("parent_segment_id"), F.col("segment_text").alias("parent_text"))
    return segments.join(parents, ["doc_id", "parent_segment_id"], "left")


