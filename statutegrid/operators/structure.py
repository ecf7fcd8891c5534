"""Row-level structure: block classes, references, headings, list markers. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P
from statutegrid.functions.text import found, let, lines, matches, rstrip, strip

#: A noncharacter: texts that are interchanged hold none, while control characters do occur.
SPLIT = "\ufdd0"


def strip_comments(text: Column) -> Column:
    return strip(F.regexp_replace(text, P.HTML_COMMENT, " "))


def classify_block(text: Column) -> Column:
    """SKIP, METADATA or RELEVANT; skipping wins, blank text is skipped."""
    bare = strip(text)
    return (
        F.when((bare == "") | matches(bare, P.start(P.SKIP)), "SKIP").when(matches(bare, P.start(P.METADATA)), "METADATA").otherwise("RELEVANT")
    )


def skip_subtype(text: Column) -> Column:
    bare = strip(text)
    return F.when(matches(bare, P.start(P.SIGNATURE)), "signature").when(matches(bare, "^" + P.ANNEX), "annex").otherwise("preamble")


def metadata_subtype(text: Column) -> Column:
    return F.when(matches(strip(text), "^" + P.ANNEX), "annex").otherwise("heading")


def article_ref(text: Column) -> Column:
    """struct(title, chapter, article) of the first references anywhere; an article wins over a section."""
    def clean(c: Column) -> Column:
        return F.regexp_replace(strip(c), r"\.+$", "")

    es, en = found(text, P.CHAPTER_REF_ES), found(text, P.CHAPTER_REF_EN)
    # of both kinds of chapter the one that comes first counts
    first_es = F.regexp_instr(text, F.lit(P.java(P.CHAPTER_REF_ES))) < F.regexp_instr(text, F.lit(P.java(P.CHAPTER_REF_EN)))
    chapter = F.when(es.isNull(), en).when(en.isNull() | first_es, es).otherwise(en)
    return F.struct(
        clean(found(text, P.TITLE_REF)).alias("title"), clean(chapter).alias("chapter"),
        strip(F.coalesce(found(text, P.ARTICLE_REF), found(text, P.SECTION_REF))).alias("article"),
    )


def page_blocks(text: Column) -> Column:
    """A text of more than PAGE_BLOCK_CHARS cut before each reference; blank parts go."""
    marked = F.regexp_replace(text, P.java(r"(?<!\w)" + P.CUT_POINT), SPLIT + "$0")
    parts = F.filter(F.transform(F.split(marked, SPLIT), strip), lambda x: x != "")
    return F.when(F.length(text) > P.PAGE_BLOCK_CHARS, parts).otherwise(F.array(text))


def inline_article(text: Column) -> Column:
    """struct(ref, body): an article mark at the start and its text, if more than INLINE_BODY_CHARS follow; else (text, '')."""
    bare = strip(text)
    return let(bare, lambda b: let(F.regexp_extract(b, P.java(P.INLINE_ARTICLE), 0), lambda mark: _inline_article(b, mark)))


def _inline_article(bare: Column, mark: Column) -> Column:
    rest = strip(F.substr(bare, F.length(mark) + 1))
    rest = F.when(rest.startswith("."), strip(F.substr(rest, F.lit(2)))).otherwise(rest)
    split = (mark != "") & (F.length(rest) > P.INLINE_BODY_CHARS)
    ref = F.regexp_replace(strip(mark), r"[.–-]+$", "")
    return F.struct(F.when(split, ref).otherwise(bare).alias("ref"), F.when(split, rest).otherwise("").alias("body"))


def heading_body(text: Column) -> Column:
    """struct(heading, body): the text up to an inline article's body, else the first line of a long text of several, else all."""
    return let(inline_article(text)["body"], lambda body: let(lines(text), lambda parts: _heading_body(text, body, parts)))


def _heading_body(text: Column, body: Column, parts: Column) -> Column:
    many = (F.size(F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)) > 1) & (F.length(text) > P.HEADING_CHARS)
    by_line = F.struct(strip(parts[0]).alias("heading"), strip(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "\n")).alias("body"))
    by_mark = F.struct(strip(F.substr(text, F.lit(1), F.length(text) - F.length(body))).alias("heading"), body.alias("body"))
    return F.when(body != "", by_mark).when(many, by_line).otherwise(F.struct(text.alias("heading"), F.lit("").alias("body")))


def is_item(line: Column) -> Column:
    return matches(line, P.LINE_ITEM)


def marker_family(text: Column) -> Column:
    out = F.when(F.lit(False), "")
    for family, pattern in P.FAMILIES:
        out = out.when(matches(text, pattern), family)
    return out.otherwise("bullet")


def block_pieces(text: Column) -> Column:
    """array of (kind, text): items and texts by physical line; a line that begins in lower case goes on the one before.

    Each line gets a mark before it that tells what it begins, a line that goes on a blank instead; one split follows, no fold.
    """
    bare = F.filter(F.transform(lines(text), strip), lambda x: x != "")

    def marked(line: Column, i: Column) -> Column:
        goes_on = (i > 0) & line.rlike(r"^\p{IsLowercase}") & ~is_item(line)
        return F.concat(F.when(is_item(line), "\u001ei").when(goes_on, " ").otherwise("\u001et"), line)

    parts = F.filter(F.split(F.array_join(F.transform(bare, marked), ""), "\u001e"), lambda x: x != "")
    return F.transform(
        parts, lambda x: F.struct(F.when(x.startswith("i"), "item").otherwise("text").alias("kind"), F.substr(x, F.lit(2)).alias("text"))
    )


def inline_list(text: Column) -> Column:
    """struct(header, items) of 'header: a) one; b) two' in one line; null unless a colon ends the header and two items follow.

    A marker counts at the start or right after one of : ; . and blanks; blanks before it belong to the item.
    """
    marked = F.split(F.regexp_replace(text, r"(?U)(^|[:;.])(?=\s*" + P.INLINE_ITEM + ")", f"$1{SPLIT}"), SPLIT)

    def judged(parts: Column) -> Column:
        items = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")
        return F.when((F.size(items) >= 2) & parts[0].endswith(":"), F.struct(parts[0].alias("header"), items.alias("items")))

    return let(F.transform(marked, strip), judged)


def ends_with_colon(text: Column) -> Column:
    return rstrip(text).endswith(":")
