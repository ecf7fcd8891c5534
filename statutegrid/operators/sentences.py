"""Sentences: a boundary rule, then a fold that puts legal fragments back together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P
from statutegrid.functions.text import let, matches, strip

#: Noncharacters: where a text is cut, and a point that ends no sentence.
BREAK, POINT = "\ufdd1", "\ufdd2"
CHUNK = 256
#: The list is gone through only before a word of its lengths and a point.
ABBREVIATED = P.ABBREVIATED.replace(r"(^|[^\pL])", rf"(^|[^\pL])(?=\pL{{1,{max(map(len, P.ABBREVIATIONS))}}}\.)", 1)
#: Longer buffers match neither rule about what a label or a short heading takes.
KNOWN = 64


def raw_sentences(text: Column) -> Column:
    """Cut behind . ! ? and blanks, but not behind an abbreviation or an initial."""
    # twice, as the sign before an initial may be the point of the one before it
    kept = text
    for _ in range(2):
        kept = F.regexp_replace(kept, ABBREVIATED, "$1$2" + POINT)
    parts = F.split(F.replace(F.regexp_replace(kept, "(?U)" + P.SENTENCE_END, "$1" + BREAK), F.lit(POINT), F.lit(".")), BREAK)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def merge_fragments(sentences: Column) -> Column:
    """A bare label or short heading takes the next sentence; items, lower-case, numbered or short fragments go on the one before.

    The decision looks at all that has been put together since the last break, but only while that is short; so a fold over marks, chunk by
    chunk, with a short text for its state, then one join and one split. Time grows in proportion to the text.
    """

    def step(state: Column, sentence: Column) -> Column:
        fragment = (
            matches(sentence, P.SENTENCE_ITEM)
            | matches(sentence, P.DIGIT_CONTINUATION, case=True)
            | matches(sentence, P.LOWERCASE_START, case=True)
            | (F.length(sentence) < P.SHORT_FRAGMENT_CHARS)
        )
        buffer = state["buffer"]
        joins = (buffer != "") & (matches(buffer, P.BARE_LABEL) | matches(buffer, P.SHORT_COLON) | fragment)

        def after(joins: Column) -> Column:
            held = F.when(joins, F.concat(buffer, F.lit(" "), sentence)).otherwise(sentence)
            # what is long stays long: its letters no longer matter
            held = let(held, lambda h: F.when(F.length(h) > KNOWN, F.lit("x" * (KNOWN + 1))).otherwise(h))
            return F.struct(F.concat(state["marks"], F.when(joins, "j").otherwise("b")).alias("marks"), held.alias("buffer"))

        return let(joins, after)

    def folded(sentences: Column) -> Column:
        size = F.size(sentences)
        chunks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")), lambda c: F.slice(sentences, c * CHUNK + 1, F.lit(CHUNK)))
        nothing = F.struct(F.lit("").alias("marks"), F.lit("").alias("buffer"))

        def through(state: Column, chunk: Column) -> Column:
            own = F.aggregate(chunk, F.struct(F.lit("").alias("marks"), state["buffer"].alias("buffer")), step)
            return let(own, lambda x: F.struct(F.concat(state["marks"], x["marks"]).alias("marks"), x["buffer"].alias("buffer")))

        marks = F.split(F.aggregate(chunks, nothing, through)["marks"], "")

        def joined(marks: Column) -> Column:
            put = F.transform(sentences, lambda x, i: F.concat(F.when(F.get(marks, i) == "j", " ").otherwise(BREAK), x))
            return F.slice(F.split(F.array_join(put, ""), BREAK), F.lit(2), size)

        return F.when(size > 0, let(marks, joined)).otherwise(F.array().cast("array<string>"))

    return F.filter(F.transform(let(sentences, folded), strip), lambda x: x != "")


def split_sentences(text: Column, raw: Callable[[Column], Column] = raw_sentences) -> Column:
    """Sentences of a text; none of a blank one. raw: boundaries by another rule, such as an analyzer's."""
    return merge_fragments(raw(F.coalesce(text, F.lit(""))))
