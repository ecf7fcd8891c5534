"""Documents to ordered blocks: plain paragraphs and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P
from statutegrid.functions.text import lines, strip

_BLOCK, _LINE = "\u001c", "\n"


def paragraphs(text: Column) -> Column:
    """Paragraphs between two or more newlines; single newlines inside are blanks; blank paragraphs go."""
    parts = F.transform(F.split(text, "\n{2,}"), lambda p: strip(F.replace(p, F.lit("\n"), F.lit(" "))))
    return F.filter(parts, lambda p: p != "")


def markdown_blocks(text: Column) -> Column:
    """Headers on their own, and all that stands between two headers or rules, without emphasis, link targets and blank lines."""

    def marked(line: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(line, P.MARKDOWN_EMPHASIS, "$1"), P.MARKDOWN_LINK, "$1")
        header = strip(F.regexp_replace(line, "(?U)" + P.MARKDOWN_HEADER.replace(r"\s", r"\s+"), ""))
        return (
            F.when(line.rlike("(?U)" + P.MARKDOWN_HEADER), F.concat(F.lit(_BLOCK), header, F.lit(_BLOCK)))
            .when(line.rlike(P.MARKDOWN_RULE), F.lit(_BLOCK)).when(clean != "", F.concat(F.lit(_LINE), clean)).otherwise("")
        )

    joined = F.array_join(F.transform(F.transform(lines(text), strip), marked), "")
    return F.filter(F.transform(F.split(joined, _BLOCK), strip), lambda b: b != "")


def blocks_of(docs: DataFrame, form: str | Column = "md") -> DataFrame:
    """docs (doc_id, text, ...) as (doc_id, ..., block_no, page, text); form is md or txt, or a column of them. Null texts have no blocks."""
    form = F.lit(form) if isinstance(form, str) else form
    parts = F.when(form == "md", markdown_blocks(F.col("text"))).otherwise(paragraphs(F.col("text")))
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, F.posexplode(parts).alias("block_no", "text")).select(*keep, "block_no", F.lit(None).cast("int").alias("page"), "text")
