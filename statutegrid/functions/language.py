"""Language detection by stop words: Spanish or English, Spanish where neither leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P


def word_hits(text: Column) -> Column:
    """struct(es, en): stop words of each language among the first SAMPLE_CHARS characters."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, P.SAMPLE_CHARS)), F.lit("[a-záéíóúüñ]+"), F.lit(0))
    count = lambda stop: F.size(F.filter(words, lambda w: w.isin(stop)))
    return F.struct(count(P.STOPWORDS_ES).alias("es"), count(P.STOPWORDS_EN).alias("en"))


def detect_language(text: Column) -> Column:
    hits = word_hits(F.coalesce(text, F.lit("")))
    return F.when(hits["en"] > hits["es"], "en").otherwise("es")


def with_language(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, text, others) with the language of their document, told by its first SAMPLE_CHARS characters.

    Blocks are joined by blanks, which no word goes over, so a document's hits are the sums of its blocks' hits, the last one's up to where the sample ends: two
    windows over the document's blocks, in the order and partitioning that whatever follows needs, and no second look at the input.
    """
    whole = Window.partitionBy("doc_id")
    before = whole.orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_before", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    head = F.when(F.col("_before") < P.SAMPLE_CHARS, F.substring("text", F.lit(1), (P.SAMPLE_CHARS - F.col("_before")).cast("int")))
    counted = placed.withColumn("_hits", word_hits(F.coalesce(head, F.lit(""))))
    spanish, english = F.sum("_hits.es").over(whole), F.sum("_hits.en").over(whole)
    return counted.withColumn("language", F.when(english > spanish, "en").otherwise("es")).drop("_before", "_hits")


def document_language(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, text) as (doc_id, language)."""
    return with_language(blocks.select("doc_id", "block_no", "text")).groupBy("doc_id").agg(F.first("language").alias("language"))
