"""Documents as they arrive: a file stream, analysed batch by batch.

Windows over a document's events need the whole document, and a file arrives whole; so each micro-batch runs the batch plan
and appends. Rows of a batch replace nothing; the stream's checkpoint makes a failed batch run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from statutegrid.operators.blocks import blocks_of
from statutegrid.operators.model import Scorer
from statutegrid.operators.pipeline import analysed, base_name
from statutegrid.operators.review import table, technical
from statutegrid.sources.readers import decoded, suffix


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Text and Markdown files under path as a stream (doc_id, source_base, suffix, text)."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = source.option("maxFilesPerTrigger", files_per_batch).load(path)
    rows = found.select(F.col("path").alias("doc_id"), base_name(F.col("path")).alias("source_base"), suffix(F.col("path")).alias("suffix"), decoded(F.col("content")).alias("text"))
    return rows.where(F.col("suffix").isin(".md", ".txt"))


def start(
    docs: DataFrame, out: str, checkpoint: str, language: str = "auto", load_model: Callable[[], object] | Scorer | None = None, technical_out: str | None = None, **trigger
) -> StreamingQuery:
    """Write the tables of arriving documents to Parquet under out, a folder a batch so that a batch that runs again overwrites itself.

    technical_out: where the sidecar's rows go, likewise. A batch is analysed once; executors that are lost cost their part of it again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        blocks = blocks_of(rows, F.when(F.col("suffix") == ".md", "md").otherwise("txt")).drop("suffix")
        found = analysed(blocks, language, load_model).persist()
        table(found).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if technical_out:
            technical(found).write.mode("overwrite").parquet(f"{technical_out}/batch={number}")
        found.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
