"""How documents are dealt out before heavy work on their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_document(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows by document, while a document is still one row: windows over its events then need no exchange of their own.

    The number of partitions is the session's, as for any shuffle; equal keys meet whatever it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def balanced(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if it has fewer splits than there are cores; an input of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
