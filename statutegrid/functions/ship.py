"""Python code for the executors: the package goes with the job, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark once an application, as a zip that it serves to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    handle, path = tempfile.mkstemp(prefix="statutegrid-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema: object) -> DataFrame:
    """df.mapInArrow, with the package on the executors; a worker that waits for its next task holds no free Arrow memory.

    Columns may have any names: mapInArrow itself takes a dot for a field's.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(b.rename_columns(names) for b in batches)
        pa.default_memory_pool().release_unused()

    ship(df.sparkSession)
    if any(c in name for name in names for c in ".`"):
        df = df.toDF(*[f"c{n}" for n in range(len(names))])
    return df.mapInArrow(run, schema)
