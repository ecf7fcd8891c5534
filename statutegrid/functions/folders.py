"""Folders for what a query writes on its way, where driver and executors both reach them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def working_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, removed when the driver ends; on a single machine that names none, under a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named and "path" not in _own:
        _own["path"] = "file://" + tempfile.mkdtemp(prefix="statutegrid-")
    path = f"{(named or _own['path']).rstrip('/')}/statutegrid/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone; the folder holds nothing of worth
            continue
