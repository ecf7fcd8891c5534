"""Groups of any size as bounded pairs of blocks: no task ever holds a whole group, no pair becomes a row before it is judged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
#: Blocks that meet only a group's representatives cost two copies of a row whatever their size; small ones spread a group evenly over tasks.
REPRESENTED_BLOCK = 128


def paired_blocks(members: DataFrame, key: str, size: str, member: str, block: int = BLOCK) -> DataFrame:
    """members with _i <= _j, the pair of blocks that a copy of the row is for, and _at, its own block.

    A group of n members has ceil(n / block) blocks; each pair of them meets once, in one task's hands.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    at = F.pmod(F.xxhash64(member, F.lit("block")), n).cast("int")
    spread = members.withColumn("_n", n).withColumn("_at", at)
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    spread = spread.withColumn("_o", other)
    spread = spread.withColumn("_i", F.least("_at", "_o")).withColumn("_j", F.greatest("_at", "_o")).drop("_o", "_n")
    return _dealt(spread, key)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")


def represented_blocks(members: DataFrame, key: str, size: str, member: str, block: int = REPRESENTED_BLOCK) -> DataFrame:
    """members by block, each block with block 0 beside it as the group's representatives: _i = 0, _j the block, _at the row's own block.

    A group of n members gives about 2 n rows, whatever its size; a task judges pairs inside block _j and between it and block 0.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    at = F.pmod(F.xxhash64(member, F.lit("block")), n).cast("int")
    spread = members.withColumn("_n", n).withColumn("_at", at)
    tasks = F.when(F.col("_at") == 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array("_at"))
    return _dealt(spread.withColumn("_j", F.explode(tasks)).withColumn("_i", F.lit(0)).drop("_n"), key)


def minor_blocks(members: DataFrame, key: str, main: str, minor_size: str, main_size: str, member: str, block: int = BLOCK) -> DataFrame:
    """members as pairs of blocks of which at least one holds rows that are not `main`: what the main part's rows owe each other is known.

    The minor rows' blocks come first. A main row is copied once for each of them, ceil(minor rows / block) in all.
    """
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    spread = members.withColumn("_few", blocks(minor_size)).withColumn("_many", blocks(main_size))
    own = F.xxhash64(member, F.lit("block"))
    at = F.when(F.col(main), F.col("_few") + F.pmod(own, F.greatest("_many", F.lit(1)))).otherwise(F.pmod(own, F.greatest("_few", F.lit(1)))).cast("int")
    spread = spread.withColumn("_at", at)
    last = F.when(F.col(main), F.col("_few")).otherwise(F.col("_few") + F.col("_many"))
    spread = spread.withColumn("_o", F.explode(F.sequence(F.lit(0), last - 1)))
    spread = spread.withColumn("_i", F.least("_at", "_o")).withColumn("_j", F.greatest("_at", "_o"))
    return _dealt(spread.drop("_few", "_many", "_o"), key)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal long or int keys as one table each; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = np.flatnonzero(change)
        start = 0
        for e in edges:
            held.append(batch.slice(start, e - start))
            yield pa.Table.from_batches(held)
            held, start = [], e
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Equal-length binaries as rows of a matrix."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype).reshape(len(data), -1)


def block_labels(near: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of a symmetric boolean matrix."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        low = np.where(near, label[None, :], n).min(1)
        low = low[low]
        if (low == label).all():
            return label
        label = low
