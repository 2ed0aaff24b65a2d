"""Sums of fixed-length vectors over all partitions of a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_sums(df: DataFrame, width: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all rows of what `add` puts into a vector of `width` doubles.

    Each task keeps one vector.  The vectors of a square root of the tasks meet in each task of a second stage, and theirs
    in the one task of a third, so that none receives more than a square root of all vectors and the driver gets one.
    """
    spread = max(1, int(df.sparkSession.sparkContext.defaultParallelism ** 0.5 * 2))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(width), False
        for rows in batches:
            if rows.num_rows:
                add(total, rows)
                some = True
        if some:
            yield pa.RecordBatch.from_pydict({"g": pa.array([TaskContext.get().partitionId() % spread], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(width), False
        for rows in batches:
            for blob in rows.column("v"):
                total += np.frombuffer(blob.as_buffer(), np.float64)
                some = True
        if some:  # a partition without vectors sends none
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    sums = df.mapInArrow(first, "g int, v binary").repartition(spread, F.col("g")).mapInArrow(second, "v binary")
    found = sums.repartition(1).mapInArrow(second, "v binary").collect()  # one row, or none of no rows
    return np.frombuffer(found[0]["v"], np.float64).copy() if found else np.zeros(width)


def float_rows(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """An array<float> column of equal-length rows as a matrix."""
    column = rows.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
