"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, delete_at_exit, fresh_path

#: Text that a Python worker expands into arrays at a time, in bytes.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df does not have: those asked for, with underscores as needed."""
    out = []
    for name in names:
        while name in df.columns:
            name = f"_{name}"
        out.append(name)
    return out


#: Paths of the tables that the innermost scratch block has written.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged within, but those that are kept, and the shuffle files of the jobs within."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            delete(spark, path)
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark clear away the shuffle files of jobs that are over: it does once the driver collects what refers to them, which takes two rounds."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df below the shared folder, compressed, and read it back, which cuts its lineage and survives the loss of executors.

    The files go at the end of the scratch block, or when the driver ends if there is none or they are to be kept.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    paths = _SCOPE.get()
    if keep or paths is None:
        delete_at_exit(spark, path)
    else:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: the session's own setting, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha_hex(column) -> object:
    """Lower-case hex SHA-256 of a string column's UTF-8 bytes."""
    return F.sha2(column, 256)


def slices(sizes: Iterable[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of neighbouring items with at most `limit` in total, or one larger item alone."""
    begin = end = total = 0
    for size in sizes:
        if end > begin and total + size > limit:
            yield begin, end
            begin, total = end, 0
        total += size
        end += 1
    if end > begin:
        yield begin, end


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """Slices of a column of texts, (from, to, slice), each of at most `limit` bytes or one larger text alone; a null has none.

    A worker makes Python objects of the slice at hand, never of a whole batch, which may hold 10,000 long texts.
    """
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, b, column.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of texts that are not null."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
