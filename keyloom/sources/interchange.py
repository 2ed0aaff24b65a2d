"""Reading and writing frames: Parquet tables, Arrow bytes and JSON."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import Frame

_KEY = b"keyloom"
FILE, ROW = "__kl_file", "__kl_row"


class CorruptedBuffer(ValueError):
    """Bytes that are no serialized frame."""


def read_parquet(spark: SparkSession, path: str, index: str | tuple[str, ...] | None = None, order: str | tuple[str, ...] = (), row_order: bool = False) -> Frame:
    """A frame over Parquet files; row_order takes the order of files and of the rows in them.

    Without an explicit index, the one that write_parquet has noted is restored.
    """
    df = spark.read.parquet(path)
    if index is None:
        noted = [(f.metadata["keyloom.index"], f.name) for f in df.schema.fields if "keyloom.index" in (f.metadata or {})]
        index = tuple(name for _, name in sorted(noted))
    if row_order:
        df = df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        order = (FILE, ROW)
    return Frame(df, index, order)


def write_parquet(frame: Frame, path: str, mode: str = "error") -> None:
    """All columns, with the level of index columns in their metadata."""
    levels = {n: i for i, n in enumerate(frame._index)}
    frame.df.select(*[F.col(f"`{c}`").alias(c, metadata={"keyloom.index": levels[c]}) if c in levels else F.col(f"`{c}`") for c in frame.columns]).write.mode(mode).parquet(path)


def serialize(frame: Frame) -> bytes:
    """A small frame as bytes: an Arrow stream with the index and the frame's class in its metadata.  The rows come to the driver."""
    table = frame.to_arrow()
    body = pa.BufferOutputStream()
    table = table.replace_schema_metadata({_KEY: json.dumps({"index": list(frame._index), "rows": len(table), "class": _name(type(frame))}).encode()})
    with pa.ipc.new_stream(body, table.schema) as out:
        out.write_table(table)
    raw = body.getvalue().to_pybytes()
    return len(raw).to_bytes(8, "little") + raw


def _name(kind: type) -> str:
    return f"{kind.__module__}.{kind.__qualname__}"


def _known(name: str) -> type[Frame]:
    """The class of that name among those that are loaded already: reading bytes imports nothing."""
    kinds: list[type[Frame]] = [Frame]
    for kind in kinds:
        kinds += kind.__subclasses__()
    return next((kind for kind in kinds if _name(kind) == name), Frame)


def deserialize(spark: SparkSession, raw: bytes) -> Frame:
    """The frame that serialize has written, of its class if that is loaded; CorruptedBuffer for any prefix, any rest and anything else."""
    if len(raw) < 8 or int.from_bytes(raw[:8], "little") != len(raw) - 8:
        raise CorruptedBuffer("the length is wrong")
    try:
        table = pa.ipc.open_stream(raw[8:]).read_all()
        noted = json.loads(table.schema.metadata[_KEY])
        if noted["rows"] != len(table):
            raise CorruptedBuffer("rows are missing")
    except CorruptedBuffer:
        raise
    except (pa.ArrowException, KeyError, TypeError, ValueError, OSError) as e:
        raise CorruptedBuffer(str(e)) from e
    return _known(noted.get("class", "")).from_arrow(spark, table.replace_schema_metadata(None), noted["index"])


def json_dumps(value: Any) -> bytes:
    """JSON of dicts, lists, strings, numbers, booleans and None, as UTF-8; ValueError for all else, NaN and infinities included."""

    def check(x: Any) -> None:
        if isinstance(x, dict):
            if not all(isinstance(k, str) for k in x):
                raise ValueError("keys are strings")
            for v in x.values():
                check(v)
        elif isinstance(x, list):
            for v in x:
                check(v)
        elif x is not None and not isinstance(x, (str, int, float, bool)):
            raise ValueError(f"{type(x).__name__} has no JSON form")

    check(value)
    return json.dumps(value, ensure_ascii=False, allow_nan=False, separators=(",", ":")).encode()


def to_json(column: Column) -> Column:
    """A struct, map, array or variant column as JSON text, nulls included."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def from_json(column: Column) -> Column:
    """JSON text as a variant; null where it is none."""
    return F.try_parse_json(column)
