"""Composite keys as one binary value that sorts byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BYTES = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}


def merged_key(df: DataFrame, names: list[str]) -> Column:
    """Integer, timestamp, interval and binary columns, big-endian, end to end, with a semicolon unless the last is binary.

    ValueError without columns or for any other type.  Negative numbers follow the others, as their bytes do.
    """
    if not names:
        raise ValueError("a key takes one column at least")
    parts: list[Column] = []
    for name in names:
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.BinaryType):
            parts.append(F.hex(c))
            continue
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            kind, c = T.LongType(), F.unix_micros(c.cast("timestamp"))
        elif isinstance(kind, T.DayTimeIntervalType):
            kind, c = T.LongType(), (F.extract(F.lit("DAY"), c) * 86400 + F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60 + F.extract(F.lit("SECOND"), c)).cast("decimal(20,6)").cast("double").cast("long") * 1000000
        if type(kind) not in _BYTES:
            raise ValueError(f"column {name!r} of type {kind.simpleString()} does not merge into a key")
        parts.append(F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(2 * _BYTES[type(kind)])))
    if not isinstance(df.schema[names[-1]].dataType, T.BinaryType):
        parts.append(F.lit("3B"))
    return F.unhex(F.concat(*parts))
