"""Concatenation and intersection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import miss_fill
from .frame import HIDDEN, POSITION, Frame
from ..functions.ordering import SortKey

_RANK = [T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: numbers widen, anything with a string becomes a string."""
    if a == b:
        return a
    if type(a) in _RANK and type(b) in _RANK:
        wide = max(a, b, key=lambda k: _RANK.index(type(k)))
        other = b if wide is a else a
        return T.DoubleType() if isinstance(wide, T.FloatType) and type(other) in (T.IntegerType, T.LongType) else wide
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    raise ValueError(f"no type holds both {a.simpleString()} and {b.simpleString()}")


def concat(*frames: Frame, ignore_index: bool = False, strict: bool = True, string_fill: str | None = None) -> Frame:
    """Rows of all frames, one frame after the other, columns by name.

    Strict frames have the same columns, in any order, and the same index; otherwise columns that a frame lacks are
    filled as in a join.  Types are widened before the union.  Each frame's order is carried along; if a frame has none,
    neither has the result.
    """
    if not frames:
        raise ValueError("nothing to concatenate")
    if len(frames) == 1:
        return frames[0].copy()
    first = frames[0]
    if not ignore_index and any(f._index != first._index for f in frames):
        raise ValueError("frames with different indexes")
    if strict and any(set(f.columns) != set(first.columns) for f in frames):
        raise ValueError("frames with different columns")
    kinds: dict[str, T.DataType] = {}
    for frame in frames:
        for name, kind in frame.dtype.items():
            kinds[name] = promoted(kinds[name], kind) if name in kinds else kind
    ordered = all(f._order for f in frames)
    plain = all(f._order == (SortKey(POSITION),) for f in frames)
    # each frame's keys as they are, before types are widened; null in the rows of the others, which the part number sets apart
    keys = [SortKey(POSITION)] if plain else [SortKey(f"{HIDDEN}frame{i}_{j}", k.ascending, k.nulls_last) for i, f in enumerate(frames) for j, k in enumerate(f._order)]
    source = [(i, k.name, f.df.schema[k.name].dataType) for i, f in enumerate(frames) for k in f._order]

    def order_of(i: int) -> list:
        if not ordered:
            return []
        own = [F.col(POSITION)] if plain else [(F.col(f"`{name}`") if at == i else F.lit(None).cast(kind)).alias(key.name) for key, (at, name, kind) in zip(keys, source, strict=True)]
        return [F.lit(i).alias(HIDDEN + "frame"), *own]

    def part(i: int, frame: Frame):
        return frame.df.select(*[F.col(f"`{n}`").cast(k).alias(n) if n in frame.columns else miss_fill(k, string_fill).alias(n) for n, k in kinds.items()], *order_of(i))

    union = reduce(lambda a, b: a.unionByName(b), [part(i, f) for i, f in enumerate(frames)])
    return Frame(union, index=() if ignore_index else first._index, order=(HIDDEN + "frame", *keys) if ordered else ())


def intersect(left: Frame, left_name: str, right: Frame, right_name: str, out: str | None = None) -> Frame:
    """The distinct values that two columns share."""
    name = out or left_name
    return Frame(left.df.select(F.col(f"`{left_name}`").alias(name)).intersect(right.df.select(F.col(f"`{right_name}`").alias(name))))
