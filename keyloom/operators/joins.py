"""The n-way equi-join on the index."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import functions as F

from ..functions.nulls import canonical, miss_fill
from ..functions.ordering import SortKey
from .frame import HIDDEN, Frame

HOW = ("left", "inner", "outer", "right")


def join(*frames: Frame, how: str = "left", suffixes: Iterable[str] = (), string_fill: str | None = None, validate: str | None = None) -> Frame:
    """Frames joined on their indexes, whose names the first one gives.

    A null key meets a null key.  Where a side has no row, its integers are 0, its booleans False and all else NULL.
    Columns of the same name without suffixes overlay one another: the later frame's value where it has a row.  Suffix i
    belongs to argument i.  "right" is "left" from the last frame on.  validate="m:1" refuses repeated keys in any frame
    but the first; without it they multiply rows.  The rows are in the order of their keys and, of one key, in that of
    the first frame; like every order it costs nothing until something asks for it.

    Spark plans each step as an equi-join and picks broadcast, sort-merge or hash by size; adaptive execution splits
    skewed keys.
    """
    if how not in HOW:
        raise ValueError(f"how {how!r} is none of {', '.join(HOW)}")
    suffixes = list(suffixes)
    if not frames:
        raise ValueError("nothing to join")
    if suffixes and len(suffixes) != len(frames):
        raise ValueError(f"{len(suffixes)} suffixes for {len(frames)} frames")
    parts = list(zip(frames, suffixes or [None] * len(frames), strict=True))
    if how == "right":
        parts.reverse()
        how = "left"
    names = parts[0][0]._index
    if not names:
        raise ValueError("a frame without an index can't be joined")
    kinds = [parts[0][0].df.schema[n].dataType for n in names]
    for frame, _ in parts[1:]:
        if len(frame._index) != len(names):
            raise ValueError(f"indexes of different depth: {names} and {frame._index}")
        if [frame.df.schema[n].dataType for n in frame._index] != kinds:
            raise ValueError(f"keys of different types: {names} and {frame._index}")
        if set(names) & ({c for c in frame.columns} - set(frame._index)):
            raise ValueError("a column has the name of an index level")
    if validate == "m:1":
        for frame, _ in parts[1:]:
            if not frame.index.is_unique:
                raise NotImplementedError("repeated keys beyond the first frame")
    if len(parts) == 1 and not suffixes:
        return frames[0].copy()

    def prepared(i: int):
        """Frame i with its keys, its payload under names of its own and a marker of its rows."""
        frame, suffix = parts[i]
        keys = [canonical(F.col(f"`{n}`"), k).alias(f"{HIDDEN}{i}_k{j}") for j, (n, k) in enumerate(zip(frame._index, kinds, strict=True))]
        payload = [c for c in frame.columns if c not in frame._index]
        if i == 0:
            keys += [F.col(f"`{k.name}`").alias(f"{HIDDEN}o{j}") for j, k in enumerate(frame._order)]
        return frame.df.select(*keys, *[F.col(f"`{c}`").alias(f"{HIDDEN}{i}_c{j}") for j, c in enumerate(payload)], F.lit(True).alias(f"{HIDDEN}{i}")), [(c, c if suffix is None else f"{c}{suffix}", frame.df.schema[c].dataType) for c in payload]

    joined, payload = prepared(0)
    joined = joined.withColumnsRenamed({f"{HIDDEN}0_k{j}": f"{HIDDEN}k{j}" for j in range(len(names))})
    payloads = [payload]
    for i in range(1, len(parts)):
        right, payload = prepared(i)
        payloads.append(payload)
        same = reduce(lambda a, b: a & b, [F.col(f"{HIDDEN}k{j}").eqNullSafe(F.col(f"{HIDDEN}{i}_k{j}")) for j in range(len(names))])
        joined = joined.join(right, same, {"left": "left", "inner": "inner", "outer": "full"}[how])
        if how == "outer":
            joined = joined.withColumns({f"{HIDDEN}k{j}": F.coalesce(F.col(f"{HIDDEN}k{j}"), F.col(f"{HIDDEN}{i}_k{j}")) for j in range(len(names))})
        joined = joined.drop(*[f"{HIDDEN}{i}_k{j}" for j in range(len(names))])
    out: dict[str, object] = {}
    types: dict[str, object] = {}
    for i, payload in enumerate(payloads):
        here = F.col(f"{HIDDEN}{i}").isNotNull()
        for j, (_, name, kind) in enumerate(payload):
            value = F.col(f"{HIDDEN}{i}_c{j}")
            if name in out:
                out[name] = F.when(here, value.cast(types[name])).otherwise(out[name])
            else:
                types[name] = kind
                out[name] = value if how == "inner" or how == "left" and i == 0 else F.when(here, value).otherwise(miss_fill(kind, string_fill))
    order = [SortKey(f"{HIDDEN}o{j}", k.ascending, k.nulls_last) for j, k in enumerate(parts[0][0]._order)]
    done = joined.select(*[F.col(f"{HIDDEN}k{j}").alias(n) for j, n in enumerate(names)], *[c.alias(n) for n, c in out.items()], *[k.name for k in order])
    return Frame(done, index=names, order=(*names, *order))
