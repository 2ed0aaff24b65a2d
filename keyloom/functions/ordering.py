"""The order of rows: keys with directions, and dense positions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


@dataclass(frozen=True)
class SortKey:
    """One column of an order."""

    name: str
    ascending: bool = True
    nulls_last: bool = True

    def column(self) -> Column:
        c = F.col(f"`{self.name}`")
        if self.ascending:
            return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()
        return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()

    def reversed(self) -> SortKey:
        return replace(self, ascending=not self.ascending, nulls_last=not self.nulls_last)


def columns(order: tuple[SortKey, ...], reverse: bool = False) -> list[Column]:
    return [(k.reversed() if reverse else k).column() for k in order]


def order_value(order: tuple[SortKey, ...]) -> tuple[Column, bool] | None:
    """One comparable value for an order, and whether it grows along it; None where there is no order or its directions are mixed."""
    directions = {k.ascending for k in order}
    if len(directions) != 1:
        return None
    up = directions.pop()

    def part(k: SortKey) -> Column:
        c = F.col(f"`{k.name}`")
        return F.struct(c.isNull() if k.nulls_last == up else c.isNotNull(), c)

    return F.struct(*[part(k) for k in order]), up


_ID_BITS = 33  # of monotonically_increasing_id, below the partition's number
#: Orders that end in one of these tell all rows apart.
UNIQUE = frozenset(("__kl_position", "__kl_row"))


def _tie_break(df: DataFrame, order: tuple[SortKey, ...]) -> list[Column]:
    """A hash of the row as the last key, so that many rows with equal keys are dealt out over several partitions."""
    if any(k.name in UNIQUE for k in order):
        return []
    plain = [f.name for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return [F.xxhash64(*[F.col(f"`{n}`") for n in plain])] if plain else []


def with_position(df: DataFrame, order: tuple[SortKey, ...], name: str) -> DataFrame:
    """df with the dense position of each row in its order.

    The rows are range-partitioned, sorted and written once, so that numbering and counting see the same partitions; a
    row's position is its place in its partition plus the sizes of those before, which is one number a partition.
    """
    if not order:
        raise ValueError("rows without an order have no positions")
    at = "__kl_at"
    keys = [*columns(order), *_tie_break(df, order)]
    laid = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "positions")
    part = F.shiftrightunsigned(F.col(at), _ID_BITS)
    sizes = {r["part"]: r["n"] for r in laid.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = {}, 0
    for k in sorted(sizes):
        before[k] = total
        total += sizes[k]
    offsets = laid.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__kl_part long, __kl_before long")
    numbered = laid.join(F.broadcast(offsets), part == F.col("__kl_part"))  # one row a partition: small by construction
    position = F.col(at).bitwiseAND(F.lit((1 << _ID_BITS) - 1)) + F.col("__kl_before")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], position.alias(name))
