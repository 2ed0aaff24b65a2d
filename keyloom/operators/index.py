"""The index: a view of the columns that form a frame's key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import canonical, null_pred
from ..functions.ordering import columns
from .frame import POSITION, Frame


class Index:
    __slots__ = ("_frame",)

    def __init__(self, frame: Frame):
        self._frame = frame

    @property
    def names(self) -> tuple[str, ...]:
        return self._frame._index

    @property
    def nlevels(self) -> int:
        return len(self.names)

    @property
    def name(self) -> str:
        if self.nlevels != 1:
            raise ValueError(f"the index has {self.nlevels} levels")
        return self.names[0]

    @property
    def empty(self) -> bool:
        return self._frame.df.isEmpty()

    def __len__(self) -> int:
        return len(self._frame) if self.names else 0

    def __str__(self) -> str:
        return f"({', '.join(self.names)}){', unique' if self.names and self.is_unique else ''}"

    @property
    def values(self) -> DataFrame:
        if self.nlevels != 1:
            raise AttributeError("only an index of one level has values")
        return self.get_level_values(0)

    def get_level_values(self, n: int) -> DataFrame:
        if not 0 <= n < self.nlevels:
            raise IndexError(n)
        return self._frame.df.select(F.col(f"`{self.names[n]}`"))

    @property
    def levels(self) -> tuple[DataFrame, ...]:
        return tuple(self.get_level_values(n) for n in range(self.nlevels))

    def keys(self) -> list[Column]:
        return [canonical(F.col(f"`{n}`"), self._frame.df.schema[n].dataType).alias(n) for n in self.names]

    def duplicated(self, keep: str = "first") -> Column:
        return self._frame.duplicated(self.names, keep)

    @property
    def is_unique(self) -> bool:
        return self.uniqueness().first()[0]

    def uniqueness(self) -> DataFrame:
        """One row: is_unique.  Counts combine before the shuffle; no key gathers rows."""
        df = self._frame.df
        if not self.names:
            return df.sparkSession.range(1).select(F.lit(True).alias("is_unique"))
        return df.groupBy(*self.keys()).agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(1)) == 1).alias("is_unique"))

    @property
    def is_monotonic_increasing(self) -> bool:
        return self.monotonic().first()[0]

    @property
    def is_monotonic_decreasing(self) -> bool:
        return self.monotonic(False).first()[0]

    def monotonic(self, increasing: bool = True) -> DataFrame:
        """One row: whether the keys never fall (or rise), level by level, in the order of the rows; false with nulls among several rows.

        Keys that lead the order of the rows are sorted as they are.  Others are numbered, without the other columns, and
        each meets its predecessor within a block of positions; blocks are joined by their ends.
        """
        frame = self._frame
        null = reduce(lambda a, b: a | b, [null_pred(F.col(f"`{n}`"), frame.df.schema[n].dataType) for n in self.names], F.lit(False))
        if tuple((k.name, k.ascending) for k in frame.order[: self.nlevels]) == tuple((n, increasing) for n in self.names):
            some = frame.df.agg(F.bool_or(null).alias("null"), F.count("*").alias("n"))
            return some.select(((F.col("n") < 2) | ~F.col("null")).alias("mono"))
        df = frame._positioned(self.names)
        size = 1 << 16
        block = F.floor(F.col(POSITION) / size)
        w = Window.partitionBy(block).orderBy(POSITION)
        key, before = F.struct(*self.keys()), F.lag(F.struct(*self.keys())).over(w)
        fits = before <= key if increasing else before >= key
        inside = df.select(block.alias("block"), F.col(POSITION).alias("at"), key.alias("key"), null.alias("null"), F.coalesce(fits, F.lit(True)).alias("fits"))
        blocks = inside.groupBy("block").agg(F.bool_and(F.col("fits")).alias("fits"), F.bool_or("null").alias("null"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"), F.count("*").alias("n"))
        then = blocks.select((F.col("block") + 1).alias("block"), F.col("last").alias("before"))
        both = blocks.join(then, "block", "left")
        edge = F.col("before") <= F.col("first") if increasing else F.col("before") >= F.col("first")
        whole = both.agg(F.bool_and(F.col("fits") & F.coalesce(edge, F.lit(True))).alias("fits"), F.bool_or("null").alias("null"), F.sum("n").alias("n"))
        return whole.select((F.coalesce(F.col("n"), F.lit(0)) < 2).alias("short"), F.col("fits"), F.col("null")).select((F.col("short") | (F.col("fits") & ~F.col("null"))).alias("mono"))

    def diff(self, other: Index, positions: bool = True) -> DataFrame:
        """Keys that the other index lacks, once each, with the position of the first: an anti join in which null meets null."""
        if self.nlevels != other.nlevels:
            raise ValueError("indexes of different depth")
        left = self._frame._positioned(self.names) if positions else self._frame.df
        there = other._frame.df.select(*[k.alias(f"__kl_o{i}") for i, k in enumerate(other.keys())]).distinct()
        same = reduce(lambda a, b: a & b, [canonical(F.col(f"`{n}`"), self._frame.df.schema[n].dataType).eqNullSafe(F.col(f"__kl_o{i}")) for i, n in enumerate(self.names)])
        rest = left.join(there, same, "left_anti")
        if not positions:
            return rest.select(*self.keys()).distinct()
        return rest.groupBy(*self.keys()).agg(F.min(POSITION).alias("pos"))

    def first_rows(self) -> DataFrame:
        """The first row of each key."""
        return self._frame.take(~self.duplicated()).df.orderBy(*columns(self._frame.order)) if self._frame.order else self._frame.take(~self.duplicated()).df
