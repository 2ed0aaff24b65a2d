"""Samples of an exact size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import SortKey, with_position
from .frame import HIDDEN, POSITION, Frame

#: Positions whose weights are summed in one group.
BLOCK = 1 << 16
#: Rows that a top-k takes, whose one last task reads as many from each partition; more are laid out by their draws.
TOP = 1_000


def sample(frame: Frame, n: int | None = None, frac: float | None = None, replace: bool = False, weights: str | None = None, seed: int | None = None) -> Frame:
    """n rows, or int(frac * rows): ValueError unless one of them is given, or for more rows than there are without replacement.

    Without replacement each row draws a key, uniform or exponential with its weight as rate, and the n least are taken:
    by a top-k up to TOP rows, else by their dense positions among the draws.  With replacement n positions are drawn and
    joined.
    """
    if (n is None) == (frac is None):
        raise ValueError("give n or frac")
    total = len(frame) if frac is not None or replace or n else 0
    n = int(total * frac) if n is None else n
    if n < 0 or not replace and n > total:
        raise ValueError(f"{n} of {total} rows")
    random = F.rand(seed) if seed is not None else F.rand()
    if not replace:
        key = random if weights is None else F.when(F.col(f"`{weights}`") > 0, -F.log(1 - random) / F.col(f"`{weights}`"))
        drawn = frame.df.withColumn(HIDDEN + "draw", key)
        if n > TOP:
            return frame._with(_least(drawn, n, total if weights is None else None).select(*frame._quoted(frame.df.columns)))
        return frame._with(drawn.orderBy(F.col(HIDDEN + "draw").asc_nulls_last()).limit(n).drop(HIDDEN + "draw"))
    if not frame._order:  # any order will do
        frame = frame._with(frame.df.withColumn(HIDDEN + "any", F.monotonically_increasing_id()), order=(SortKey(HIDDEN + "any"),))
    rows = frame._positioned()
    draws = frame.df.sparkSession.range(n).withColumn(HIDDEN + "u", random)
    if weights is None:
        draws = draws.select("id", F.floor(F.col(HIDDEN + "u") * total).alias(HIDDEN + "p"))
    else:
        whole = frame.df.agg(F.sum(F.col(f"`{weights}`").cast("double"))).first()[0] or 0.0
        draws = draws.withColumn(HIDDEN + "u", F.col(HIDDEN + "u") * F.lit(whole)).join(*_ranges(rows, weights, max(64, n), whole)).select("id", HIDDEN + "p")
    out = rows.join(draws, F.col(POSITION) == F.col(HIDDEN + "p")).drop(POSITION, HIDDEN + "p").withColumnRenamed("id", POSITION)
    return frame._with(out, order=(SortKey(POSITION),))


def _least(drawn: DataFrame, n: int, uniform: int | None) -> DataFrame:
    """The n rows of the least draws; `uniform` is the number of rows, if their draws are uniform.

    The rows are range-partitioned by their draws and written once: no task reads more than its range.  Of uniform draws
    only those below a bound are, which n rows fail to reach less than once in 10^13 times; then all rows are laid out.
    """
    odd = {f.name: f.dataType for f in drawn.schema if isinstance(f.dataType, (T.NullType, T.CalendarIntervalType))}  # Parquet lacks these
    order, rank = (SortKey(HIDDEN + "draw"),), HIDDEN + "rank"

    def least(df: DataFrame) -> DataFrame:
        laid = with_position(df.withColumns({c: F.col(f"`{c}`").cast("string") for c in odd}), order, rank).where(F.col(rank) < n)
        return laid.withColumns({c: F.lit(None) if isinstance(kind, T.NullType) else F.col(f"`{c}`").cast("interval") for c, kind in odd.items()})

    bound = 1.0 if uniform is None else (n + 8 * math.sqrt(n) + 64) / uniform
    if bound < 1:
        out = least(drawn.where(F.col(HIDDEN + "draw") < bound))
        if out.count() == n:
            return out
    return least(drawn)


def _ranges(rows: DataFrame, weights: str, buckets: int, whole: float) -> tuple[DataFrame, Column]:
    """The range of running weight that each position owns, in every bucket that it meets, and the condition on which a draw falls into it.

    Running sums are taken in blocks of positions, over the totals of the blocks in blocks of blocks, and over the totals
    of those, which are one row for BLOCK * BLOCK positions.
    """
    w = F.coalesce(F.col(f"`{weights}`").cast("double"), F.lit(0.0))
    weighed = rows.select(F.col(POSITION).alias(HIDDEN + "p"), w.alias("w"), F.floor(F.col(POSITION) / BLOCK).alias("block"))
    totals = weighed.groupBy("block").agg(F.sum("w").alias("total")).withColumn("upper", F.floor(F.col("block") / BLOCK))

    def before(total: str, by: str, *within: str) -> Column:
        w = Window.partitionBy(*within) if within else Window
        return F.coalesce(F.sum(total).over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))

    uppers = totals.groupBy("upper").agg(F.sum("total").alias("whole")).select("upper", before("whole", "upper").alias("upper_before"))
    starts = totals.withColumn("block_before", before("total", "block", "upper")).join(uppers, "upper").select("block", (F.col("upper_before") + F.col("block_before")).alias("before"))
    ranges = weighed.withColumn("inside", before("w", HIDDEN + "p", "block")).join(starts, "block").where("w > 0").withColumn("a", F.col("before") + F.col("inside")).withColumn("b", F.col("before") + F.col("inside") + F.col("w"))
    width = whole / buckets if whole else 1.0
    spread = ranges.select(HIDDEN + "p", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))).alias("bucket"))
    u = F.col(HIDDEN + "u")
    return spread, (F.floor(u / width) == F.col("bucket")) & (u >= F.col("a")) & (u < F.col("b"))
