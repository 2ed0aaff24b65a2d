"""What counts as null, and what stands in for a value that a join or a concat misses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_pred(column: Column, kind: T.DataType) -> Column:
    """True for NULL and, in floating point columns, for NaN; never null itself."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.coalesce(F.isnan(column), F.lit(False))
    return column.isNull()


def canonical(column: Column, kind: T.DataType) -> Column:
    """A key in which NaN is NULL, so that one group and one join partner hold both."""
    return F.when(F.isnan(column), None).otherwise(column) if isinstance(kind, (T.FloatType, T.DoubleType)) else column


def miss_fill(kind: T.DataType, string_fill: str | None = None) -> Column:
    """The value of a column where its side has no row: 0 and False for integers and booleans, NULL for all else.

    string_fill: what strings get instead of NULL; "" is what columns of fixed width would hold.
    """
    if isinstance(kind, T.IntegralType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StringType) and string_fill is not None:
        return F.lit(string_fill)
    return F.lit(None).cast(kind)
