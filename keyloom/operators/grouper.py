"""Groups of rows with equal keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import canonical, null_pred
from ..functions.ordering import order_value
from .frame import HIDDEN, POSITION, Frame

#: Reductions by name.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "add": F.sum, "sum": F.sum, "multiply": F.product, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or,
    "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor, "count": F.count, "mean": F.avg,
}
#: Array functions that are reductions by name; any other is applied to a group's values in their order.
UFUNCS = {"add": "add", "multiply": "multiply", "minimum": "min", "maximum": "max", "fmin": "fmin", "fmax": "fmax", "logical_and": "and", "logical_or": "or", "bitwise_and": "bit_and", "bitwise_or": "bit_or", "bitwise_xor": "bit_xor"}


class Grouper:
    """Keys are columns or expressions; null and NaN are one key.  Nothing runs before a result is asked for."""

    __slots__ = ("_frame", "_keys", "names")

    def __init__(self, frame: Frame, by: tuple[str | Column, ...]):
        if not by:
            raise ValueError("groupby takes one key at least")
        self._frame, self._keys, names = frame, [], []
        for i, key in enumerate(by):
            if isinstance(key, str):
                frame._need([key])
                self._keys.append(canonical(F.col(f"`{key}`"), frame.df.schema[key].dataType).alias(key))
                names.append(key)
            elif isinstance(key, Column):
                self._keys.append(canonical(key, self._kind(key)).alias(f"key{i}"))
                names.append(f"key{i}")
            elif isinstance(key, (list, tuple)) or type(key).__module__ == "numpy" and getattr(key, "ndim", 0) == 1:
                frame = self._frame = self._frame.with_column(f"{HIDDEN}key{i}", key)  # one value a row
                own = F.col(f"{HIDDEN}key{i}")
                self._keys.append(canonical(own, self._kind(own)).alias(f"key{i}"))
                names.append(f"key{i}")
            else:
                raise TypeError(f"a key is a name or an expression, not {type(key).__name__}")
        self.names = tuple(names)

    def _kind(self, column: Column) -> T.DataType:
        """A column's type, from the plan."""
        return self._frame.df.select(column).schema[0].dataType

    def _result(self, df: DataFrame) -> Frame:
        """One row a group, in the order of the keys."""
        return Frame(df, index=self.names, order=self.names)

    def agg(self, **outputs: tuple[str | Column, str | Callable]) -> Frame:
        """A column for each output=(column, reduction); named reductions combine before the shuffle.

        min and max give NaN where a group holds one, fmin and fmax leave it out; NULL is left out by all.  A reduction
        can also be a NumPy ufunc, or a function of two Columns that is folded over the group's values in the order of
        the rows; unless it is one of those with a name, the values of a group must fit into a row.
        """
        made, folded = [], {}
        for out, (what, how) in outputs.items():
            c = F.col(f"`{self._frame._need([what])[0]}`") if isinstance(what, str) else what
            kind = self._kind(c)
            named = how if isinstance(how, str) else UFUNCS.get(how.__name__) if hasattr(how, "reduceat") else None
            if named is None:
                folded[out] = (how, kind)
                made.append(self._values(c).alias(out))
            else:
                made.append(self._reduction(c, kind, named).alias(out))
        df = self._frame.df.groupBy(*self._keys).agg(*made)
        return self._result(df.withColumns({out: _fold(F.col(f"`{out}`"), how, kind) for out, (how, kind) in folded.items()}) if folded else df)

    @staticmethod
    def _reduction(c: Column, kind: T.DataType, how: str) -> Column:
        floating = isinstance(kind, (T.FloatType, T.DoubleType))
        if how in ("fmin", "fmax"):
            return REDUCTIONS[how[1:]](F.when(~null_pred(c, kind), c))
        if how == "min" and floating:
            return F.when(F.bool_or(F.isnan(c)), F.lit(float("nan")).cast(kind)).otherwise(F.min(c))
        return REDUCTIONS[how](c)

    def _values(self, c: Column) -> Column:
        """A group's values as an array, in the order of the rows if there is one."""
        if not self._frame.order:
            return F.transform(F.collect_list(F.struct(c.alias("v"))), lambda x: x["v"])
        value = order_value(self._frame.order)
        if value is None:
            raise ValueError("the frame's order has mixed directions")
        return F.transform(F.sort_array(F.collect_list(F.struct(value[0].alias("o"), c.alias("v"))), value[1]), lambda x: x["v"])

    def counts(self, name: str = "c") -> Frame:
        return self._result(self._frame.df.groupBy(*self._keys).agg(F.count("*").alias(name)))

    def _positioned(self) -> DataFrame:
        """The keys, under their names, and the positions of all rows: no other column moves."""
        frame = self._frame
        hidden = [f"{HIDDEN}g{i}" for i in range(len(self._keys))]
        with_keys = frame._with(frame.df.withColumns(dict(zip(hidden, self._keys, strict=True))))
        return with_keys._positioned(hidden).select(*[F.col(h).alias(n) for h, n in zip(hidden, self.names, strict=True)], POSITION)

    def group_indexes(self, name: str = "first_pos") -> Frame:
        """The position of each group's first row."""
        return self._result(self._positioned().groupBy(*[f"`{n}`" for n in self.names]).agg(F.min(POSITION).alias(name)))

    def first(self, **outputs: str) -> Frame:
        """Values of each group's first row in the order of the frame."""
        value = order_value(self._frame.order)
        if value is None:
            raise ValueError("the frame has no order in one direction")
        pick = F.min_by if value[1] else F.max_by
        return self._result(self._frame.df.groupBy(*self._keys).agg(*[pick(F.col(f"`{c}`"), value[0]).alias(out) for out, c in outputs.items()]))

    def positions(self, name: str = "positions") -> Frame:
        """The positions of each group's rows, as arrays: a group must fit into a row."""
        return self._result(self._positioned().groupBy(*[f"`{n}`" for n in self.names]).agg(F.sort_array(F.collect_list(POSITION)).alias(name)))

    def order(self, name: str = "order") -> Frame:
        """All rows with their place once groups are contiguous, in key order and stable within."""
        df, names = self._frame.df, []
        for i, key in enumerate(self._keys):
            names.append(f"{HIDDEN}g{i}")
            df = df.withColumn(names[-1], key)
        return _ordered(self._frame._with(df), names, name)

    def apply(self, function: Callable, schema: str) -> DataFrame:
        """Any Python over each group's Arrow table; a group must fit into a task."""
        df, names = self._frame.df, [f"{HIDDEN}g{i}" for i in range(len(self._keys))]
        for name, key in zip(names, self._keys, strict=True):
            df = df.withColumn(name, key)
        shown = list(self._frame.columns)
        return df.select(*shown, *names).groupBy(*names).applyInArrow(lambda table: function(table.select(shown)), schema)


def _fold(values: Column, how: Callable, kind: T.DataType) -> Column:
    """An array's values reduced from its first on: by a NumPy ufunc, or by a function of two Columns."""
    if hasattr(how, "reduceat"):

        @F.pandas_udf(kind.simpleString())
        def reduced(cells):
            import numpy as np

            return cells.map(lambda v: how.reduce(np.asarray(v)).item())

        return reduced(values)
    return F.reduce(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: how(a, x).cast(kind))


def _ordered(frame: Frame, names: list[str], name: str) -> Frame:
    from ..functions.ordering import SortKey, with_position

    keys = (*(SortKey(n) for n in names), *frame.order)
    return frame._with(with_position(frame.df, keys, name))
