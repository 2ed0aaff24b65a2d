"""The indexed frame: a Spark DataFrame, the names of its index columns and the order of its rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import canonical, null_pred
from ..functions.ordering import SortKey, columns, order_value, with_position

HIDDEN = "__kl_"
POSITION = HIDDEN + "position"
#: Positions from either end that a top-k answers; those beyond take the dense positions of all rows.
TOP = 10_000
#: Positions that a caller's list may have to be broadcast: 16 bytes each.
BROADCAST_ROWS = 1 << 20
#: Marks Arrow fields whose strings are the JSON of a variant column.
JSON_FIELD = {b"keyloom": b"json"}


def _arrow(values: Any) -> tuple[pa.Array | pa.ChunkedArray, bool]:
    """Values as an Arrow array; dicts and cells of several types as JSON, which the flag tells."""
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values, False
    if type(values).__module__ == "numpy" and getattr(values, "dtype", None) is not None and values.dtype.kind != "O":
        return pa.array(values), False
    values = list(values)
    if not any(isinstance(v, dict) for v in values):
        try:
            return pa.array(values), False
        except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError):
            pass
    plain = lambda x: x.tolist() if hasattr(x, "tolist") else list(x)
    return pa.array([None if v is None else json.dumps(v, default=plain, ensure_ascii=False, allow_nan=False) for v in values], pa.string()), True


def _mask(rows: Any) -> list[bool] | None:
    """rows as booleans, or None where they are positions; a null is False."""
    if isinstance(rows, (pa.Array, pa.ChunkedArray)):
        return [bool(x) for x in rows.to_pylist()] if pa.types.is_boolean(rows.type) else None
    kind = getattr(getattr(rows, "dtype", None), "kind", None)
    if kind is not None:
        return rows.tolist() if kind == "b" else None
    if isinstance(rows, (list, tuple)) and rows and all(isinstance(x, bool) or type(x).__name__ in ("bool", "bool_") for x in rows):
        return [bool(x) for x in rows]
    return None


class Frame:
    """Lazy: methods extend the plan.  Those that return numbers or rows (len, shape, empty, nonemin, iloc[int]) run it."""

    __slots__ = ("df", "_index", "_order", "_laid")

    def __init__(self, df: DataFrame, index: str | Iterable[str] = (), order: str | Iterable[str | SortKey] = ()):
        index = (index,) if isinstance(index, str) else tuple(index)
        order = (order,) if isinstance(order, str) else tuple(order)
        self.df = df
        self._index = index
        self._order = tuple(k if isinstance(k, SortKey) else SortKey(k) for k in order)
        self._laid: DataFrame | None = None
        for name in [*index, *(k.name for k in self._order)]:
            if name not in df.columns:
                raise KeyError(name)

    # -- construction -----------------------------------------------------------------------------------------

    @classmethod
    def from_columns(cls, spark: SparkSession, data: Mapping[str, Any] | Iterable[Any], columns: Iterable[str] | None = None, index: str | Iterable[str] = (), dtype: Mapping[str, str] | None = None) -> Frame:
        """From a mapping of names to values, or from values with names ("0", "1", ... by default); rows keep their order.

        Dicts, and values of several types in one column, become a variant column.
        """
        if isinstance(data, Mapping):
            if columns is not None:
                raise ValueError("a mapping names its columns itself")
            named = {str(k): v for k, v in data.items()}
        else:
            values = list(data)
            names = [str(c) for c in columns] if columns is not None else [str(i) for i in range(len(values))]
            if len(names) != len(values):
                raise ValueError(f"{len(values)} columns and {len(names)} names")
            named = dict(zip(names, values, strict=True))
        arrays = {k: _arrow(v) for k, v in named.items()}
        sizes = {len(v) for v, _ in arrays.values()}
        if len(sizes) > 1:
            raise ValueError(f"columns of different lengths: {sorted(sizes)}")
        fields = [pa.field(k, v.type, metadata=JSON_FIELD if as_json else None) for k, (v, as_json) in arrays.items()]
        out = cls.from_arrow(spark, pa.Table.from_arrays([v for v, _ in arrays.values()], schema=pa.schema(fields)), index)
        return out.astype(dict(dtype)) if dtype else out

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: pa.Table, index: str | Iterable[str] = ()) -> Frame:
        """From an Arrow table, whose row order is kept; TypeError for anything else.  Fields marked as JSON become variants."""
        if not isinstance(table, pa.Table):
            raise TypeError(f"expected an Arrow table, not {type(table).__name__}")
        columns_, fields = [], []
        for field, column in zip(table.schema, table.columns, strict=True):
            kind = field.type
            if pa.types.is_null(kind):
                kind = pa.string()
            elif pa.types.is_unsigned_integer(kind):  # the next wider signed type; 64 bits need a decimal
                kind = {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[kind.bit_width]
            elif pa.types.is_timestamp(kind):
                kind = pa.timestamp("us", kind.tz)
            elif pa.types.is_duration(kind):
                kind = pa.duration("us")
            columns_.append(column.cast(kind) if kind != column.type else column)
            fields.append(field.name)
        columns_.append(pa.array(range(len(table)), pa.int64()))
        whole = pa.table(columns_, names=[*fields, POSITION])
        held = spark.conf.get("spark.sql.timestampType", "TIMESTAMP_LTZ")
        spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
        try:
            df = spark.createDataFrame(whole)
        finally:
            spark.conf.set("spark.sql.timestampType", held)
        variants = [f.name for f in table.schema if (f.metadata or {}).get(b"keyloom") == JSON_FIELD[b"keyloom"]]
        df = df.withColumns({n: F.parse_json(F.col(f"`{n}`")) for n in variants}) if variants else df
        return cls(df, index, (POSITION,))

    def to_arrow(self) -> pa.Table:
        """All columns, those of the index included, in the order of the rows; variants as JSON.  The rows come to the driver."""
        variants = {n for n, kind in self.dtype.items() if isinstance(kind, T.VariantType)}
        table = self._sorted().select(*[F.to_json(F.col(f"`{n}`")).alias(n) if n in variants else F.col(f"`{n}`") for n in self.columns]).toArrow()
        return table.cast(pa.schema([f.with_metadata(JSON_FIELD) if f.name in variants else f for f in table.schema])) if variants else table

    def _sorted(self) -> DataFrame:
        return self.df.orderBy(*columns(self._order)) if self._order else self.df

    def _with(self, df: DataFrame, index: tuple[str, ...] | None = None, order: tuple[SortKey, ...] | None = None) -> Frame:
        out = Frame.__new__(type(self))
        out.df, out._index, out._order, out._laid = df, self._index if index is None else index, self._order if order is None else order, None
        return out

    def _into(self, other: Frame, inplace: bool) -> Frame | None:
        if not inplace:
            return other
        self.df, self._index, self._order, self._laid = other.df, other._index, other._order, other._laid
        return None

    @staticmethod
    def _quoted(names: Iterable[str]) -> list[Column]:
        return [F.col(f"`{n}`") for n in names]

    def _need(self, names: Iterable[str]) -> list[str]:
        names = list(names)
        for name in names:
            if name not in self.columns:
                raise KeyError(name)
        return names

    def _guarded(self, names: Iterable[str]) -> Frame:
        """The same rows in the same order, whatever happens to the columns `names`: order keys among them are copied."""
        hit = [k for k in self._order if k.name in set(names) and not k.name.startswith(HIDDEN)]
        if not hit:
            return self
        df, order = self.df, list(self._order)
        for k in hit:
            copy = f"{HIDDEN}{len(df.columns)}_{k.name}"
            df = df.withColumn(copy, F.col(f"`{k.name}`"))
            order = [SortKey(copy, o.ascending, o.nulls_last) if o is k else o for o in order]
        return self._with(df, order=tuple(order))

    # -- inspection -------------------------------------------------------------------------------------------

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(c for c in self.df.columns if not c.startswith(HIDDEN))

    @property
    def dtype(self) -> dict[str, T.DataType]:
        return {c: self.df.schema[c].dataType for c in self.columns}

    @property
    def order(self) -> tuple[SortKey, ...]:
        return self._order

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    @property
    def empty(self) -> bool:
        return not self.columns or self.df.isEmpty()

    @property
    def index(self):
        from .index import Index

        return Index(self)

    @property
    def iloc(self) -> Iloc:
        return Iloc(self)

    def __len__(self) -> int:
        return self.df.count()

    def __contains__(self, name: object) -> bool:
        return name in self.columns

    def __iter__(self) -> Iterator[str]:
        return iter(self.columns)

    def __str__(self) -> str:
        shown = ", ".join(f"{c}{'*' if c in self._index else ''} {kind.simpleString()}" for c, kind in self.dtype.items())
        return f"{type(self).__name__}[{shown}]"

    __repr__ = __str__

    def __sentry_repr__(self) -> str:
        return str(self)

    def iterrows(self, *names: str) -> Iterator[tuple]:
        """Rows as tuples in their order, a partition at a time; variants as Python values."""
        names = self._need(names or self.columns)
        return (tuple(x.toPython() if isinstance(x, T.VariantVal) else x for x in r) for r in self._sorted().select(*self._quoted(names)).toLocalIterator())

    def copy(self, shallow: bool = False) -> Frame:
        return self._with(self.df)

    # -- columns ----------------------------------------------------------------------------------------------

    def __getitem__(self, key: str | Iterable[str]) -> Column | Frame:
        """A name gives its column; several names give those columns and the index's."""
        if isinstance(key, str):
            return self.df[f"`{self._need([key])[0]}`"]
        names = self._need(key)
        names += [n for n in self._index if n not in names]
        kept = self._guarded(c for c in self.columns if c not in names)
        return kept._with(kept.df.select(*self._quoted([*names, *(c for c in kept.df.columns if c.startswith(HIDDEN))])))

    def __setitem__(self, name: str, value: Any) -> None:
        self._into(self.with_column(name, value), True)

    def with_column(self, name: str, value: Any) -> Frame:
        """Add or replace a column by an expression, by a scalar (cast to the column's type, if there is one) or by one value a row."""
        own = self._guarded([name])
        if isinstance(value, Column):
            return own._with(own.df.withColumn(name, value))
        if isinstance(value, (list, tuple, pa.Array, pa.ChunkedArray)) or type(value).__module__ == "numpy" and getattr(value, "ndim", 0):
            n = len(self)
            if len(value) != n:
                raise ValueError(f"{len(value)} values for {n} rows")
            added = pa.table({name: value if isinstance(value, (pa.Array, pa.ChunkedArray)) else pa.array(value), POSITION + "_": pa.array(range(n), pa.int64())})
            right = own.df.sparkSession.createDataFrame(added)
            left = own._positioned()
            at = [c for c in left.columns if c != name]
            joined = left.select(*self._quoted(at)).join(right, F.col(POSITION) == F.col(POSITION + "_"), "left").drop(POSITION + "_")
            return own._with(joined, order=(SortKey(POSITION),))
        scalar = F.lit(value)
        return own._with(own.df.withColumn(name, scalar.cast(self.df.schema[name].dataType) if name in self.df.columns else scalar))

    def __delitem__(self, name: str) -> None:
        self._into(self.drop(name), True)

    def drop(self, name: str) -> Frame:
        self._need([name])
        if name in self._index:
            raise ValueError(f"{name!r} is in the index")
        own = self._guarded([name])
        return own._with(own.df.drop(name))

    def rename(self, names: Mapping[str, str], inplace: bool = False, errors: str = "ignore") -> Frame | None:
        """Rename columns, the index's among them; renamed ones move to the end, and one that takes another's name replaces it."""
        if errors == "raise":
            self._need(names)
        moved = {a: b for a, b in names.items() if a in self.columns and a != b}
        taken = set(moved.values())
        own = self._guarded([*moved, *taken])
        kept = [c for c in own.df.columns if c not in moved and (c not in taken or c.startswith(HIDDEN))]
        df = own.df.select(*self._quoted(kept), *[F.col(f"`{a}`").alias(b) for a, b in moved.items()])
        return self._into(own._with(df, index=tuple(moved.get(n, n) for n in self._index)), inplace)

    def astype(self, dtype: str | T.DataType | Mapping[str, Any], copy: bool = True, errors: str = "raise") -> Frame:
        """Cast all columns or some.  errors="ignore" keeps a column as it is if any of its values can't be cast."""
        wanted = dict(dtype) if isinstance(dtype, Mapping) else dict.fromkeys((c for c in self.columns if c not in self._index), dtype)
        self._need(wanted)
        own = self._guarded(wanted)
        if errors == "ignore" and wanted:
            name_of = {c: k if isinstance(k, str) else k.simpleString() for c, k in wanted.items()}
            lost = own.df.agg(*[F.bool_or(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` as {k})").isNull()).alias(c) for c, k in name_of.items()]).first()
            wanted = {c: k for c, k in wanted.items() if not lost[c]}
        return own._with(own.df.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in wanted.items()}) if wanted else own.df)

    # -- rows -------------------------------------------------------------------------------------------------

    def _positioned(self, names: Iterable[str] | None = None) -> DataFrame:
        """The rows, or some of their columns, with their dense positions; those of all columns are laid out once a frame."""
        if self._laid is not None:
            return self._laid
        df, was = self.df, HIDDEN + "was"
        if names is not None:
            wanted = [*dict.fromkeys([*names, *(k.name for k in self._order)])]
            df = df.select(*self._quoted(wanted))
        if not any(k.name == POSITION for k in self._order):
            laid = with_position(df.drop(POSITION), self._order, POSITION)
        else:
            order = tuple(SortKey(was, k.ascending, k.nulls_last) if k.name == POSITION else k for k in self._order)
            laid = with_position(df.withColumnRenamed(POSITION, was), order, POSITION).drop(was)
        if names is None:
            self._laid = laid
        return laid

    def _asked(self, table: pa.Table) -> DataFrame:
        """A caller's own list as a table, broadcast while it is short."""
        df = self.df.sparkSession.createDataFrame(table)
        return F.broadcast(df) if len(table) <= BROADCAST_ROWS else df

    def take(self, rows: Column | Iterable[bool] | Iterable[int]) -> Frame:
        """Rows by a condition, by one boolean a row, or by positions, which may repeat, count from the end and come in any order.

        ValueError for booleans of another number than the rows.
        """
        if isinstance(rows, Column):
            return self._with(self.df.withColumn(HIDDEN + "mask", rows).where(F.col(HIDDEN + "mask")).drop(HIDDEN + "mask"))
        mask = _mask(rows)
        if mask is not None:
            n = len(self)
            if len(mask) != n:
                raise ValueError(f"{len(mask)} booleans for {n} rows")
            asked = self._asked(pa.table({HIDDEN + "p": pa.array([i for i, m in enumerate(mask) if m], pa.int64())}))
            return self._with(self._positioned().join(asked, F.col(POSITION) == F.col(HIDDEN + "p"), "left_semi"), order=(SortKey(POSITION),))
        wanted = [int(i) for i in (rows.to_pylist() if isinstance(rows, (pa.Array, pa.ChunkedArray)) else rows)]
        if any(i < 0 for i in wanted):
            n = len(self)
            wanted = [i + n if i < 0 else i for i in wanted]
        asked = self._asked(pa.table({HIDDEN + "k": pa.array(range(len(wanted)), pa.int64()), HIDDEN + "p": pa.array(wanted, pa.int64())}))
        out = self._positioned().join(asked, F.col(POSITION) == F.col(HIDDEN + "p")).drop(POSITION, HIDDEN + "p").withColumnRenamed(HIDDEN + "k", POSITION)
        return self._with(out, order=(SortKey(POSITION),))

    def filter(self, condition: Column) -> Frame:
        return self.take(condition)

    def head(self, k: int) -> Frame:
        """The first k rows; over an order this is a top-k, without a full sort."""
        return self._with(self._sorted().limit(k))

    def isin(self, name: str, haystack: Any, assume_unique: bool = False, invert: bool = False, verbatim: bool = False) -> Column:
        """Whether values are among others, which are cast to the column's type; nulls are in nothing.

        Zero bytes at the end of binary values do not count, unless verbatim.
        """
        kind = self.df.schema[self._need([name])[0]].dataType
        values = [v for v in haystack if v is not None and v == v]
        if isinstance(kind, T.BinaryType) and not verbatim:
            bare = F.regexp_replace(F.hex(F.col(f"`{name}`")), "(00)+$", "")
            found = F.coalesce(bare.isin([bytes(v).rstrip(b"\0").hex().upper() for v in values]) if values else F.lit(False), F.lit(False))
            return ~found if invert else found
        if isinstance(kind, T.IntegralType):
            values = [int(v) for v in values]
        c = F.col(f"`{name}`")
        # never null, and still a filter that scans can take over
        found = c.isNotNull() & c.isin(*[F.lit(v).cast(kind) for v in values]) if values else F.lit(False)
        return ~found if invert else found

    def isin_frame(self, name: str, other: Frame, other_name: str, invert: bool = False) -> Frame:
        """Rows whose value is in a column of another frame, or is not: a semi or an anti join."""
        self._need([name])
        right = other.df.select(F.col(f"`{other_name}`").alias(HIDDEN + "v")).where(F.col(HIDDEN + "v").isNotNull())
        return self._with(self.df.join(right, F.col(f"`{name}`") == F.col(HIDDEN + "v"), "left_anti" if invert else "left_semi"))

    def isnull(self, name: str) -> Column:
        return null_pred(F.col(f"`{self._need([name])[0]}`"), self.df.schema[name].dataType)

    def notnull(self, name: str) -> Column:
        return ~self.isnull(name)

    def fillna(self, value: Any, column: str | None = None, inplace: bool = False) -> Frame | None:
        """Nulls become `value`, cast to the column's type, in one column or in all that hold nulls."""
        names = self._need([column]) if column is not None else [c for c in self.columns if c not in self._index]
        own = self._guarded(names)
        out = own._with(own.df.withColumns({c: F.when(own.isnull(c), F.lit(value).cast(own.df.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for c in names}))
        return self._into(out, inplace)

    def nonemin(self, name: str) -> Any:
        return self.df.agg(F.min(F.when(self.notnull(name), F.col(f"`{name}`")))).first()[0]

    def nonemax(self, name: str) -> Any:
        return self.df.agg(F.max(F.when(self.notnull(name), F.col(f"`{name}`")))).first()[0]

    def sample(self, n: int | None = None, frac: float | None = None, replace: bool = False, weights: str | None = None, ignore_index: bool = False, seed: int | None = None) -> Frame:
        from .sampling import sample

        out = sample(self, n, frac, replace, weights, seed)
        return out._with(out.df, index=()) if ignore_index else out

    def explode(self, name: str, ignore_index: bool = False) -> Frame:
        """A row for each element; empty arrays vanish, nulls stay as one row, and so do single values among the lists of a variant column."""
        kind = self.df.schema[self._need([name])[0]].dataType
        index = () if ignore_index else self._index
        c = F.col(f"`{name}`")
        if isinstance(kind, T.ArrayType):
            safe = F.when(c.isNull(), F.array(F.lit(None).cast(kind.elementType))).otherwise(c)
        elif isinstance(kind, T.VariantType):
            listed = F.startswith(F.schema_of_variant(c), F.lit("ARRAY"))
            safe = F.when(c.isNull(), F.array(F.lit(None).cast(kind))).when(listed, F.try_variant_get(c, "$", "array<variant>")).otherwise(F.array(c))
        else:
            return self._with(self.df, index=index)
        at = f"{HIDDEN}{len(self.df.columns)}_element"
        others = [x for x in self.df.columns if x != name]
        df = self.df.select(*self._quoted(others), F.posexplode(safe).alias(at, name))
        out = df.select(*self._quoted([x for x in self.df.columns if x != at]), at)
        return self._with(out, index=index, order=(*self._order, SortKey(at)) if self._order else ())

    # -- order, duplicates, groups ------------------------------------------------------------------------------

    def sort_values(self, by: str | Iterable[str], ascending: bool = True, inplace: bool = False, kind: str = "stable", na_position: str = "last", ignore_index: bool = False, non_negative_hint: bool = False) -> Frame | None:
        """Rows by columns, all in one direction; ties keep their order, or reverse it where the sort descends.

        Nulls go where na_position says; NaN counts as null.  The hints change nothing.
        """
        names = self._need([by] if isinstance(by, str) else by)
        if not names:
            raise ValueError("no column to sort by")
        if na_position not in ("first", "last"):
            raise ValueError(f"na_position {na_position!r}")
        df, keys = self.df, []
        for name in names:
            key = name
            if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
                key = f"{HIDDEN}{len(df.columns)}_{name}"
                df = df.withColumn(key, canonical(F.col(f"`{name}`"), df.schema[name].dataType))
            keys.append(SortKey(key, ascending, na_position == "last"))
        order = (*keys, *(k if ascending else k.reversed() for k in self._order))
        return self._into(self._with(df.orderBy(*columns(order)), index=() if ignore_index else None, order=order), inplace)

    def sort_index(self, level: int | Iterable[int] | None = None, **kwargs: Any) -> Frame | None:
        if level is None:
            names = self._index
        elif isinstance(level, int):
            names = (self._index[level],)
        elif isinstance(level, (list, tuple)):
            names = tuple(self._index[k] for k in level)
        else:
            raise TypeError(f"level is a number or several, not {type(level).__name__}")
        return self.sort_values(names, **kwargs)

    def ranked(self, name: str = "rank") -> Frame:
        """The rows with their rank in the order of the frame, from 1, as a column."""
        df = self._positioned().withColumn(name, F.col(POSITION) + 1)
        return self._with(df, order=(SortKey(POSITION),))

    def _nth(self, names: Iterable[str], keep: str) -> Column:
        if keep not in ("first", "last"):
            raise ValueError(f"keep {keep!r}")
        keys = [canonical(F.col(f"`{n}`"), self.df.schema[n].dataType) for n in names]
        return F.row_number().over(Window.partitionBy(*keys).orderBy(*(columns(self._order, keep == "last") or [F.lit(0)])))

    def duplicated(self, subset: str | Iterable[str] | None = None, keep: str = "first") -> Column:
        """Whether a row repeats one that is kept."""
        names = self._need(self.columns if subset is None else [subset] if isinstance(subset, str) else subset)
        return self._nth(names, keep) > 1

    def drop_duplicates(self, subset: str | Iterable[str] | None = None, keep: str = "first", inplace: bool = False, ignore_index: bool = False) -> Frame | None:
        """One row for each value of some columns or of all, the first or last in the order of the frame, which stays; NaN and NULL are one value.

        Rows of a key meet as a minimum, which combines before the shuffle: no task holds a whole group.
        """
        names = self._need(self.columns if subset is None else [subset] if isinstance(subset, str) else subset)
        if keep not in ("first", "last"):
            raise ValueError(f"keep {keep!r}")
        keys = [canonical(F.col(f"`{n}`"), self.df.schema[n].dataType).alias(n) for n in names]
        index = () if ignore_index else None
        value = order_value(self._order)
        if not self._order and set(names) == set(self.columns):
            out = self._with(self.df.select(*keys).distinct(), index=index)
        elif self._order and value is None:  # directions are mixed
            out = self._with(self.take(~self.duplicated(names, keep)).df, index=index)
        else:
            row = F.struct(*self._quoted(self.df.columns))
            pick = F.any_value(row) if value is None else (F.min_by if (keep == "first") == value[1] else F.max_by)(row, value[0])
            grouped = self.df.groupBy(*[k.alias(f"{HIDDEN}d{i}") for i, k in enumerate(keys)]).agg(pick.alias(HIDDEN + "row"))
            out = self._with(grouped.select(HIDDEN + "row.*"), index=index)
        return self._into(out, inplace)

    def unique(self, name: str, unordered: bool = False) -> Frame:
        """The distinct values of a column, sorted unless unordered; unordered strings leave nulls out."""
        c = F.col(f"`{self._need([name])[0]}`")
        df = self.df.select(c)
        if unordered and isinstance(self.df.schema[name].dataType, T.StringType):
            df = df.where(c.isNotNull())
        df = df.select(canonical(c, self.df.schema[name].dataType).alias(name)).distinct()
        return Frame(df if unordered else df.orderBy(c.asc_nulls_last()), order=() if unordered else (name,))

    def groupby(self, *by: str | Column):
        from .grouper import Grouper

        return Grouper(self, by)

    # -- index ------------------------------------------------------------------------------------------------

    def set_index(self, index: Any, inplace: bool = False, drop: bool = False) -> Frame | None:
        """Make columns the index; drop takes the columns of the old one away.

        Levels are names, or expressions and arrays of one value a row, which become columns _index0, _index1 and so on.
        """
        levels = [index] if isinstance(index, (str, Column)) or not isinstance(index, (list, tuple)) else list(index)
        if levels and not any(isinstance(x, (str, Column)) or hasattr(x, "__len__") for x in levels):
            levels = [levels]  # one array
        source = self
        names: tuple[str, ...] = ()
        for k, level in enumerate(levels):
            if not isinstance(level, str):
                if f"_index{k}" in source.columns:
                    raise ValueError(f"a column _index{k} is there")
                source = source.with_column(f"_index{k}", level)
                level = f"_index{k}"
            names += (level,)
        if source is not self:
            return self._into(source.set_index(list(names), drop=drop), inplace)
        self._need(names)
        if len(set(names)) < len(names):
            raise ValueError("a column is in the index once")
        old = [n for n in self._index if n not in names] if drop else []
        own = self._guarded(old)
        return self._into(own._with(own.df.drop(*old), index=names), inplace)

    def reset_index(self, inplace: bool = False, drop: bool = False) -> Frame | None:
        """Forget the index; drop takes its columns away.  No column is made."""
        own = self._guarded(self._index) if drop else self
        return self._into(own._with(own.df.drop(*self._index) if drop else own.df, index=()), inplace)


class Iloc:
    """Rows by position."""

    __slots__ = ("_frame",)

    def __init__(self, frame: Frame):
        self._frame = frame

    def __getitem__(self, key: int | slice | Iterable[int]) -> Any:
        frame = self._frame
        if isinstance(key, bool) or not isinstance(key, (int, slice, list, tuple)):
            raise TypeError(f"positions are numbers, slices or lists, not {type(key).__name__}")
        if not frame._order:
            raise ValueError("rows without an order have no positions")
        if isinstance(key, int):
            row = self._row(key)
            if row is None:
                raise IndexError(key)
            return row.asDict()
        if isinstance(key, slice):
            return self._slice(key)
        return frame.take(key)

    def _row(self, key: int) -> Any:
        """The row at a position; near either end it comes from a top-k, without positions for the others."""
        frame = self._frame
        at = key if key >= 0 else -key - 1
        names = frame._quoted(frame.columns)
        if at < TOP and frame._laid is None:
            return frame.df.orderBy(*columns(frame._order, key < 0)).offset(at).limit(1).select(*names).first()
        at = key if key >= 0 else key + len(frame)
        return frame._positioned().where(F.col(POSITION) == at).select(*names).first() if at >= 0 else None

    def _slice(self, key: slice) -> Frame:
        """Rows by arithmetic on their positions, of which the hidden column keeps the old ones."""
        if key.step == 0:
            raise ValueError("a slice has a step")
        frame, p = self._frame, F.col(POSITION)
        start, stop, step = key.start or 0, key.stop, key.step or 1
        if start >= 0 and step > 0 and stop is not None and 0 <= stop <= TOP and frame._laid is None:
            near = frame._with(frame._sorted().limit(stop))  # at most TOP rows, which one task numbers
            was = [SortKey(HIDDEN + "was", k.ascending, k.nulls_last) if k.name == POSITION else k for k in frame._order]
            df = near.df.withColumnRenamed(POSITION, HIDDEN + "was")
            df = df.withColumn(POSITION, (F.row_number().over(Window.orderBy(*columns(tuple(was)))) - 1).cast("long")).drop(HIDDEN + "was")
            return frame._with(df.where((p >= start) & ((p - start) % step == 0)), order=(SortKey(POSITION),))
        if start < 0 or step < 0 or stop is not None and stop < 0:
            wanted = range(*key.indices(len(frame)))
            low, high = (min(wanted[0], wanted[-1]), max(wanted[0], wanted[-1])) if wanted else (0, -1)
        else:
            low, high = start, None if stop is None else stop - 1
        mask = (p >= low) & ((p - low) % abs(step) == 0)
        if high is not None:
            mask &= p <= high
        return frame._with(frame._positioned().where(mask), order=(SortKey(POSITION, step > 0, step > 0),))
