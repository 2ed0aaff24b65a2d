"""Queries for the methods that return values, check their arguments or exchange frames, each with its oracle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import operators, testing
from ..operators.frame import POSITION, Frame
from ..operators.joins import join
from ..operators.setops import concat
from ..sources import interchange
from .registry import answers, labelled, only, orders, raised, rows

# -- construction and inspection --------------------------------------------------------------------------------


@answers("select * from nation")
def construct_columns(t):
    n = t("nation", order="n_nationkey")
    table = n.to_arrow()
    return Frame.from_columns(n.df.sparkSession, {c: table[c] for c in n.columns}, index="n_nationkey")


@answers("select cast(n_nationkey as double) as k, n_name as v from nation")
def construct_typed(t):
    n = t("nation", order="n_nationkey")
    keys, names = zip(*n.iterrows("n_nationkey", "n_name"), strict=True)
    return Frame.from_columns(n.df.sparkSession, [list(keys), list(names)], ["k", "v"], dtype={"k": "double"})


@answers("select true as lengths, true as names, true as unknown_index, true as not_a_table")
def construct_checks(t):
    n = t("nation")
    make, spark = Frame.from_columns, n.df.sparkSession
    flags = (
        raised(ValueError, lambda: make(spark, {"a": [1], "b": [1, 2]})), raised(ValueError, lambda: make(spark, {"a": [1]}, ["a"])),
        raised(KeyError, lambda: make(spark, {"a": [1]}, index="z")), raised(TypeError, lambda: Frame.from_arrow(spark, [1])),
    )
    return rows(n, "lengths boolean, names boolean, unknown_index boolean, not_a_table boolean", [flags])


@answers("select cast(i as bigint) as i, c from (values (0, 'o_orderkey'), (1, 'o_custkey'), (2, 'o_orderstatus'), (3, 'o_totalprice'), (4, 'o_orderdate'), (5, 'o_orderpriority')) v(i, c)")
def columns_listed(t):
    o = t("orders")
    return rows(o, "i long, c string", list(enumerate(o.columns)))


@answers("select c, k from (values ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('props', 'string')) v(c, k)")
def dtype_listed(t):
    e = t("events")
    return rows(e, "c string, k string", [(c, k.simpleString()) for c, k in e.dtype.items()])


@answers("select 'orders' as name, count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'urgent', count(*) from orders where o_orderpriority = '1-URGENT'")
def length(t):
    o = t("orders")
    return rows(o, "name string, n long", [("orders", len(o)), ("lineitem", len(t("lineitem"))), ("urgent", len(o.take(o["o_orderpriority"] == "1-URGENT")))])


@answers("select (select count(*) from orders) = 0 as whole, (select count(*) from orders where o_orderkey < 0) = 0 as filtered, true as no_columns, (select count(*) from orders) = 0 as by_index")
def empty_flags(t):
    o = t("orders", "o_custkey")
    bare = Frame(o.df.select("o_custkey")).drop("o_custkey")
    return rows(o, "whole boolean, filtered boolean, no_columns boolean, by_index boolean", [(o.empty, o.take(o["o_orderkey"] < 0).empty, bare.empty, o.index.empty)])


@answers("select k, m from (values ('o_orderkey', true), ('orderkey', false), ('o_custkey', true), ('', false)) v(k, m)")
def contains_column(t):
    o = t("orders")
    return rows(o, "k string, m boolean", [(k, k in o) for k in ("o_orderkey", "orderkey", "o_custkey", "")])


@answers("select c from (values ('r_regionkey'), ('r_name')) v(c)")
def iterate_columns(t):
    r = t("region")
    return rows(r, "c string", [(c,) for c in r])


@answers("select 'Frame[r_regionkey* int, r_name string]' as shown, true as same")
def text_form(t):
    r = t("region", "r_regionkey")
    return rows(r, "shown string, same boolean", [(str(r), str(r) == repr(r) == r.__sentry_repr__())])


@answers("select cast(row_number() over (order by r_name desc) - 1 as bigint) as i, r_name, r_regionkey from region")
def iterate_rows(t):
    r = t("region").sort_values("r_name", ascending=False)
    return rows(r, "i long, r_name string, r_regionkey int", [(i, *x) for i, x in enumerate(r.iterrows("r_name", "r_regionkey"))])


@answers("select cast(2 as bigint) as before, cast(3 as bigint) as after, true as index_stays")
def copy_apart(t):
    r = t("region", "r_regionkey")
    c = r.copy()
    c["x"] = 1
    return rows(r, "before long, after long, index_stays boolean", [(len(r.columns), len(c.columns), c.index.names == r.index.names)])


@answers("select true as missing, true as missing_list, true as in_index, true as renamed, true as no_key, true as wrong_length")
def column_checks(t):
    o = t("orders", "o_orderkey")
    flags = (
        raised(KeyError, lambda: o["zz"]), raised(KeyError, lambda: o[["zz"]]), raised(ValueError, lambda: o.drop("o_orderkey")),
        raised(KeyError, lambda: o.rename({"zz": "a"}, errors="raise")), raised(KeyError, lambda: o.drop("zz")), raised(ValueError, lambda: o.with_column("a", [1])),
    )
    return rows(o, "missing boolean, missing_list boolean, in_index boolean, renamed boolean, no_key boolean, wrong_length boolean", [flags])


@answers("select o_orderkey, row_number() over (order by o_orderkey) * 10 - 10 as x from orders")
def set_column_array(t):
    o = orders(t)[["o_orderkey"]]
    o["x"] = np.arange(len(o)) * 10
    return o


@answers("select o_orderkey, cast(trunc(o_totalprice) as integer) as o_totalprice, o_orderpriority from orders")
def astype_ignore(t):
    return t("orders")[["o_orderkey", "o_totalprice", "o_orderpriority"]].astype({"o_totalprice": "int", "o_orderpriority": "int"}, errors="ignore")


# -- rows -------------------------------------------------------------------------------------------------------

_POSITIONS = "(select *, row_number() over (order by o_orderkey) - 1 as pos from orders) o"


@answers(f"select o_orderkey, o_totalprice from {_POSITIONS} where pos % 3 = 0 or pos % 7 = 1")
def take_mask_array(t):
    o = orders(t)[["o_orderkey", "o_totalprice"]]
    return o.take([i % 3 == 0 or i % 7 == 1 for i in range(len(o))])


@answers(f"select o_orderkey from {_POSITIONS} where pos % 2 = 1")
def take_mask_numpy(t):
    o = orders(t)[["o_orderkey"]]
    return o.take(np.arange(len(o)) % 2 == 1)


@answers("select true as too_short, true as empty_list, true as out_of_range, true as wrong_type, true as no_order")
def take_checks(t):
    o = orders(t)
    flags = (
        raised(ValueError, lambda: o.take([True, False])), o.take([]).empty, raised(IndexError, lambda: o.iloc[len(o)]), raised(TypeError, lambda: o.iloc["a"]),
        raised(ValueError, lambda: t("orders").iloc[0]),
    )
    return rows(o, "too_short boolean, empty_list boolean, out_of_range boolean, wrong_type boolean, no_order boolean", [flags])


@answers("select o_orderkey, row_number() over (order by o_orderkey desc) as r from orders")
def iloc_reverse(t):
    return only(orders(t)[["o_orderkey"]].iloc[::-1].ranked("r"), "o_orderkey", "r")


@answers(f"select o_orderkey, pos from {_POSITIONS}, (select count(*) as n from orders) where pos >= n - 500 and pos < n - 2 and (pos - (n - 500)) % 3 = 0")
def iloc_tail(t):
    return only(orders(t)[["o_orderkey"]].iloc[-500:-2:3], "o_orderkey", pos=F.col(POSITION))


@answers(f"select k, o_orderkey from {_POSITIONS} join (values (0, 7), (1, 3), (2, 3), (3, 0)) v(k, p) on pos = p union all select 4, max(o_orderkey) from orders")
def iloc_list(t):
    return only(orders(t)[["o_orderkey"]].iloc[[7, 3, 3, 0, -1]], "o_orderkey", k=F.col(POSITION).cast("int"))


@answers("select max(o_orderkey) as last, (select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey desc) as r from orders) where r = 3) as third_last from orders")
def iloc_last_row(t):
    o = orders(t)[["o_orderkey"]]
    return rows(o, "last long, third_last long", [(o.iloc[-1]["o_orderkey"], o.iloc[-3]["o_orderkey"])])


@answers("select k, n_nationkey from (values (0, 0), (1, 24), (2, 0), (3, 2), (4, 4)) v(k, n_nationkey)")
def concat_iloc(t):
    n = t("nation", order="n_nationkey")[["n_nationkey", "n_name"]]
    whole = concat(n, n.take(n["n_nationkey"] < 5))
    return rows(n, "k int, n_nationkey int", [(k, whole.iloc[p]["n_nationkey"]) for k, p in enumerate((0, 24, 25, 27, -1))])


@answers("select user_id, event_type, row_number() over (order by first) as r from (select user_id, event_type, min(event_id) as first from events group by user_id, event_type)")
def drop_duplicates_iloc(t):
    e = t("events", order="event_id")[["user_id", "event_type"]]
    return only(e.drop_duplicates().ranked("r"), "user_id", "event_type", "r")


@answers("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) as r from events where event_id >= 0) where r = 1 order by event_id limit 1")
def drop_duplicates_first_row(t):
    e = t("events", order="event_id")[["user_id", "event_type", "event_id"]]
    row = e.drop_duplicates(["user_id", "event_type"]).iloc[0]
    return rows(e, "user_id long, event_type string, event_id long", [(row["user_id"], row["event_type"], row["event_id"])])


def with_holes(t) -> Frame:
    """Events with a value that is NaN for every fifth, NULL for the next, and else a small number."""
    e = t("events", order="event_id")
    return e.with_column("v", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(None)).otherwise((F.col("event_id") % 11).cast("double")))


_HOLES = "(select *, case when event_id % 5 = 0 then cast('NaN' as double) when event_id % 5 = 1 then null else cast(event_id % 11 as double) end as v from events) e"


@answers(f"select distinct case when isnan(v) then null else v end as v from {_HOLES}")
def drop_duplicates_nan(t):
    f = with_holes(t)[["v"]].drop_duplicates()
    return f.df.select(F.when(f.notnull("v"), F.col("v")).alias("v"))


@answers(f"select event_id from (select event_id, row_number() over (partition by case when isnan(v) then null else v end, event_type order by event_id desc) as r from {_HOLES}) where r = 1")
def drop_duplicates_nan_last(t):
    return with_holes(t).drop_duplicates(["v", "event_type"], keep="last")[["event_id"]]


@answers("select true as unknown, true as keep, true as empty_sort, true as level")
def order_checks(t):
    o = orders(t)
    flags = raised(KeyError, lambda: o.drop_duplicates("ab")), raised(ValueError, lambda: o.drop_duplicates("o_custkey", keep="none")), raised(ValueError, lambda: o.sort_values([])), raised(TypeError, lambda: o.sort_index(level="a"))
    return rows(o, "unknown boolean, keep boolean, empty_sort boolean, level boolean", [flags])


@answers("select o_orderkey, o_orderstatus = 'F' as m, false as v, o_orderstatus <> 'F' as i from orders")
def isin_binary(t):
    o = t("orders").with_column("b", F.concat(F.col("o_orderstatus").cast("binary"), F.unhex(F.lit("0000"))))
    return only(o, "o_orderkey", m=o.isin("b", {b"F\0"}), v=o.isin("b", {b"F\0"}, verbatim=True), i=o.isin("b", [b"F"], invert=True))


@answers("select o_orderkey, o_custkey in (1, 2, 3) as k, o_custkey in (4, 5) as v, o_custkey in (7, 9) as a, o_custkey in (2, 8) as f, false as none from orders")
def isin_haystacks(t):
    o = t("orders")
    d = {1: 4, 2: 5, 3: 5}
    return only(o, "o_orderkey", k=o.isin("o_custkey", d.keys()), v=o.isin("o_custkey", d.values()), a=o.isin("o_custkey", np.array([7, 9])), f=o.isin("o_custkey", (2.9, 8.1)), none=o.isin("o_custkey", ()))


@answers("select distinct lang from documents where lang <> 'de'")
def unique_unordered_text(t):
    d = t("documents")
    return d.with_column("lang", F.when(F.col("lang") != "de", F.col("lang"))).unique("lang", unordered=True)


@answers("select distinct hex(encode(lang)) as lang from documents")
def unique_unordered_bytes(t):
    d = t("documents")
    u = d.with_column("lang", F.col("lang").cast("binary")).unique("lang", unordered=True)
    return u.with_column("lang", F.hex("lang"))


@answers("select cast(null as double) as lo, cast(null as double) as hi, (select min(event_type) from events) as text")
def nonemin_none(t):
    e = t("events")
    none = e.take(e["event_id"] < 0)
    return rows(e, "lo double, hi double, text string", [(none.nonemin("value"), none.nonemax("value"), e.nonemin("event_type"))])


# -- groups -----------------------------------------------------------------------------------------------------


@answers(f"select user_id, coalesce(bool_or(isnan(v)), false) as nan, case when coalesce(bool_or(isnan(v)), false) then null else min(v) end as lo, case when coalesce(bool_or(isnan(v)), false) then null else max(v) end as hi from {_HOLES} group by user_id")
def groupby_min_nan(t):
    g = with_holes(t).groupby("user_id").agg(lo=("v", "min"), hi=("v", "max"))
    nan = F.coalesce(F.isnan("lo"), F.lit(False))
    return only(g, "user_id", nan=nan, lo=F.when(~nan, F.col("lo")), hi=F.when(~F.isnan("hi"), F.col("hi")))


@answers(f"select user_id, max(case when isnan(v) then null else 2 * v end) as hi, min(case when isnan(v) then null else v + 1 end) as lo from {_HOLES} group by user_id")
def groupby_fmax_expr(t):
    return with_holes(t).groupby("user_id").agg(hi=(F.col("v") * 2, "fmax"), lo=(F.col("v") + 1, "fmin"))


@answers(f"select case when isnan(v) then null else v end as k, count(*) as c from {_HOLES} group by 1")
def groupby_expr_nan_key(t):
    return with_holes(t).groupby(F.col("v") * 1).counts().rename({"key0": "k"})


@answers("select o_custkey, cast(sum(o_orderkey) as bigint) as s, max(o_orderkey) as m, bit_or(o_orderkey) as o, bit_xor(o_orderkey) as x, bool_or(o_orderstatus = 'F') as f from orders group by o_custkey")
def groupby_ufunc(t):
    k = "o_orderkey"
    return t("orders").groupby("o_custkey").agg(s=(k, np.add), m=(k, np.maximum), o=(k, np.bitwise_or), x=(k, np.bitwise_xor), f=(F.col("o_orderstatus") == "F", np.logical_or))


@answers("select o_custkey, cast(2 * arg_min(o_orderkey, o_orderkey) - sum(o_orderkey) as bigint) as d, list_reduce(list(o_orderkey order by o_orderkey), lambda a, x: (a * 31 + x) % 1000003) as h from orders group by o_custkey")
def groupby_fold(t):
    return orders(t).groupby("o_custkey").agg(d=("o_orderkey", np.subtract), h=("o_orderkey", lambda a, x: (a * 31 + x) % 1000003))


@answers('select o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 as "order" from orders')
def grouper_order(t):
    return only(orders(t)[["o_custkey", "o_orderkey"]].groupby("o_custkey").order("order"), "o_orderkey", "order")


@answers("select o_custkey, count(*) as n, max(o_orderkey) - min(o_orderkey) as span from orders group by o_custkey")
def grouper_apply(t):
    def span(group: pa.Table) -> pa.Table:
        keys = group["o_orderkey"].to_numpy()
        return pa.table({"o_custkey": group["o_custkey"][:1], "n": [len(keys)], "span": [int(keys.max() - keys.min())]})

    return t("orders")[["o_custkey", "o_orderkey"]].groupby("o_custkey").apply(span, "o_custkey long, n long, span long")


@answers("select true as no_key, true as wrong_type, true as unknown, true as wrong_length")
def groupby_checks(t):
    o = t("orders", order="o_orderkey")
    flags = raised(ValueError, o.groupby), raised(TypeError, lambda: o.groupby(3)), raised(KeyError, lambda: o.groupby("zz")), raised(ValueError, lambda: o.groupby([0, 1]))
    return rows(o, "no_key boolean, wrong_type boolean, unknown boolean, wrong_length boolean", [flags])


# -- joins and the index ----------------------------------------------------------------------------------------


@answers("select o.o_custkey, o.o_orderkey, row_number() over (order by o.o_custkey, o.o_orderkey) as r from orders o left join customer c on o.o_custkey = c.c_custkey")
def join_sorted(t):
    o = t("orders", "o_custkey", "o_orderkey")[["o_orderkey"]]
    return only(join(o, t("customer", "c_custkey")[["c_name"]]).ranked("r"), "o_custkey", "o_orderkey", "r")


@answers("select true as types, true as depths, true as no_index, true as nothing, true as unknown_how, true as suffixes, true as many_to_many, true as not_a_method")
def join_checks(t):
    o, c = t("orders", "o_custkey")[["o_orderkey"]], t("customer", "c_custkey")[["c_name"]]
    named = c.set_index("c_name")
    flags = (
        raised(ValueError, lambda: join(o, named)), raised(ValueError, lambda: join(o, c.set_index(["c_custkey", "c_name"]))), raised(ValueError, lambda: join(o.reset_index(), c)),
        raised(ValueError, join), raised(ValueError, lambda: join(o, c, how="cross")), raised(ValueError, lambda: join(o, c, suffixes=("_",))),
        raised(NotImplementedError, lambda: join(c, o, validate="m:1")), not hasattr(o, "join") and not hasattr(o, "concat"),
    )
    return rows(o, "types boolean, depths boolean, no_index boolean, nothing boolean, unknown_how boolean, suffixes boolean, many_to_many boolean, not_a_method boolean", [flags])


@answers("select true as columns, true as indexes, true as nothing, true as not_a_method, count(*) as n from nation")
def concat_checks(t):
    n, r = t("nation"), t("region")
    flags = raised(ValueError, lambda: concat(n, r)), raised(ValueError, lambda: concat(n, n.set_index("n_name"))), raised(ValueError, concat), raised(AttributeError, lambda: n.concat), len(concat(n))
    return rows(n, "columns boolean, indexes boolean, nothing boolean, not_a_method boolean, n long", [flags])


@answers("select count(*) as n, cast(2 as bigint) as nlevels, 'o_custkey,o_orderkey' as names, '(o_custkey, o_orderkey), unique' as shown, 'o_orderkey' as name, true as no_name, true as no_values, true as no_level from orders")
def index_inspected(t):
    o = t("orders", ("o_custkey", "o_orderkey"))
    i = o.index
    row = len(i), i.nlevels, ",".join(i.names), str(i), t("orders", "o_orderkey").index.name, raised(ValueError, lambda: i.name), raised(AttributeError, lambda: i.values), raised(IndexError, lambda: i.get_level_values(-1))
    return rows(o, "n long, nlevels long, names string, shown string, name string, no_name boolean, no_values boolean, no_level boolean", [row])


@answers("select 'values' as what, o_orderkey as k from orders union all select 'level 1', o_orderkey from orders union all select 'level 0', o_custkey from orders union all select 'levels', o_custkey from orders")
def index_levels(t):
    one, two = t("orders", "o_orderkey").index, t("orders", ("o_custkey", "o_orderkey")).index
    parts = {"values": one.values, "level 1": two.get_level_values(1), "level 0": two.get_level_values(0), "levels": two.levels[0]}
    tables = [df.select(F.lit(what).alias("what"), F.col(df.columns[0]).alias("k")) for what, df in parts.items()]
    return tables[0].unionAll(tables[1]).unionAll(tables[2]).unionAll(tables[3])


@answers("select true as sorted_down, bool_and(p is null or p >= o_custkey) as by_customer, false as up from (select o_custkey, lag(o_custkey) over (order by o_orderkey desc) as p from orders)")
def index_is_monotonic_decreasing(t):
    o = t("orders", "o_orderkey").sort_values("o_orderkey", ascending=False)
    return rows(o, "sorted_down boolean, by_customer boolean, up boolean", [(o.index.is_monotonic_decreasing, o.set_index("o_custkey").index.is_monotonic_decreasing, o.index.is_monotonic_increasing)])


@answers("select bool_and(p is null or p <= o_custkey) as mono from (select o_custkey, lag(o_custkey) over (order by o_orderkey) as p from orders)")
def index_is_monotonic_rows(t):
    return t("orders", "o_custkey", "o_orderkey").index.monotonic()


@answers("select row_number() over (order by o_orderkey) - 1 as _index0, o_orderkey from orders")
def set_index_array(t):
    o = orders(t)[["o_orderkey"]]
    return o.set_index(np.arange(len(o)))[["o_orderkey"]]


@answers("select true as same, true as other_values, true as other_columns, true as other_index, true as keys, true as other_keys")
def testing_helpers(t):
    n = t("nation", "n_nationkey", "n_nationkey")
    equal, keys = testing.assert_frame_equal, testing.assert_index_equal
    flags = (
        not raised(AssertionError, lambda: equal(n, n.copy())), raised(AssertionError, lambda: equal(n, n.with_column("n_name", "x"))), raised(AssertionError, lambda: equal(n, n.drop("n_name"))),
        raised(AssertionError, lambda: equal(n, n.reset_index())), not raised(AssertionError, lambda: keys(n, n.drop("n_name"))), raised(AssertionError, lambda: keys(n, n.iloc[::-1])),
    )
    return rows(n, "same boolean, other_values boolean, other_columns boolean, other_index boolean, keys boolean, other_keys boolean", [flags])


@answers("select p, w from (values (0, '1'), (0, '\"two\"'), (1, '3'), (2, null), (4, '{\"a\":[5]}')) v(p, w)")
def explode_mixed(t):
    f = Frame.from_columns(t("nation").df.sparkSession, {"p": [0, 1, 2, 3, 4], "w": [[1, "two"], 3, None, [], {"a": [5]}]}, index="p")
    f = f.explode("w")
    return f.df.select(F.col("p").cast("int").alias("p"), F.to_json("w").alias("w"))


# -- samples and interchange ------------------------------------------------------------------------------------


def sampled(t, name: str, **how):
    """A sample's size, and whether it holds rows of the table alone, once each."""
    o = t("orders")
    s = o.sample(**how)
    s = s.df.select(*o.columns)
    per = s.groupBy("o_orderkey").agg(F.count("*").alias("n"))
    inside = s.join(o.df, list(o.columns), "left_semi")
    one = [s.agg(F.count("*").alias("n")), inside.agg(F.count("*").alias("inside")), per.agg((F.max("n") == 1).alias("once"))]
    return one[0].join(one[1], how="cross").join(one[2], how="cross")  # one row each


@answers("select cast(100 as bigint) as n, cast(100 as bigint) as inside, true as once")
def sample_n(t):
    return sampled(t, "n", n=100)


@answers("select cast(trunc(count(*) * 0.1) as bigint) as n, cast(trunc(count(*) * 0.1) as bigint) as inside, true as once from orders")
def sample_frac(t):
    return sampled(t, "frac", frac=0.1)


@answers("select cast(50 as bigint) as n, cast(50 as bigint) as inside, true as once")
def sample_weighted(t):
    return sampled(t, "weighted", n=50, weights="o_totalprice")


@answers("select count(*) + 7 as n, count(*) + 7 as inside, false as once from orders")
def sample_replaced(t):
    return sampled(t, "replaced", n=len(t("orders")) + 7, replace=True)


@answers("select true as both, true as neither, true as too_many, true as index_gone")
def sample_checks(t):
    r = t("region", "r_regionkey")
    flags = raised(ValueError, lambda: r.sample(n=1, frac=0.5)), raised(ValueError, r.sample), raised(ValueError, lambda: r.sample(n=6)), r.sample(n=2, ignore_index=True).index.names == ()
    return rows(r, "both boolean, neither boolean, too_many boolean, index_gone boolean", [flags])


@answers("select * from nation")
def serialize_roundtrip(t):
    n = t("nation", "n_nationkey", "n_nationkey")
    return interchange.deserialize(n.df.sparkSession, interchange.serialize(n))


@answers("select p_partkey, array_to_string(string_split(p_type, ' '), '|') as words, p_name, case when p_size > 25 then p_size end as size, p_size * 2 as twice, p_brand as brand from part")
def serialize_objects(t):
    p = t("part", "p_partkey", "p_partkey")[["p_name", "p_type", "p_size", "p_brand"]]
    p = p.with_column("words", F.split("p_type", " ")).with_column("size", F.when(F.col("p_size") > 25, F.col("p_size"))).with_column("doc", F.parse_json(F.to_json(F.struct((F.col("p_size") * 2).alias("twice"), F.col("p_brand").alias("brand")))))
    back = interchange.deserialize(p.df.sparkSession, interchange.serialize(p))
    doc = lambda path, kind: F.variant_get("doc", path, kind)
    return only(back, "p_partkey", "p_name", "size", words=F.array_join("words", "|"), twice=doc("$.twice", "int"), brand=doc("$.brand", "string"))


class Labelled(Frame):
    """A frame of a class of its own, for the round trip."""

    __slots__ = ()


@answers("select 'Labelled' as kind, 'n_nationkey' as index_names, true as prefixes_raise, true as rest_raises, true as other_bytes_raise, true as reversed_raises")
def serialize_checks(t):
    n = Labelled(t("nation").df, "n_nationkey", "n_nationkey")
    spark, raw = n.df.sparkSession, interchange.serialize(n)
    back = interchange.deserialize(spark, raw)
    bad = lambda b: raised(interchange.CorruptedBuffer, lambda: interchange.deserialize(spark, b))
    row = type(back).__name__, ",".join(back.index.names), all(bad(raw[:i]) for i in range(len(raw))), bad(raw + b"\0"), bad(b"\0" * len(raw)), bad(raw[::-1])
    return rows(n, "kind string, index_names string, prefixes_raise boolean, rest_raises boolean, other_bytes_raise boolean, reversed_raises boolean", [row])


@answers("select * from nation")
def arrow_roundtrip(t):
    n = t("nation", order="n_nationkey")
    return Frame.from_arrow(n.df.sparkSession, n.to_arrow())


@answers("select cast(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'r': [n_regionkey], 'none': null, 'yes': true}) as varchar) as j from nation")
def json_dumps(t):
    n = t("nation", order="n_nationkey")
    made = [{"n_nationkey": k, "n_name": name, "r": [r], "none": None, "yes": True} for k, name, r in n.iterrows("n_nationkey", "n_name", "n_regionkey")]
    return rows(n, "j string", [(interchange.json_dumps(x).decode(),) for x in made])


@answers("select true as nan, true as other_type, true as other_key, '[]' as empty_list, '{}' as empty_dict")
def json_checks(t):
    dumps = interchange.json_dumps
    flags = raised(ValueError, lambda: dumps([float("nan")])), raised(ValueError, lambda: dumps({"a": {1, 2}})), raised(ValueError, lambda: dumps({1: 2})), dumps([]).decode(), dumps({}).decode()
    return rows(t("nation"), "nan boolean, other_type boolean, other_key boolean, empty_list string, empty_dict string", [flags])


@answers("select doc_id, cast(to_json({'doc_id': doc_id, 'text': text, 'tags': [lang, source], 'none': null}) as varchar) as j from documents")
def json_written(t):
    d = t("documents").df
    whole = F.struct("doc_id", "text", F.array("lang", "source").alias("tags"), F.lit(None).cast("string").alias("none"))
    return d.select("doc_id", interchange.to_json(whole).alias("j"))


@answers("select doc_id, text, lang as second, cast(null as varchar) as broken from documents")
def json_read_back(t):
    d = t("documents").df.select("doc_id", interchange.to_json(F.struct("text", F.array("source", "lang").alias("tags"))).alias("j"))
    v = interchange.from_json(F.col("j"))
    broken = F.variant_get(interchange.from_json(F.concat(F.lit("{"), F.col("j"))), "$.text", "string")
    return d.select("doc_id", F.variant_get(v, "$.text", "string").alias("text"), F.variant_get(v, "$.tags[1]", "string").alias("second"), broken.alias("broken"))


@answers("select true as join_is_a_function, true as concat_is_a_function, true as no_methods")
def module_functions(t):
    n = t("nation")
    return rows(n, "join_is_a_function boolean, concat_is_a_function boolean, no_methods boolean", [(callable(operators.joins.join), callable(operators.setops.concat), not {"join", "concat"} & set(dir(n)))])


@answers("select doc_id, quality is null as m, quality is not null as n, toxic is null as o from (select d.doc_id, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id)")
def null_kernels(t):
    f = labelled(t).with_column("toxic", F.col("toxic").cast("string"))
    return only(f, "doc_id", m=f.isnull("quality"), n=f.notnull("quality"), o=f.isnull("toxic"))
