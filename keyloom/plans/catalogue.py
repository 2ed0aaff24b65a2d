"""The catalogue: a query for each operator on the driver's tables, each through the frame's own methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import merged_key
from ..operators.frame import POSITION, Frame
from ..operators.joins import join
from ..operators.setops import concat, intersect
from .registry import ORACLE_SQL as ORACLE_SQL
from .registry import QUERIES as QUERIES
from .registry import labelled, only, orders, query, rows


# -- projection and schema ------------------------------------------------------------------------------------


@query
def project_keep_index(t):
    return t("orders", "o_orderkey")[["o_totalprice"]]


@query
def filter_mask(t):
    o = t("orders")
    return only(o.take((o["o_orderstatus"] == "F") & (o["o_totalprice"] > 100000)), "o_orderkey", "o_orderstatus", "o_totalprice")


@query
def take_positions(t):
    o = orders(t)
    n = len(o)
    return only(o[["o_orderkey", "o_totalprice"]].take([0, 5, 5, min(14999, n - 1)]), "o_orderkey", "o_totalprice", k=F.col(POSITION))


@query
def iloc_slice(t):
    return only(orders(t)[["o_orderkey"]].iloc[10:100:7], "o_orderkey", pos=F.col(POSITION))


@query
def iloc_row(t):
    o = orders(t)[["o_orderkey", "o_custkey"]]
    row = o.iloc[42]
    return o.df.sparkSession.createDataFrame([(row["o_orderkey"], row["o_custkey"])], "o_orderkey long, o_custkey long")


@query
def set_column_scalar(t):
    o = t("orders")[["o_orderkey"]]
    o["flag"] = 2
    return o.astype({"flag": "bigint"})


@query
def rename_swap(t):
    return t("orders")[["o_orderkey", "o_custkey"]].rename({"o_orderkey": "o_custkey", "o_custkey": "o_orderkey"})


@query
def astype_trunc(t):
    return t("orders")[["o_orderkey", "o_totalprice"]].rename({"o_totalprice": "total"}).astype({"total": "bigint"})


@query
def drop_column(t):
    o = t("orders")
    del o["o_orderdate"]
    return o


@query
def set_reset_index_drop(t):
    return t("orders")[["o_orderkey", "o_custkey", "o_totalprice"]].set_index("o_orderkey").reset_index(drop=True)


@query
def shape(t):
    o = t("orders")
    return rows(o, "rows long, cols long", [o.shape])


@query
def key_merge(t):
    o = t("orders").df
    return o.select("o_orderkey", F.hex(merged_key(o, ["o_orderkey", "o_custkey"])).alias("h"))


# -- predicates and nulls -------------------------------------------------------------------------------------


@query
def isnull_mask(t):
    f = labelled(t)
    return only(f, "doc_id", isnull=f.isnull("quality"), notnull=f.notnull("quality"))


@query
def isnull_nan(t):
    e = with_gaps(t)
    return only(e, "event_id", m=e.isnull("v"))


def with_gaps(t) -> Frame:
    """Events with a value that is NaN for every fifth and NULL for every seventh."""
    e = t("events")
    return e.with_column("v", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")))


@query
def fillna_column(t):
    return labelled(t)[["doc_id", "quality"]].fillna(5, "quality")


@query
def fillna_all(t):
    return labelled(t)[["doc_id", "quality", "toxic"]].set_index("doc_id").fillna(5)


@query
def isin_mask(t):
    o = t("orders")
    return only(o, "o_orderkey", m=o.isin("o_orderpriority", {"1-URGENT", "2-HIGH"}))


@query
def isin_invert(t):
    o = t("orders")
    return only(o, "o_orderkey", m=o.isin("o_orderpriority", {"1-URGENT", "2-HIGH"}, invert=True))


@query
def semi_join_isin(t):
    c = t("customer")
    return t("orders")[["o_orderkey", "o_custkey"]].isin_frame("o_custkey", c.take(c["c_mktsegment"] == "BUILDING"), "c_custkey")[["o_orderkey"]]


@query
def anti_join_isin_invert(t):
    c = t("customer")
    return t("orders")[["o_orderkey", "o_custkey"]].isin_frame("o_custkey", c.take(c["c_mktsegment"] == "BUILDING"), "c_custkey", invert=True)[["o_orderkey"]]


@query
def nonemin_nonemax(t):
    e = t("events")
    return rows(e, "lo double, hi double", [(e.nonemin("value"), e.nonemax("value"))])


@query
def nonemin_nan(t):
    e = t("events")
    e = e.with_column("v", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rows(e, "lo double, hi double", [(e.nonemin("v"), e.nonemax("v"))])


# -- order, distinct, duplicates ------------------------------------------------------------------------------


@query
def unique_sorted(t):
    return only(t("orders").unique("o_orderpriority").ranked("r"), "o_orderpriority", "r")


@query
def unique_unordered(t):
    return t("events").unique("user_id", unordered=True)


@query
def duplicated_first(t):
    o = orders(t)
    return only(o, "o_orderkey", dup=o.duplicated("o_custkey"))


@query
def duplicated_last(t):
    o = orders(t)
    return only(o, "o_orderkey", dup=o.duplicated("o_custkey", keep="last"))


@query
def drop_duplicates_first(t):
    return only(orders(t)[["o_custkey", "o_orderkey"]].drop_duplicates("o_custkey"), "o_custkey", "o_orderkey")


@query
def drop_duplicates_last(t):
    return only(orders(t)[["o_custkey", "o_orderstatus", "o_orderkey"]].drop_duplicates(["o_custkey", "o_orderstatus"], keep="last"), "o_custkey", "o_orderstatus", "o_orderkey")


@query
def drop_duplicates_all(t):
    return t("lineitem")[["l_returnflag", "l_linestatus"]].drop_duplicates()


@query
def sort_values_rank(t):
    return only(orders(t)[["o_orderkey", "o_orderstatus", "o_totalprice"]].sort_values(["o_orderstatus", "o_totalprice"]).ranked("r"), "o_orderkey", "r")


@query
def sort_values_desc_ties(t):
    return only(orders(t)[["o_orderkey", "o_orderpriority"]].sort_values("o_orderpriority", ascending=False).ranked("r"), "o_orderkey", "r")


@query
def sort_na_last(t):
    return only(labelled(t)[["doc_id", "quality"]].sort_values("quality", na_position="last").ranked("r"), "doc_id", "r")


@query
def sort_na_first_desc(t):
    return only(labelled(t)[["doc_id", "quality"]].sort_values("quality", ascending=False, na_position="first").ranked("r"), "doc_id", "r")


@query
def sort_index(t):
    o = t("orders", ("o_custkey", "o_orderkey"), "o_orderkey")[[]]
    return only(o.sort_index().ranked("r"), "o_custkey", "o_orderkey", "r")


@query
def top_k(t):
    return only(orders(t)[["o_orderkey", "o_totalprice"]].sort_values("o_totalprice", ascending=False).head(10), "o_orderkey", "o_totalprice")


# -- groups ---------------------------------------------------------------------------------------------------


@query
def groupby_sum(t):
    f = t("lineitem").groupby("l_returnflag", "l_linestatus").agg(s=("l_linenumber", "add"), q=("l_quantity", "add"), c=(F.lit(1), "count"))
    return f.with_column("q", F.round("q", 2))


@query
def groupby_minmax(t):
    return t("orders").groupby("o_custkey").agg(lo=("o_totalprice", "min"), hi=("o_totalprice", "max"))


@query
def groupby_bool(t):
    return t("orders").groupby("o_custkey").agg(a=(F.col("o_totalprice") > 1000, "and"), o=(F.col("o_orderstatus") == "F", "or"))


@query
def groupby_counts(t):
    return t("orders").groupby("o_custkey", "o_orderstatus").counts()


@query
def groupby_group_indexes(t):
    return orders(t)[["o_custkey"]].groupby("o_custkey").group_indexes()


@query
def groupby_iter(t):
    g = orders(t)[["o_custkey"]].groupby("o_custkey").positions()
    return g.df.select("o_custkey", F.array_join(F.col("positions").cast("array<string>"), ",").alias("idx"))


@query
def groupby_external(t):
    o = orders(t)[["o_orderkey"]]
    return o.groupby([i % 2 for i in range(len(o))]).counts().rename({"key0": "k"})


@query
def groupby_first_row(t):
    return orders(t).groupby("o_custkey").first(first_total="o_totalprice")


@query
def groupby_mean(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    g = t("orders").groupby("o_custkey").agg(s=(cents, "add"), c=(F.lit(1), "count"))
    return g.df.select("o_custkey", (F.col("s").cast("double") / F.lit(100e0) / F.col("c")).alias("m"))


@query
def groupby_bits(t):
    return t("orders").groupby("o_custkey").agg(a=("o_orderkey", "bit_and"), o=("o_orderkey", "bit_or"), x=("o_orderkey", "bit_xor"))


@query
def groupby_nan_key(t):
    e = t("events").with_column("k", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(None)).otherwise((F.col("event_id") % 5).cast("double")))
    return e.groupby("k").counts().astype({"k": "bigint"})


# -- joins ----------------------------------------------------------------------------------------------------


def per_customer(t, name: str = "n", condition=None) -> Frame:
    o = t("orders")
    o = o.take(condition) if condition is not None else o
    return o.groupby("o_custkey").agg(**{name: (F.lit(1), "count")})


@query
def join_left_fill(t):
    return join(t("customer", "c_custkey")[["c_name"]], per_customer(t).rename({"o_custkey": "c_custkey"}))


@query
def join_left_dupes(t):
    return join(t("orders", "o_custkey")[["o_orderkey"]], t("customer", "c_custkey")[["c_mktsegment"]])


@query
def join_inner_three(t):
    c = t("customer").groupby("c_nationkey").agg(c=(F.lit(1), "count"))
    s = t("supplier").groupby("s_nationkey").agg(s=(F.lit(1), "count"))
    return join(t("nation", "n_nationkey")[["n_name"]], c, s, how="inner")


@query
def join_right(t):
    return join(per_customer(t), t("customer", "c_custkey")[["c_acctbal"]], how="right")


@query
def join_outer(t):
    d = t("documents", "doc_id")
    d = d.take(d["lang"] == "en")[["n_chars"]].with_column("in_l", True)
    return join(d, t("labels", "doc_id")[["quality"]], how="outer")


@query
def join_nullsafe(t):
    f = labelled(t)
    a = f.groupby("quality").agg(v=(F.lit(1), "count")).rename({"quality": "k"})
    b = f.groupby("quality").agg(w=("doc_id", "max")).rename({"quality": "k"})
    return join(a, b, how="inner")


@query
def join_suffix(t):
    return join(per_customer(t), per_customer(t, condition=F.col("o_orderstatus") == "F"), suffixes=("", "_"))


@query
def join_overlay(t):
    b = per_customer(t, condition=F.col("o_orderstatus") == "F").with_column("n", 100)
    return join(per_customer(t), b)


@query
def join_multilevel(t):
    a = t("orders").groupby("o_custkey", "o_orderstatus").agg(n=(F.lit(1), "count"))
    o = t("orders")
    b = o.take(o["o_totalprice"] > 100000).groupby("o_custkey", "o_orderstatus").agg(m=(F.lit(1), "count"))
    return join(a, b)


@query
def join_outer_three(t):
    p = t("part")

    def sizes(name, condition):
        return p.take(condition).groupby("p_size").agg(**{name: (F.lit(1), "count")}).rename({"p_size": "k"})

    return join(sizes("an", F.col("p_size") < 20), sizes("bn", F.col("p_size") > 10), sizes("cn", F.col("p_size") % 5 == 0), how="outer")


@query
def sorted_intersection(t):
    return intersect(t("customer"), "c_custkey", t("orders"), "o_custkey", "k")


# -- index ----------------------------------------------------------------------------------------------------


@query
def index_is_unique(t):
    return t("orders", "o_custkey").index.uniqueness()


@query
def index_is_monotonic(t):
    return t("lineitem", ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber"))[[]].index.monotonic()


@query
def index_diff(t):
    c = t("customer", "c_custkey")
    return orders(t)[["o_custkey"]].set_index("o_custkey").index.diff(c.take(c["c_acctbal"] > 0).index)


@query
def index_duplicated(t):
    e = t("events", ("user_id", "event_type"), "event_id")
    return only(e, "event_id", dup=e.index.duplicated())


# -- union and reshaping --------------------------------------------------------------------------------------


@query
def explode_array(t):
    return t("embeddings").explode("embedding")


@query
def explode_null_empty(t):
    e = t("embeddings")[["vec_id", "embedding"]].rename({"embedding": "e"})
    third = F.col("vec_id") % 3
    return e.with_column("e", F.when(third == 0, F.lit(None)).when(third == 1, F.filter("e", lambda x: F.lit(False))).otherwise(F.col("e"))).explode("e")


@query
def explode_words(t):
    return t("part")[["p_partkey", "p_type"]].rename({"p_type": "w"}).with_column("w", F.split("w", " ")).explode("w")


@query
def concat_strict(t):
    n = t("nation")[["n_nationkey", "n_name"]]
    return concat(n, n.take(n["n_nationkey"] < 5))


@query
def concat_nonstrict(t):
    c = t("customer")[["c_custkey", "c_acctbal"]]
    s = t("supplier")[["s_suppkey", "s_acctbal"]].rename({"s_acctbal": "c_acctbal"})
    return concat(c, s, strict=False)


@query
def flagship(t):
    """Orders by nation: two joins on the index, membership, groups, sort."""
    o = t("orders", "o_custkey")[["o_totalprice", "o_orderpriority"]]
    o = o.take(o.isin("o_orderpriority", ("1-URGENT", "2-HIGH")))
    c = join(o, t("customer", "c_custkey")[["c_nationkey"]]).set_index("c_nationkey").astype({"c_nationkey": "int"})
    n = join(c, t("nation", "n_nationkey")[["n_name"]])
    g = n.groupby("n_name").agg(orders=(F.lit(1), "count"), total=("o_totalprice", "add"))
    return g.with_column("total", F.round("total", 2)).sort_values("orders", ascending=False)
