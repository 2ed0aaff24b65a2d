"""Literal cases of every operator family."""

import datetime as dt
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom import CorruptedBuffer, Frame, concat, deserialize, intersect, join, json_dumps, read_parquet, serialize, write_parquet
from keyloom.functions.keys import merged_key
from keyloom.operators.frame import HIDDEN
from keyloom.operators.sampling import _least
from keyloom.testing import assert_frame_equal, assert_index_equal

NAN = float("nan")


@pytest.fixture
def make(spark):
    return lambda data=None, index=(), **more: Frame.from_columns(spark, data or more, index=index)


def got(frame, *names):
    out = [list(c) for c in zip(*frame.iterrows(*names), strict=True)] or [[] for _ in names or frame.columns]
    return out[0] if len(names) == 1 else out


def bag(frame, *names):
    return sorted(frame.iterrows(*names), key=repr)


# -- construction, inspection, columns


def test_construction(spark, make):
    assert make(a=[1, 2], b=["x", "y"]).columns == ("a", "b")
    assert Frame.from_columns(spark, [[1], [2]]).columns == ("0", "1")
    assert Frame.from_columns(spark, [[1], [2]], ["x", "y"]).columns == ("x", "y")
    with pytest.raises(ValueError):
        Frame.from_columns(spark, {"a": [1]}, ["a"])
    with pytest.raises(ValueError):
        Frame.from_columns(spark, {"a": [1], "b": [1, 2]})
    with pytest.raises(KeyError):
        make(a=[1], index="b")
    assert Frame.from_columns(spark, {"a": [1]}, dtype={"a": "double"}).dtype["a"].simpleString() == "double"


def test_inspection(make):
    f = make(a=[1, 2], b=["x", "y"], index="a")
    assert f.shape == (2, 2) and len(f) == 2 and not f.empty and "a" in f and "z" not in f and list(f) == ["a", "b"]
    assert make(a=pa.array([], pa.int64())).empty
    assert "a* bigint" in str(f) and repr(f) == f.__sentry_repr__()
    assert list(f.iterrows("b")) == [("x",), ("y",)]
    with pytest.raises(KeyError):
        f["z"]


def test_projection_keeps_the_index(make):
    f = make(i=[1, 2], a=[3, 4], b=[5, 6], index="i")
    assert f[["b"]].columns == ("b", "i")


def test_set_and_delete(make):
    f = make(a=[1, 2, 3], index="a")
    f["b"] = 7
    assert got(f, "b") == [7, 7, 7]
    f["b"] = [4, 5, 6]
    assert got(f, "b") == [4, 5, 6]
    f["c"] = np.array([1.5, 2.5, 3.5])
    assert got(f, "c") == [1.5, 2.5, 3.5]
    f["b"] = 1.9
    assert f.dtype["b"].simpleString() == "bigint"
    with pytest.raises(ValueError):
        f["b"] = [1]
    del f["b"]
    assert f.columns == ("a", "c")
    with pytest.raises(ValueError):
        del f["a"]
    with pytest.raises(KeyError):
        del f["zz"]


def test_rename(make):
    f = make(a=[1], b=[2], c=[3], index="a")
    g = f.rename({"a": "x"})
    assert g.index.names == ("x",) and g.columns == ("b", "c", "x")
    assert got(f.rename({"b": "c", "c": "b"}), "b", "c") == [[3], [2]]
    assert got(f.rename({"b": "c"}), "c") == [2]
    assert f.rename({"zz": "y"}).columns == f.columns
    with pytest.raises(KeyError):
        f.rename({"zz": "y"}, errors="raise")
    assert f.rename({"b": "q"}, inplace=True) is None and "q" in f


def test_astype(make):
    f = make(a=[1.7, -2.2], b=["a", "1"])
    assert got(f.astype({"a": "bigint"}), "a") == [1, -2]
    assert got(f.astype({"a": "int", "b": "int"}, errors="ignore"), "b") == ["a", "1"]
    with pytest.raises(Exception):  # noqa: B017
        got(f.astype({"b": "int"}), "b")


def test_order_survives_dropping_its_column(make):
    f = make(a=[3, 1, 2], b=["x", "y", "z"]).sort_values("a")
    del f["a"]
    assert got(f, "b") == ["y", "z", "x"]


# -- rows


def test_take_and_iloc(make):
    f = make(a=[10, 20, 30, 40])
    assert got(f.take(F.col("a") > 15), "a") == [20, 30, 40]
    assert got(f.take([3, 0, 0, -1]), "a") == [40, 10, 10, 40]
    assert got(f.take([]), "a") == []
    assert f.iloc[1] == {"a": 20} and f.iloc[-1] == {"a": 40}
    assert got(f.iloc[1:], "a") == [20, 30, 40] and got(f.iloc[::2], "a") == [10, 30] and got(f.iloc[::-1], "a") == [40, 30, 20, 10]
    assert got(f.iloc[[2, 1]], "a") == [30, 20]
    for bad in (4, -5):
        with pytest.raises(IndexError):
            f.iloc[bad]
    with pytest.raises(TypeError):
        f.iloc["a"]
    assert got(f.head(2), "a") == [10, 20]


def test_isin(make):
    f = make(a=[1, 2, 3], b=["x", None, "z"], c=[1.0, NAN, None])
    assert got(f.with_column("m", f.isin("a", [2.1, 3.2, 4.3])), "m") == [False, True, True]
    assert got(f.with_column("m", f.isin("a", {1}, invert=True)), "m") == [False, True, True]
    assert got(f.with_column("m", f.isin("b", {"x": 0}.keys())), "m") == [True, False, False]
    assert got(f.with_column("m", f.isin("b", [None])), "m") == [False, False, False]
    assert got(f.with_column("m", f.isin("c", [NAN])), "m") == [False, False, False]
    assert got(f.with_column("m", f.isin("a", [])), "m") == [False] * 3
    raw = make(z=[b"a\0", b"b", b"a"])
    assert got(raw.with_column("m", raw.isin("z", [b"a"])), "m") == [True, False, True]
    assert got(raw.with_column("m", raw.isin("z", [b"a"], verbatim=True)), "m") == [False, False, True]
    other = make(k=[1, 3, 3])
    assert got(f.isin_frame("a", other, "k"), "a") == [1, 3] and got(f.isin_frame("a", other, "k", invert=True), "a") == [2]


def test_nulls(make):
    f = make(a=[1.1, NAN, 2.4], b=[None, "test", None], t=pa.array([None, dt.datetime(2020, 1, 1), None]), i=[1, 2, 3])
    for name, expected in (("a", [False, True, False]), ("b", [True, False, True]), ("t", [True, False, True]), ("i", [False] * 3)):
        assert got(f.with_column("m", f.isnull(name)), "m") == expected
        assert got(f.with_column("m", f.notnull(name)), "m") == [not x for x in expected]
    assert got(f.fillna(5, "a"), "a") == [1.1, 5.0, 2.4]
    g = f[["a", "b"]].fillna(5)
    assert got(g, "a", "b") == [[1.1, 5.0, 2.4], ["5", "test", "5"]]


def test_nonemin_nonemax(make):
    f = make(a=[None, 0.0, 1.0, NAN], b=pa.array([None] * 4, pa.int64()), s=["b", None, "a", "c"])
    assert (f.nonemin("a"), f.nonemax("a")) == (0.0, 1.0)
    assert f.nonemin("b") is None and f.nonemax("b") is None
    assert (f.nonemin("s"), f.nonemax("s")) == ("a", "c")


def test_sample(make):
    f = make(a=[1, 2, 3, 4], w=[0.0, 1.0, 1.0, 0.0])
    assert len(set(got(f.sample(n=2), "a"))) == 2 and len(f.sample(frac=0.5)) == 2
    assert len(f.sample(n=9, replace=True)) == 9
    assert set(got(f.sample(n=2, weights="w"), "a")) == {2, 3}
    assert set(got(f.sample(n=20, weights="w", replace=True), "a")) <= {2, 3}
    for bad in ({}, {"n": 1, "frac": 0.5}, {"n": 5}):
        with pytest.raises(ValueError):
            f.sample(**bad)


def test_large_samples_are_dealt_out(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 3).alias("w"), F.lit(None).alias("none"), F.expr("make_interval(0, cast(id as int), 0, 0, 0, 0, -id / 8)").alias("span"))
    f = Frame(df, index="id", order="id")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "2m"}  # small ranges stay apart
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        for n, how in ((6_000, {"frac": 0.3}), (19_999, {"n": 19_999}), (13_000, {"n": 13_000, "weights": "w"}), (15_000, {"n": 15_000, "weights": "w"})):
            out = f.sample(seed=7, **how)
            per = out.df.groupBy(F.spark_partition_id()).count().toPandas()["count"]
            assert per.sum() == n and per.max() < n / 2
            assert out.columns == f.columns and out.dtype == f.dtype and out.index.names == ("id",)
            assert out.df.where("cast(span as string) = cast(make_interval(0, cast(id as int), 0, 0, 0, 0, -id / 8) as string)").count() == n
            found = got(out.drop("span"))
            assert len(set(found[0])) == n and found[0] == sorted(found[0]) and found[1] == [k % 3 for k in found[0]] and set(found[2]) == {None}
            if "weights" not in how:  # the least draws
                least = df.select("id", F.rand(7).alias("u")).orderBy("u").limit(n).toPandas()
                assert set(least["id"]) == set(found[0])
            assert "weights" not in how or sum(k > 0 for k in found[1]) == min(n, 13_333)
        same = df.withColumn(HIDDEN + "draw", F.lit(0.99))  # none below the bound of 2,000 in 20,000
        assert _least(same, 2_000, 20_000).select("id").distinct().count() == 2_000
    finally:
        for k in held:
            spark.conf.unset(k)


def test_explode(make):
    f = make(a=[[1, 2], None, [], [3]], b=[9, 8, 7, 6])
    assert got(f.explode("a"), "a", "b") == [[1, 2, None, 3], [9, 9, 8, 6]]
    assert got(f.explode("b"), "b") == [9, 8, 7, 6]
    nested = make(a=[[[1, 2], [3]], [[4]]])
    assert got(nested.explode("a").explode("a"), "a") == [1, 2, 3, 4]


# -- order, duplicates, groups


def test_sort(make):
    f = make(a=[1.0, NAN, 2.0])
    assert str(got(f.sort_values("a", ascending=False, na_position="first"), "a")) == "[nan, 2.0, 1.0]"
    assert str(got(f.sort_values("a", ascending=False), "a")) == "[2.0, 1.0, nan]"
    g = make(a=[3, 2, 2, 1], b=[0, 0, -1, 2])
    assert got(g.sort_values(["a", "b"]), "a", "b") == [[1, 2, 2, 3], [2, -1, 0, 0]]
    h = make(a=[1, 1, 2], b=["x", "y", "z"])
    assert got(h.sort_values("a", ascending=False), "b") == ["z", "y", "x"]  # ties reverse
    assert h.sort_values("a", ascending=False).iloc[1] == {"a": 1, "b": "y"} and got(h.sort_values("a", ascending=False).take([0, 2]), "b") == ["z", "x"]
    assert got(h.sort_values("a", non_negative_hint=True, kind="quicksort"), "b") == ["x", "y", "z"]
    for bad in ([], "zz"):
        with pytest.raises((ValueError, KeyError)):
            h.sort_values(bad)
    i = make(a=[2, 1], b=[0, 5], index=("a", "b"))
    assert got(i.sort_index(), "a") == [1, 2] and got(i.sort_index(level=1), "a") == [2, 1] and got(i.sort_index(level=[1, 0]), "a") == [2, 1]
    with pytest.raises(TypeError):
        i.sort_index(level="a")


def test_duplicates(make):
    f = make(a=[1, 2, 2, 3, 5, 3, 6], b=[0, 1, 2, 3, 4, 5, 6])
    assert bag(f.drop_duplicates("a", keep="last"), "a", "b") == [(1, 0), (2, 2), (3, 5), (5, 4), (6, 6)]
    assert bag(f.drop_duplicates("a"), "b") == [(0,), (1,), (3,), (4,), (6,)]
    assert [r[0] for r in f.with_column("d", f.duplicated("a")).iterrows("d")] == [False, False, True, False, False, True, False]
    with pytest.raises(KeyError):
        f.drop_duplicates("ab")
    with pytest.raises(ValueError):
        f.duplicated("a", keep="none")
    assert bag(make(a=[NAN, None, 1.0], b=[1, 2, 3]).drop_duplicates("a"), "b") == [(1,), (3,)]


def test_unique(make):
    f = make(a=[3, 2, 2, 1], s=["x", None, "x", "y"])
    assert got(f.unique("a"), "a") == [1, 2, 3]
    assert bag(f.unique("s", unordered=True)) == [("x",), ("y",)]


def test_groups(make):
    f = make(a=[3, 3, 3, 2, 2, 1, 1], b=[9, 10, 7, 8, 4, 5, 6])
    assert bag(f.groupby("a").agg(s=("b", "add"), m=("b", "max"))) == [(1, 11, 6), (2, 12, 8), (3, 26, 10)]
    assert bag(f.groupby("a").counts()) == [(1, 2), (2, 2), (3, 3)]
    assert bag(f.groupby("a").group_indexes()) == [(1, 5), (2, 3), (3, 0)]
    assert bag(f.groupby("a").positions()) == [(1, [5, 6]), (2, [3, 4]), (3, [0, 1, 2])]
    assert bag(f.groupby("a").first(v="b")) == [(1, 5), (2, 8), (3, 9)]
    assert sorted(f.groupby("a").order().iterrows("order", "b")) == [(0, 5), (1, 6), (2, 8), (3, 4), (4, 9), (5, 10), (6, 7)]
    assert bag(f.groupby(F.col("b") % 2).counts()) == [(0, 4), (1, 3)]
    total = f.groupby("a").apply(lambda t: pa.table({"a": t["a"][:1], "n": [len(t)]}), "a long, n long")
    assert sorted(map(tuple, total.collect())) == [(1, 2), (2, 2), (3, 3)]
    assert bag(make(k=[1.0, NAN, None], v=[1.0, NAN, 3.0]).groupby("k").agg(m=("v", "fmax"), c=("v", "count"))) == [(1.0, 1.0, 1), (None, 3.0, 2)]
    assert bag(make(a=pa.array([], pa.float64())).groupby("a").counts()) == []
    assert bag(f.groupby([0, 1, 0, 1, 0, 1, 0]).counts()) == [(0, 4), (1, 3)]
    with pytest.raises(ValueError):
        f.groupby([0, 1])
    with pytest.raises(ValueError):
        f.groupby()
    with pytest.raises(TypeError):
        f.groupby(3)
    with pytest.raises(KeyError):
        f.groupby("zz")


# -- joins


def three(make):
    return make(i=[1, 2, 0], a=[4, 5, 3], index="i"), make(i=[2, 1, 7], b=[6, 7, 8], index="i"), make(i=[1, 2, 7], c=["a", "b", "c"], index="i")


def test_joins(make):
    a, b, c = three(make)
    assert bag(join(a, b)) == [(0, 3, 0), (1, 4, 7), (2, 5, 6)]
    assert bag(join(a, b, c, how="inner")) == [(1, 4, 7, "a"), (2, 5, 6, "b")]
    assert bag(join(a, b, c, how="outer", string_fill="")) == [(0, 3, 0, ""), (1, 4, 7, "a"), (2, 5, 6, "b"), (7, 0, 8, "c")]
    assert bag(join(a, b, how="right"), "i", "a", "b") == [(1, 4, 7), (2, 5, 6), (7, 0, 8)]
    assert join(a, b).columns == ("i", "a", "b") and bag(join(a)) == bag(a)


def test_join_suffixes_and_overlay(make):
    x, y = make(i=[1, 2], a=[4, 5], index="i"), make(i=[2], a=[9], index="i")
    assert bag(join(x, y, suffixes=("", "_")), "i", "a", "a_") == [(1, 4, 0), (2, 5, 9)]
    assert bag(join(x, y)) == [(1, 4), (2, 9)]
    gone = make(i=[2], a=pa.array([None], pa.float64()), index="i")
    assert bag(join(make(i=[1, 2], a=[4.0, 5.0], index="i"), gone)) == [(1, 4.0), (2, None)]  # a matched null overlays
    with pytest.raises(ValueError):
        join(x, y, suffixes=("_",))


def test_join_keys(make):
    x, y = make(k=[1.0, NAN, None], v=[1, 2, 3], index="k"), make(q=[None, 1.0], w=[5, 6], index="q")
    assert bag(join(x, y)) == [(1.0, 1, 6), (None, 2, 5), (None, 3, 5)]
    p, q = make(a=[-1, -1, 2], b=["x", "y", None], v=[1, 2, 3], index=("a", "b")), make(a=[-1, 2], b=["y", None], w=[7, 8], index=("a", "b"))
    assert bag(join(p, q), "v", "w") == [(1, 0), (2, 7), (3, 8)]
    twice = make(a=[2, 1, 1], c=[0, 1, 2], index="a")
    assert bag(join(twice, make(A=[1], b=["x"], index="A"))) == [(1, 1, "x"), (1, 2, "x"), (2, 0, None)]
    many = make(A=[1, 1], b=["x", "y"], index="A")
    assert len(join(twice, many)) == 5
    with pytest.raises(NotImplementedError):
        join(twice, many, validate="m:1")
    for bad in ((twice, make(a=["x"], index="a")), (twice, p), (twice, make(b=[1])), ()):
        with pytest.raises(ValueError):
            join(*bad)
    with pytest.raises(ValueError):
        join(twice, many, how="cross")
    with pytest.raises(ValueError):
        join(twice, make(k=[1], a=[2], index="k"))
    assert not hasattr(twice, "join") and not hasattr(twice, "concat")


# -- sets, index, interchange


def test_concat(make):
    f = make(a=[1, 2, 3], b=["x", "y", "z"])
    assert got(concat(f, f, f), "a") == [1, 2, 3] * 3
    mixed = concat(make(a=[1, 2, 3]), make(b=["x", "y"]), strict=False)
    assert got(mixed, "a", "b") == [[1, 2, 3, 0, 0], [None, None, None, "x", "y"]]
    assert got(concat(make(a=[1]), make(a=["x"])), "a") == ["1", "x"]
    assert got(concat(make(a=[1]), make(a=[0.5])), "a") == [1.0, 0.5]
    for bad in ((f, make(a=[1])), (f, f.set_index("a")), ()):
        with pytest.raises(ValueError):
            concat(*bad)
    assert bag(intersect(f, "a", make(z=[3, 1, 9, 3]), "z")) == [(1,), (3,)]


def test_concat_keeps_the_order_of_sorted_frames(spark, make):
    f = make(a=[2, None, 1, 3], b=["x", "y", "z", "x"])
    up, down = f.sort_values("a"), f.sort_values("a", ascending=False)
    by_column = Frame(spark.createDataFrame([(9, "p"), (10, "x"), (-1, "q")], "a long, b string"), order="a")
    whole = concat(up, by_column, f, down)
    expected = [v for g in (up, by_column, f, down) for v in got(g, "b")]
    assert got(whole, "b") == expected and got(whole.iloc[3:8], "b") == expected[3:8]
    assert got(concat(whole, up), "b") == expected + got(up, "b")
    first, last = (got(whole.drop_duplicates("b", keep=k), "a", "b") for k in ("first", "last"))
    rows = [r for g in (up, by_column, f, down) for r in g.iterrows("a", "b")]
    assert list(zip(*first, strict=True)) == [r for i, r in enumerate(rows) if r[1] not in [x[1] for x in rows[:i]]]
    assert list(zip(*last, strict=True)) == [r for i, r in enumerate(rows) if r[1] not in [x[1] for x in rows[i + 1 :]]]
    widened = concat(by_column, Frame(spark.createDataFrame([("5",)], "a string"), order="a"), strict=False)
    assert got(widened, "a") == ["-1", "9", "10", "5"]


def test_index(make):
    f = make(a=[1, 2, 2], b=["x", "y", "z"], index=("a", "b"))
    i = f.index
    assert (i.nlevels, i.names, len(i), i.empty, i.is_unique) == (2, ("a", "b"), 3, False, True)
    assert str(i) == "(a, b), unique"
    with pytest.raises(ValueError):
        i.name
    with pytest.raises(AttributeError):
        i.values
    with pytest.raises(IndexError):
        i.get_level_values(-1)
    assert [len(x.collect()) for x in i.levels] == [3, 3]
    one = f.set_index("a", drop=True)
    assert one.columns == ("a",) and one.index.name == "a" and not one.index.is_unique and [r[0] for r in one.index.values.collect()] == [1, 2, 2]
    assert f.reset_index().columns == ("a", "b") and f.reset_index().index.names == () and f.set_index("b").reset_index(drop=True).columns == ("a",)
    assert f.reset_index().index.is_unique
    array = f.set_index([5, 6, 7])
    assert array.index.names == ("_index0",) and got(array, "_index0") == [5, 6, 7]
    assert f.set_index([F.col("a") + 1, "b"]).index.names == ("_index0", "b")
    with pytest.raises(ValueError):
        array.set_index([1, 2, 3])
    with pytest.raises(KeyError):
        f.set_index("zz")
    with pytest.raises(ValueError):
        f.set_index(["a", "a"])
    assert [r[0] for r in one.with_column("d", one.index.duplicated()).iterrows("d")] == [False, False, True]


@pytest.mark.parametrize("keys,up,down", [([[1, 2, 2]], True, False), ([[3, 2, 2]], False, True), ([[1, 1, 2], [5, 6, 0]], True, False), ([[1, 1, 2], [6, 5, 0]], False, False), ([[1.0, NAN, 2.0]], False, False), ([[NAN]], True, True), ([["a", "b"]], True, False)])
def test_monotonic(make, keys, up, down):
    f = make({f"k{i}": v for i, v in enumerate(keys)}, index=[f"k{i}" for i in range(len(keys))])
    assert (f.index.is_monotonic_increasing, f.index.is_monotonic_decreasing) == (up, down)


def test_index_diff(make):
    a, b = make(k=[0, 1, 1, 4, 2], index="k"), make(k=[1, 2, 2, 3], index="k")
    assert sorted(r["pos"] for r in a.index.diff(b.index).collect()) == [0, 3]
    with pytest.raises(ValueError):
        a.index.diff(make(k=[1], z=[1], index=("k", "z")).index)
    n = make(k=[None, 1.0], index="k")
    assert n.index.diff(make(k=[NAN], index="k").index).collect()[0]["pos"] == 1


def test_arrow(spark):
    table = pa.table({
        "i": [1, 2], "f": [1.5, 2.5], "b": [b"x", b"y"], "s": ["u", None], "t": pa.array([dt.datetime(2020, 1, 1), None], pa.timestamp("s")),
        "d": pa.array([dt.timedelta(days=1), None], pa.duration("s")), "q": [True, False], "u": pa.array([1, 2**64 - 1], pa.uint64()), "l": [["a"], None],
    })
    f = Frame.from_arrow(spark, table)
    back = f.to_arrow()
    assert {k: v.simpleString() for k, v in f.dtype.items()}["t"] == "timestamp_ntz" and back.column_names == table.column_names
    assert back.select(["i", "f", "s", "q", "l"]).to_pydict() == table.select(["i", "f", "s", "q", "l"]).to_pydict()
    assert back["d"].to_pylist() == table["d"].to_pylist() and back["t"].to_pylist() == table["t"].to_pylist() and int(back["u"][1].as_py()) == 2**64 - 1
    with pytest.raises(TypeError):
        Frame.from_arrow(spark, table.to_pandas())


def test_serialization(spark, make, tmp_path):
    f = make(k=[2, 1], s=["é", None], l=[["a", "b"], []], index="k")
    raw = serialize(f)
    assert_frame_equal(deserialize(spark, raw), f)
    for cut in range(0, len(raw), 7):
        with pytest.raises(CorruptedBuffer):
            deserialize(spark, raw[:cut])
    for bad in (raw + b"\0", b"", b"nonsense" * 4, (4).to_bytes(8, "little") + b"abcd"):
        with pytest.raises(CorruptedBuffer):
            deserialize(spark, bad)
    write_parquet(f, str(tmp_path / "f"))
    again = read_parquet(spark, str(tmp_path / "f"), row_order=True)
    assert_frame_equal(again, f, ordered=False)
    assert_index_equal(again, f, ordered=False)


def test_json():
    value = {"a": [1, 2.5, None, True, {"é": "x\"\\\n"}], "b": {}, "c": []}
    assert json.loads(json_dumps(value)) == value
    for bad in ({1: 2}, object(), [NAN], {"a": (1,)}):
        with pytest.raises(ValueError):
            json_dumps(bad)


def test_merged_key(make):
    f = make(a=[1, -1], b=pa.array([2, 3], pa.int32()), s=[b"x", b"y"], z=[1.0, 2.0])
    key = [bytes(r[0]) for r in f.df.select(merged_key(f.df, ["a", "b"])).collect()]
    assert key == [(1).to_bytes(8, "big") + (2).to_bytes(4, "big") + b";", b"\xff" * 8 + (3).to_bytes(4, "big") + b";"]
    assert bytes(f.df.select(merged_key(f.df, ["b", "s"])).first()[0]) == (2).to_bytes(4, "big") + b"x"
    for bad in ([], ["z"]):
        with pytest.raises(ValueError):
            merged_key(f.df, bad)


def test_stream(spark, tmp_path):
    from keyloom.streaming import stream_frame

    spark.range(10).write.parquet(str(tmp_path / "in"))
    f = stream_frame(spark.readStream.schema("id long").parquet(str(tmp_path / "in")))
    q = f.take(f["id"] > 6).df.writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").count() == 3
    with pytest.raises(ValueError):
        stream_frame(spark.range(1))


def test_masks_of_booleans(make):
    f = make(a=[10, 20, 30])
    assert got(f.take([False, True, True]), "a") == [20, 30] and got(f.take(np.array([True, False, True])), "a") == [10, 30]
    assert got(f.take(pa.array([True, None, False])), "a") == [10] and got(f.take([False] * 3), "a") == []
    assert got(f.take([False, True, True]).iloc[::-1], "a") == [30, 20]
    assert f.take([]).empty and make(a=pa.array([], pa.int64())).take(np.zeros(0, bool)).empty
    with pytest.raises(ValueError):
        f.take([True])


def test_positions_near_the_ends_need_no_table(make, monkeypatch):
    import keyloom.operators.frame as frame

    def never(*_):
        raise AssertionError("all rows were laid out")

    f = make(a=[4, 3, 2, 1], b=list("wxyz")).sort_values("a")
    monkeypatch.setattr(frame, "with_position", never)
    assert f.iloc[0]["b"] == "z" and f.iloc[-1]["b"] == "w" and got(f.iloc[1:3], "b") == ["y", "x"] and got(f.iloc[:4:2], "b") == ["z", "x"]
    with pytest.raises(IndexError):
        f.iloc[-5]
    monkeypatch.undo()
    assert got(f.iloc[-3:], "a") == [2, 3, 4] and got(f.iloc[2::-1], "a") == [3, 2, 1] and got(f.iloc[3:0:-2], "a") == [4, 2] and got(f.iloc[5:2], "a") == []
    with pytest.raises(ValueError):
        f.iloc[::0]


def test_whole_row_duplicates(make):
    f = make(a=[2, 1, 2, 1, 3], b=["x", None, "x", None, "y"])
    assert got(f.drop_duplicates(), "a") == [2, 1, 3] and got(f.drop_duplicates(keep="last"), "a") == [2, 1, 3]
    assert f.drop_duplicates().iloc[1] == {"a": 1, "b": None}
    g = make(a=[1.0, NAN, None, 1.0], b=[1, 1, 1, 1])
    assert len(g.drop_duplicates()) == 2 and len(Frame(g.df.select("a", "b")).drop_duplicates()) == 2
    down = make(a=[1, 2, 3, 4], k=[1, 1, 2, 2]).sort_values("a", ascending=False)
    assert got(down.drop_duplicates("k"), "a") == [4, 2] and got(down.drop_duplicates("k", keep="last"), "a") == [3, 1]
    assert make(a=[1], index="a").drop_duplicates(ignore_index=True).index.names == ()


def test_reductions(make):
    f = make(k=[1, 1, 2, 2], v=[NAN, 1.0, 3.0, None], n=[7, 2, 9, 4])
    assert bag(f.groupby("k").agg(lo=("v", "fmin"), hi=(F.col("v") * 2, "fmax"))) == [(1, 1.0, 2.0), (2, 3.0, 6.0)]
    low = dict(bag(f.groupby("k").agg(lo=("v", "min"))))
    assert low[1] != low[1] and low[2] == 3.0
    assert bag(f.groupby("k").agg(d=("n", np.subtract), g=("n", np.gcd), h=("n", lambda a, x: a * 10 + x), s=("n", np.add))) == [(1, 5, 1, 72, 9), (2, 5, 1, 94, 13)]
    assert bag(f.groupby(F.col("v") + 0).counts()) == [(1.0, 1), (3.0, 1), (None, 2)]
    assert got(f.groupby("k").first(n="n"), "n") == [7, 9] and got(f.sort_values("n", ascending=False).groupby("k").first(n="n"), "n") == [7, 9]


def test_join_rows_come_by_key(make):
    a, b = make(i=[2, 1, 1, None], x=[0, 1, 2, 3], index="i"), make(i=[1, 2], y=["p", "q"], index="i")
    assert got(join(a, b), "i", "x") == [[1, 1, 2, None], [1, 2, 0, 3]] and join(a, b).iloc[0] == {"i": 1, "x": 1, "y": "p"}


def test_mixed_cells_and_json(spark, make):
    f = make(a=[[1, 2], [3], [4, 5, 6], 7, "a"], b=[9, 8, 7, 6, 5], index="b")
    assert got(f.explode("a"), "a", "b") == [[1, 2, 3, 4, 5, 6, 7, "a"], [9, 9, 8, 7, 7, 7, 6, 5]] and f.explode("a", ignore_index=True).index.names == ()
    docs = [{"api": {"chart": "0.0.103"}}, None, {"build": 619, "tags": ["é", 1.5, None]}]
    g = make(d=docs, k=[1, 2, 3], index="k")
    back = deserialize(spark, serialize(g))
    assert got(back, "d") == docs and back.index.names == ("k",)
    assert got(make(x=[{}, []]), "x") == [{}, []]


class Own(Frame):
    __slots__ = ()


def test_classes_survive_bytes(spark):
    own = Own(spark.createDataFrame([(1,)], "a long"), "a", "a")
    assert type(deserialize(spark, serialize(own))) is Own


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from keyloom.sources.shared import shared_folder

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://x:7077")))
