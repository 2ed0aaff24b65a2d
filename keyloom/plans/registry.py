"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import Frame
from .oracle import ORACLE_SQL as ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[Callable[..., Frame]], Frame | DataFrame]) -> Callable:
    """Register a function of a table reader t(name, index, order) under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def t(name: str, index=(), order=()) -> Frame:
            return Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet"), index, order)

        out = function(t)
        return out.df.select(*[F.col(f"`{c}`") for c in out.columns]) if isinstance(out, Frame) else out

    QUERIES[function.__name__] = run
    return function


def answers(sql: str) -> Callable:
    """Register a query with its oracle beside it."""

    def register(function: Callable) -> Callable:
        ORACLE_SQL[function.__name__] = sql
        return query(function)

    return register


def orders(t) -> Frame:
    return t("orders", order="o_orderkey")


def labelled(t) -> Frame:
    """Documents with their labels, NULL where there are none."""
    d, other = t("documents").df.select("doc_id"), t("labels").df
    return Frame(d.join(other, "doc_id", "left"), order="doc_id")


def only(frame: Frame, *names: str, **more) -> DataFrame:
    return frame.df.select(*names, *[c.alias(n) for n, c in more.items()])


def rows(frame: Frame, schema: str, values: list) -> DataFrame:
    """What methods have returned to the driver, as a table."""
    return frame.df.sparkSession.createDataFrame(values, schema)


def raised(kind: type[Exception], call: Callable) -> bool:
    """Whether a call raises an error of that kind."""
    try:
        call()
    except kind:
        return True
    return False
