"""Every catalogue query against its oracle on the small tables."""

import os

import duckdb
import pytest

from keyloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"create view {name.partition('.')[0]} as select * from '{DATA}/{name}'")
    return connection


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(repr(float(x)) if isinstance(x, float) else repr(x) for x in (row[i] for i in order)) for row in found))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_the_oracle(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    relation = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(relation.columns)
    mine = rows(found.columns, [tuple(r) for r in found.collect()])
    oracle = relation.df().astype(object)
    oracle = oracle.where(oracle.notna(), None)
    theirs = [tuple(x.item() if hasattr(x, "item") else x.to_pydatetime() if hasattr(x, "to_pydatetime") else x for x in r) for r in oracle.itertuples(index=False)]
    assert mine == rows(list(oracle.columns), theirs)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
