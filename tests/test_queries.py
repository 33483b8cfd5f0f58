"""Every query over vectors against its SQL at the smallest size; the text queries have their own tests."""

import pytest
from check import compare, oracle

import __spark_entry__ as entry
from workloads import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    assert compare(rows, df.columns, cur.fetchall(), [c[0] for c in cur.description]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert QUERIES.items() <= entry.queries().items() and SQL.items() <= entry.oracle_sql().items()
