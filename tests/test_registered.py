"""Every registered query against DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect
from rollcall.registered import all as registered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, con, name):
    df = registered.QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    slow = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython"]
    if not name.startswith("trailer"):  # keeps text, one split per task
        slow.append("SortAggregate")
    assert not [s for s in slow if s in plan]
    got, expected = compare(df, con, registered.SQL[name])
    assert len(got) == len(expected)
    assert got == expected


def test_every_query_has_sql():
    assert set(registered.SQL) == set(registered.QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
