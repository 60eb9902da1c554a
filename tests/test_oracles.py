"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as contract
from tools.check import compare, connect

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "EvalPython" not in plan
    _, differences = compare(df, con, ORACLES[name])
    assert not differences


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_a_row_per_entity(spark):
    out = contract.entry(spark)
    assert out.count() == 150
    assert "index_rank" in out.columns
