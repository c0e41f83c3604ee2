"""Every registered query: its plan, and its values against the oracle."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def assert_scalable(df):
    """No product join, and no window that puts all rows in one task."""
    execution = df._jdf.queryExecution()
    physical = execution.executedPlan().toString()
    assert "CartesianProduct" not in physical
    assert "BroadcastNestedLoopJoin" not in physical
    for line in execution.optimizedPlan().toString().splitlines():
        if line.strip(" :+-").startswith("Window ["):
            assert "], [" in line, line


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if not name.startswith("stream_"):
        assert_scalable(df)
    if name in SQL:
        problem, _ = compare(spark, duck, lambda *_: df, SQL[name], sf_dir)
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert not contract.entry(spark).isEmpty()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["events_between"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThanOrEqual(event_id,500)" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
