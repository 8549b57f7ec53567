"""Every registered query with an SQL twin agrees with DuckDB on the smallest data, under a plan
without nested-loop joins and without row-wise Python."""

import re

import pytest
from compare import check, duck

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    def build(session, folder):
        df = QUERIES[name](session, folder)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan), plan
        return df

    state, note, _ = check(spark, con, name, build, ORACLES[name], FOLDER)
    assert state == "ok", note


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_returns_top_events(spark):
    out = entry(spark)
    assert out.columns == ["storm_id", "claims", "incurred_loss_usd", "paid_loss_usd"]
    assert out.count() > 0
