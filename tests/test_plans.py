"""Physical plans: pushed filters, pruned columns, pairs that stay in their task."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where(F.col("l_quantity") > 20).select("l_orderkey", "l_quantity")
    text = plan(df)
    assert "GreaterThan(l_quantity,20" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    training = plan(QUERIES["e4_training_table"](spark, FOLDER))
    lines = next(x for x in training.splitlines() if "lineitem.parquet" in x)
    assert "l_comment" not in lines and "l_partkey" not in lines


@pytest.mark.parametrize("name", ["e5_yearly_event_features", "e6_peak_winds", "d8_radius_join", "d10_storm_distances"])
def test_pairs_meet_no_shuffle_before_their_first_aggregate(spark, name):
    """The partial aggregate over the pairs sits on the join without an exchange between them: no pair is shuffled."""
    lines = plan(QUERIES[name](spark, FOLDER)).splitlines()
    join = next(i for i, x in enumerate(lines) if re.search(r"SortMergeJoin \[_leaf#\w+, _part#\w+, _share#\w+\]", x))
    above = max(i for i, x in enumerate(lines[:join]) if "Aggregate(keys=[" in x)
    assert "functions=[partial_" in lines[above] and not any("Exchange" in x for x in lines[above:join])
