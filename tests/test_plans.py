"""Physical plans: what reaches the scan, and that no query pairs everything with everything."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as registered
from fieldspark.catalog import fixtures as fx
from fieldspark.operators import slicing
from fieldspark.plans.scale import attach, durable, measured_bytes

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", list(registered.queries()))
def test_no_query_pairs_all_rows(spark, name):
    plan = plan_of(registered.queries()[name](spark, SF_DIR))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(slicing.extent(fx.points(spark, SF_DIR), fx.KEYS))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string,l_linestatus:string>" in plan


def test_filters_on_sets_reach_the_scan(spark):
    points = fx.points(spark, SF_DIR).filter("comparison_set = 'F' AND y > 0.03")
    assert re.search(r"PushedFilters: \[.*EqualTo\(l_linestatus,F\).*GreaterThan\(l_tax,0.03\)", plan_of(points))


def test_slice_does_not_shuffle_the_points(spark):
    plan = plan_of(slicing.slice_plane(fx.points(spark, SF_DIR), fx.KEYS))
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan.replace("BroadcastExchange", "")


def test_attach_broadcasts_only_within_the_budget(spark):
    rows = spark.range(100).selectExpr("id % 10 AS k", "id")
    facts = durable(spark.range(10).selectExpr("id AS k", "cast(id AS string) AS label"))
    assert 10 * 16 <= measured_bytes(facts) <= 10 * 32
    assert "BroadcastHashJoin" in plan_of(attach(rows, facts, ["k"]))
    beyond = attach(rows, facts, ["k"], budget=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "SortMergeJoin" in plan_of(beyond)
    assert beyond.count() == 100
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
