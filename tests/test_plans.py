"""Plan-shape checks: no cartesian products, no window over the whole input,
time filters and column pruning reach the scan, top-n per host is limited on
the map side, and a stable result under different shuffle-partition counts."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from opslens import catalog
from opslens.plans import inspect as pi
from tests.conftest import SF_SMALL

QUERIES = {name: fn for name, fn in E.queries().items() if name in catalog.QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_and_no_global_window(spark, name):
    plan = pi.physical_plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not pi.has_unpartitioned_window(plan), plan


def test_window_detector(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(10)
    glob = df.withColumn("r", F.row_number().over(Window.orderBy("id")))
    part = df.withColumn("r", F.row_number().over(Window.partitionBy(F.col("id") % 3).orderBy("id")))
    assert pi.has_unpartitioned_window(pi.physical_plan(glob))
    assert not pi.has_unpartitioned_window(pi.physical_plan(part))


def test_time_filter_pushed_to_scan(spark):
    plan = pi.physical_plan(QUERIES["r12_alert_log_errors"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(ts,", plan), plan
    plan = pi.physical_plan(QUERIES["r07_archive_per_day"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(ts,", plan), plan


def test_column_pruning(spark):
    plan = pi.physical_plan(QUERIES["r19_redo_members"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas == ["struct<s_suppkey:bigint,s_name:string>"]


@pytest.mark.parametrize("name", ["r20_log_tail", "m09_top_cpu_processes", "m03_recent_memory"])
def test_top_n_is_limited_before_shuffle(spark, name):
    plan = pi.physical_plan(QUERIES[name](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan, plan


def test_aggregates_are_partial(spark):
    plan = pi.physical_plan(QUERIES["r05_capacity_usage"](spark, SF_SMALL))
    assert plan.count("HashAggregate") >= 6  # partial + final for free, alloc and temp


def test_shuffle_partitions_do_not_change_results(spark):
    from opslens.plans.compare import spark_rows
    names = ["r05_capacity_usage", "m02_cpu_usage", "r22_long_running_requests", "r20_log_tail"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = {n: sorted(spark_rows(QUERIES[n](spark, SF_SMALL))[1], key=repr) for n in names}
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = {n: sorted(spark_rows(QUERIES[n](spark, SF_SMALL))[1], key=repr) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


@pytest.mark.parametrize("name,key", [("r15_inactive_sessions", "sid"), ("r05_capacity_usage", "tablespace_name"),
                                      ("r23_failed_requests", "start_date")])
def test_global_sort_has_tie_breakers(spark, name, key):
    plan = pi.physical_plan(QUERIES[name](spark, SF_SMALL))
    m = re.search(r"rangepartitioning\(([^)]*)", plan)
    assert m and key in m.group(1), plan


@pytest.mark.parametrize("name", ["m02_cpu_usage", "m03_memory_usage", "t3_memory_threshold_transitions"])
def test_ordered_host_windows_are_bucketed(spark, name):
    plan = pi.physical_plan(QUERIES[name](spark, SF_SMALL))
    specs = [pi._top_level_groups(m.group(1))[1] for m in pi._WINDOW.finditer(plan)]
    # the row windows (lag / rolling mean) run per (host, bucket); only the small
    # per-host window over bucket tails is partitioned by host alone
    assert any("host" in s and "_bucket" in s for s in specs), specs
    assert sum(1 for s in specs if "_bucket" not in s) <= 1, specs


@pytest.mark.parametrize("name", ["m02_cpu_usage", "m03_memory_usage", "m04_swap_usage", "t3_memory_threshold_transitions"])
def test_bucketed_windows_read_and_shuffle_the_input_once(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1, plan
    # the buckets are not shuffled again for the window over rows and context rows
    above_union = plan.split("Union")[0]
    assert "Exchange" not in above_union, plan
