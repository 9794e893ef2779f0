"""Landed snapshots prune by date and container; SQL over registered views
equals the DataFrame operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from opslens.operators import database
from opslens.plans.inspect import physical_plan
from opslens.sources.landing import LandedSnapshot, land, land_all, read_landed


def test_land_and_prune(spark, snap_small):
    root = tempfile.mkdtemp(prefix="opslens-land-")
    path = os.path.join(root, "data_files")
    df = snap_small.data_files
    land(df, path, "2024-01-30")
    land(df, path, "2024-01-31")
    land(df, path, "2024-01-31")  # re-landing a day replaces it
    day = read_landed(spark, path, as_of="2024-01-31 00:00:00")
    assert day.count() == df.count()
    one = read_landed(spark, path, as_of="2024-01-31 00:00:00", con_ids=[3])
    plan = physical_plan(one)
    assert "PartitionFilters: [" in plan and "snapshot_date" in plan and "con_id" in plan
    assert one.count() == df.where("con_id = 3").count()


def test_landing_again_drops_what_is_gone(spark, snap_small):
    path = os.path.join(tempfile.mkdtemp(prefix="opslens-land-"), "data_files")
    df = snap_small.data_files
    land(df, path, "2024-01-30")
    land(df, path, "2024-01-31")
    land(df.where("con_id <> 2"), path, "2024-01-31")
    assert read_landed(spark, path, as_of="2024-01-31 00:00:00").where("con_id = 2").count() == 0
    assert read_landed(spark, path, as_of="2024-01-30 00:00:00").where("con_id = 2").count() > 0


def test_reports_run_from_landed_tables(spark, snap_small):
    from opslens import report
    root = os.path.join(tempfile.mkdtemp(prefix="opslens-land-"), "landed")
    land_all(snap_small, root, "2024-01-31")
    landed = LandedSnapshot(spark, root, "2024-01-31 00:00:00")
    frames, found = report.health_check(landed, "2024-01-31 00:00:00")
    direct, found_direct = report.health_check(snap_small, "2024-01-31 00:00:00")
    try:
        for name in ("database_size", "long_running_requests", "backup_summary", "thread_count", "disk_average", "component_status"):
            cols = direct[name].columns
            assert sorted(map(repr, frames[name].select(*cols).collect())) == sorted(map(repr, direct[name].collect())), name
        assert sorted(map(repr, found.collect())) == sorted(map(repr, found_direct.select(*found.columns).collect()))
        plan = physical_plan(frames["long_running_requests"])
        assert "PartitionFilters: [isnotnull(snapshot_date" in plan and "LessThanOrEqual(actual_start_date" in plan
    finally:
        frames["tablespace_usage"].unpersist()
        direct["tablespace_usage"].unpersist()
    assert LandedSnapshot(spark, root, "2024-02-01 00:00:00").requests.count() == 0
    assert LandedSnapshot(spark, root, "2024-01-31 00:00:00", con_ids=[3]).data_files.select("con_id").distinct().collect() == [(3,)]


def test_sql_over_views_equals_operator(spark, snap_small):
    """A report written in Spark SQL over the registered views."""
    snap_small.register_views()
    sql = spark.sql("""
        select case when grouping(owner) = 1 then 'all' else owner end as who, count(*) as n
        from db_objects where status = 'INVALID' group by rollup(owner)""")
    counts = database.invalid_object_counts(snap_small.db_objects)
    own = {r["owner"]: r["n"] for r in counts.groupBy("owner").agg(F.sum("invalid_objects").alias("n")).collect()}
    assert {r["who"]: r["n"] for r in sql.collect()} == own | {"all": sum(own.values())}


def test_input_size_and_shuffle_sizing(spark):
    from opslens.session import input_bytes, shuffle_partitions_for
    from tests.conftest import SF_SMALL
    n = input_bytes(spark, SF_SMALL)
    assert n and n > 100_000
    assert shuffle_partitions_for(100 * 1024 ** 4, 8000) == 409600
    assert shuffle_partitions_for(n, 8) == 16
