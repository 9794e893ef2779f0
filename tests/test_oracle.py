"""Every registered query against its DuckDB oracle SQL (row count, column
names, order-insensitive values)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from opslens import catalog
from opslens.plans.compare import compare
from tests.conftest import SF_MID, SF_SMALL

SQLS = {name: sql for name, sql in E.oracle_sql().items() if name in catalog.QUERIES}
NAMES = sorted(SQLS)

EXPECTED_SMALL = {
    "r03_database_size": 5, "r05_capacity_usage": 793, "r05_capacity_usage_keep_full": 991, "a1_capacity_alerts": 56,
    "r06_resource_utilization": 134, "r07_archive_per_day": 6, "r08_temp_usage": 3,
    "r09_block_corruption": 34, "r10_invalid_objects": 493, "r11_backup_summary": 145, "r13_online_users_timeout_30m": 6,
    "r12_alert_log_errors": 2, "r13_online_users": 17, "r15_inactive_sessions": 226,
    "r01_database_details": 25, "r02_instance_details": 25, "r04_datafile_details": 6000,
    "r14_online_user_count": 1, "r16_invalid_object_counts": 172, "r17_recovery_area": 10,
    "r19_redo_members": 10, "r20_log_tail": 240, "r21_queue_status": 4,
    "r22_long_running_requests": 34, "r24_request_summary": 15,
    "r25_program_runs": 44, "r26_latest_profile_changes": 2, "r27_component_status": 4,
    "r28_mailer_status": 2, "r18_parameters_sga": 55, "m05_filesystem_alerts": 9,
    "m09_top_cpu_processes": 76, "m01_availability": 16, "m03_memory_usage": 1000,
    "m06_filesystem_usage": 133, "m11_zombie_processes": 30, "m13_thread_count": 19,
    "m15_disk_average": 24, "m17_server_process_counts": 19, "m14_missing_ports": 8, "m12_processes_matching": 500,
    "m14_listening_ports_exact": 127, "m02_cpu_usage": 992, "m19_logged_on_sessions": 1000,
}


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) == set(SQLS) and set(SQLS) <= set(E.queries())


def test_no_green_row_is_empty(duck_mid):
    """A query that returns nothing would prove nothing."""
    empty = [n for n in NAMES if not duck_mid.sql(f"select count(*) from ({SQLS[n]}) q").fetchall()[0][0]]
    assert empty == []


def test_variants_differ(duck_mid):
    count = lambda n: duck_mid.sql(f"select count(*) from ({SQLS[n]}) q").fetchall()[0][0]
    assert count("r05_capacity_usage_keep_full") > count("r05_capacity_usage")
    assert count("a1_capacity_alerts_with_temp") > count("a1_capacity_alerts")
    assert count("m14_listening_ports") > count("m14_listening_ports_exact")
    assert count("m12_processes_matching_token") > count("m12_processes_matching")


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle_small(spark, duck_small, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = compare(df, duck_small, SQLS[name])
    assert res["columns_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["values_match"], res
    if name in EXPECTED_SMALL:
        assert res["spark_rows"] == EXPECTED_SMALL[name]


@pytest.mark.parametrize("name", ["a1_capacity_alerts", "r22_long_running_requests",
                                  "r25_program_runs", "m02_cpu_usage", "m03_memory_usage",
                                  "r27_component_status", "s7_findings"])
def test_matches_oracle_mid(spark, duck_mid, name):
    df = E.queries()[name](spark, SF_MID)
    res = compare(df, duck_mid, SQLS[name])
    assert res["values_match"] and res["spark_rows"] == res["oracle_rows"], res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["con_id", "con_name", "tablespace_name", "free_space_gb",
                          "allocated_space_gb", "max_allocated_gb", "used_percentage"]
    assert df.count() == 56


def test_catalog_names_are_plain():
    for name in catalog.QUERIES:
        assert name.replace("_", "").isalnum() and name == name.lower()


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", NAMES)
def test_column_types_match_oracle(spark, duck_small, name):
    df = E.queries()[name](spark, SF_SMALL)
    ours = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields}
    rel = duck_small.sql(SQLS[name])
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert ours == theirs


def test_output_column_names_are_plain(spark):
    import re
    for name in catalog.QUERIES:
        fn = catalog.spark_query(name)
        cols = fn(spark, SF_SMALL).columns
        assert len(cols) == len(set(cols)), (name, cols)
        assert all(re.fullmatch(r"[a-z][a-z0-9_]*", c) for c in cols), (name, cols)
