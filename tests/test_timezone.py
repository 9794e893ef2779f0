"""Results do not depend on the session time zone (all times are NTZ)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from opslens.plans.compare import spark_rows
from tests.conftest import SF_SMALL

ZONE_SENSITIVE = ["r07_archive_per_day", "r07_archive_per_day_whole_days", "t1_error_counts_hourly",
                  "t2_memory_window_avg", "m02_cpu_usage", "m03_memory_usage", "r11_backup_summary",
                  "r12_alert_log_errors", "r13_online_users", "r22_long_running_requests",
                  "r25_program_runs", "m08_uptime_by_host", "s7_findings",
                  "t3_memory_threshold_transitions"]


@pytest.mark.parametrize("name", ZONE_SENSITIVE)
def test_same_result_in_other_zones(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        base = sorted(spark_rows(q(spark, SF_SMALL))[1], key=repr)
        for zone in ("Asia/Kolkata", "America/St_Johns"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(spark_rows(q(spark, SF_SMALL))[1], key=repr) == base, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
