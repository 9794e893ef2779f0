"""Findings table and its partitioned, idempotent sink."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from opslens.operators.findings import CHECKS, FINDING_COLUMNS, write_findings
from tests.conftest import SF_SMALL

AS_OF = "2024-01-31 00:00:00"


def test_findings_schema_and_checks(spark):
    f = E.queries()["s7_findings"](spark, SF_SMALL)
    assert tuple(f.columns) == FINDING_COLUMNS
    checks = {r["check"] for r in f.select("check").distinct().collect()}
    assert {"tablespace_usage", "filesystem_usage", "long_running_request",
            "zombie_process", "port_not_listening"} <= checks


def test_sink_partitions_and_rerun_is_idempotent(spark):
    f = E.queries()["s7_findings"](spark, SF_SMALL)
    out = os.path.join(tempfile.mkdtemp(prefix="opslens-findings-"), "findings")
    every = list(CHECKS.values())
    write_findings(f, out, AS_OF, every)
    n = spark.read.parquet(out).count()
    write_findings(f, out, AS_OF, every)  # re-run of the same day replaces its partitions
    back = spark.read.parquet(out)
    assert back.count() == n == f.count()
    assert {"as_of_date", "check"} <= set(back.columns)
    # a check that did not run keeps its rows; one that ran and found nothing has none
    by_check = {r["check"]: r["count"] for r in f.groupBy("check").count().collect()}
    write_findings(f.where(F.col("check") == "zombie_process"), out, AS_OF, ["zombie_process", "port_not_listening"])
    left = {r["check"]: r["count"] for r in spark.read.parquet(out).groupBy("check").count().collect()}
    assert left == {c: k for c, k in by_check.items() if c != "port_not_listening"}
    # another day is left alone
    write_findings(f.limit(0), out, "2024-02-01 00:00:00", every)
    assert spark.read.parquet(out).where("as_of_date = '2024-01-31'").count() == sum(left.values())
    dirs = os.listdir(os.path.join(out, "as_of_date=2024-01-31"))
    assert "check=tablespace_usage" in dirs
