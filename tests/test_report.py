"""The whole health check as one job: every report written once, usage
computed once for both its report and the alert, re-run idempotent."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from opslens import report
from opslens.sources.fixtures import Snapshot
from tests.conftest import SF_SMALL

AS_OF = "2024-01-31 00:00:00"


def test_run_writes_every_report(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="opslens-report-"), "hc")
    s = Snapshot(spark, SF_SMALL)
    held = set(spark.sparkContext._jsc.getPersistentRDDs().keys())  # by tests before this one
    paths = report.run(s, AS_OF, out)
    assert len(paths) >= 45
    frames, _ = report.health_check(s, AS_OF)

    def read(n, p):  # empty reports have no data files: read with the report's schema
        if n == "findings":
            return spark.read.parquet(p)
        return spark.read.schema(frames[n].withColumn("as_of_date", F.lit(None).cast("date")).schema).parquet(p)

    counts = {n: read(n, p).count() for n, p in paths.items()}
    frames["tablespace_usage"].unpersist()
    assert counts["tablespace_usage"] == 793 and counts["tablespace_alerts"] == 56
    assert counts["log_tail"] == 240 and counts["online_user_count"] == 1
    assert counts["findings"] > 0
    # findings built from the written tables equal findings computed directly
    _, direct = report.health_check(s, AS_OF)
    _["tablespace_usage"].unpersist()
    back = spark.read.parquet(paths["findings"]).drop("as_of_date")
    cols = sorted(direct.columns)
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, direct.select(*cols).collect()))
    # same day again: partitions replaced, not appended
    report.run(Snapshot(spark, SF_SMALL), AS_OF, out)
    assert spark.read.parquet(paths["tablespace_usage"]).count() == 793
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keys()) <= held
