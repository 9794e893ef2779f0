"""Staged runs: readers see a day as it was or as it is, never a mixture."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from opslens import report
from opslens.operators import findings
from opslens.sources import commits
from opslens.sources.fixtures import Snapshot
from tests.conftest import SF_SMALL

DAY, NEXT = "2024-01-31", "2024-02-01"
CHECKS = list(findings.CHECKS.values())


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="opslens-commits-")


@pytest.fixture(scope="module")
def found(spark):
    return E.queries()["s7_findings"](spark, SF_SMALL).checkpoint()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stop_between_two_checks_leaves_the_old_day(spark, root, found):
    run = commits.Run(spark, root, DAY)
    findings.stage_findings(found, run, CHECKS)
    assert commits.committed_days(spark, root) == []  # nothing is visible yet
    run.commit()
    old = rows(findings.read_findings(spark, root))
    assert [r[:-1] for r in old] == rows(found)

    class Stop(Exception):
        pass

    class Dies(commits.Run):
        def write(self, df, part):
            if len(self.written) == 3:
                raise Stop
            return super().write(df, part)

    newer = found.withColumn("severity", F.lit("CHANGED"))
    with pytest.raises(Stop):
        findings.stage_findings(newer, Dies(spark, root, DAY), CHECKS)
    assert rows(findings.read_findings(spark, root)) == old
    # the next run is not hindered by what was left, and replaces the day as a whole
    again = commits.Run(spark, root, DAY)
    findings.stage_findings(newer, again, CHECKS)
    assert rows(findings.read_findings(spark, root)) == old
    again.commit()
    assert rows(findings.read_findings(spark, root).drop("as_of_date")) == rows(newer)
    assert commits.vacuum(spark, root) == 3 + len(CHECKS)  # the torn run's and the first run's
    assert rows(findings.read_findings(spark, root).drop("as_of_date")) == rows(newer)
    assert commits.vacuum(spark, root) == 0


def test_checks_that_did_not_run_stay(spark, root, found):
    run = commits.Run(spark, root, DAY)
    findings.stage_findings(found, run, CHECKS)
    run.commit()
    run = commits.Run(spark, root, DAY)
    findings.stage_findings(found.limit(0), run, ["zombie_process"])
    run.commit()
    left = {r["check"] for r in findings.read_findings(spark, root).select("check").distinct().collect()}
    assert left == {r["check"] for r in found.select("check").distinct().collect()} - {"zombie_process"}
    # another day is left alone
    run = commits.Run(spark, root, NEXT)
    findings.stage_findings(found.limit(5), run, CHECKS)
    run.commit()
    assert findings.read_findings(spark, root, days=[NEXT]).count() == 5
    assert findings.read_findings(spark, root, days=[DAY]).where("check = 'zombie_process'").count() == 0


def test_of_two_runs_the_second_to_commit_fails(spark, root):
    one, two = (commits.Run(spark, root, DAY) for _ in range(2))
    one.write(spark.range(3), "t")
    two.write(spark.range(9), "t")
    assert one.commit() == 1
    with pytest.raises(RuntimeError, match="another run has committed"):
        two.commit()
    assert commits.read(spark, root, "t").count() == 3
    assert not [f for f in os.listdir(os.path.join(root, "_commits", f"as_of_date={DAY}")) if two.id in f and not f.endswith(".crc")]


def test_reader_that_has_begun_keeps_its_files(spark, root):
    run = commits.Run(spark, root, DAY)
    run.write(spark.range(4), "t")
    run.commit()
    begun = commits.read(spark, root, "t")
    run = commits.Run(spark, root, DAY)
    run.write(spark.range(100), "t")
    run.commit()
    assert begun.count() == 4 and commits.read(spark, root, "t").count() == 100


def test_nothing_committed(spark, root):
    assert commits.read(spark, root, "t") is None and commits.committed_days(spark, root) == [] and commits.vacuum(spark, root) == 0
    with pytest.raises(ValueError, match="no findings"):
        findings.read_findings(spark, root)


def test_staged_report(spark, root):
    s = Snapshot(spark, SF_SMALL)
    for _ in range(2):
        paths = report.run(s, f"{DAY} 00:00:00", root, staged=True)
    assert commits.manifest(spark, root, DAY)[0] == 2 and len(paths) >= 45
    assert commits.read(spark, root, "tablespace_usage").count() == 793
    assert commits.read(spark, root, "tablespace_alerts").count() == 56
    _, direct = report.health_check(s, f"{DAY} 00:00:00")
    _["tablespace_usage"].unpersist()
    assert rows(findings.read_findings(spark, root).drop("as_of_date")) == rows(direct.select(*findings.FINDING_COLUMNS))
