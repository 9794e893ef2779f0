"""Findings: every check's hits in one typed table, and its partitioned sink.

The source appends report sections and an alert block to one HTML file; here
each check contributes rows ``(check, severity, entity, metric, value,
threshold, as_of)`` and the table is written partitioned by day and check.
Re-running a day replaces the partition of every check that ran, also of one
that found nothing, so cleared alerts go; checks that did not run keep theirs.
``write_findings`` replaces them one after the other; ``stage_findings`` and
``read_findings`` go through a commit, so readers see a day as it was before or
after a run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.exprs import as_of_lit, parse_as_of
from opslens.sources.commits import Run, read

FINDING_COLUMNS = ("check", "severity", "entity", "metric", "value", "threshold", "as_of")


def finding(df: DataFrame, check: str, severity: str, entity: Column, metric: str,
            value: Column | None, threshold: float | None, as_of) -> DataFrame:
    """Project one check's result rows onto the findings schema."""
    return df.select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        entity.cast("string").alias("entity"), F.lit(metric).alias("metric"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold"),
        as_of_lit(as_of).alias("as_of"))


def findings(parts: list[DataFrame]) -> DataFrame:
    """Union of ``finding`` frames (by name)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def standard_findings(*, as_of, capacity_alerts: DataFrame | None = None,
                      filesystem_alerts: DataFrame | None = None,
                      long_running: DataFrame | None = None,
                      failed_requests: DataFrame | None = None,
                      mailer_status: DataFrame | None = None,
                      zombies: DataFrame | None = None,
                      missing_ports: DataFrame | None = None,
                      capacity_threshold: float = 90.0, fs_threshold: float = 90.0,
                      runtime_minutes: float = 60.0) -> DataFrame:
    """The alerting checks as findings (any subset may be given)."""
    parts = []
    if capacity_alerts is not None:
        parts.append(finding(capacity_alerts, "tablespace_usage", "WARNING",
                             F.concat_ws("/", F.col("con_name"), F.col("tablespace_name")),
                             "used_percentage", F.col("used_percentage"), capacity_threshold, as_of))
    if filesystem_alerts is not None:
        parts.append(finding(filesystem_alerts, "filesystem_usage", "WARNING",
                             F.concat_ws(":", F.col("host"), F.col("filesystem")),
                             "use_pct", F.col("use_pct"), fs_threshold, as_of))
    if long_running is not None:
        parts.append(finding(long_running, "long_running_request", "INFO", F.col("requestid"),
                             "runtime_min", F.col("runtime_min"), runtime_minutes, as_of))
    if failed_requests is not None:
        parts.append(finding(failed_requests, "failed_request", "WARNING",
                             F.concat_ws(" | ", F.col("program_name"), F.col("status")),
                             "request_count", F.col("request_count"), None, as_of))
    if mailer_status is not None:
        parts.append(finding(mailer_status.where(F.col("component_status") == "DOWN"),
                             "mailer_down", "CRITICAL", F.col("component_name"),
                             "component_status", None, None, as_of))
    if zombies is not None:
        parts.append(finding(zombies, "zombie_process", "WARNING",
                             F.concat_ws(":", F.col("host"), F.col("pid").cast("string")),
                             "state", None, None, as_of))
    if missing_ports is not None:
        parts.append(finding(missing_ports, "port_not_listening", "CRITICAL",
                             F.concat_ws(":", F.col("host"), F.col("port").cast("string")),
                             "port", F.col("port"), None, as_of))
    return findings(parts)


#: The checks of ``standard_findings`` by argument name.
CHECKS = {"capacity_alerts": "tablespace_usage", "filesystem_alerts": "filesystem_usage",
          "long_running": "long_running_request", "failed_requests": "failed_request",
          "mailer_status": "mailer_down", "zombies": "zombie_process", "missing_ports": "port_not_listening"}


def write_findings(df: DataFrame, path: str, as_of, checks: Sequence[str]) -> None:
    """Write one day's findings under ``path/as_of_date=.../check=...``. The
    partition of every check in ``checks`` (those that ran) is overwritten as a
    whole, with no rows where the check found nothing."""
    day = parse_as_of(as_of).date().isoformat()
    for check in checks:
        # the check is a literal of each branch of the union, so the filter leaves only that branch to compute
        (df.where(F.col("check") == check).drop("check").write.mode("overwrite")
         .parquet(f"{path.rstrip('/')}/as_of_date={day}/check={check}"))


def stage_findings(df: DataFrame, run: Run, checks: Sequence[str]) -> None:
    """One day's findings as parts ``findings/<check>`` of a run: every check of
    ``checks`` (those that ran) is replaced when the run is committed, with no
    rows where it found nothing; the others stay as they are."""
    for check in checks:
        run.write(df.where(F.col("check") == check).drop("check"), f"findings/{check}")


def read_findings(spark: SparkSession, root: str, days: Sequence[str] | None = None) -> DataFrame:
    """The committed findings under ``root``: the columns of ``FINDING_COLUMNS`` and ``as_of_date``."""
    columns = [c for c in FINDING_COLUMNS if c != "check"]
    parts = [(check, read(spark, root, f"findings/{check}", days=days)) for check in CHECKS.values()]
    found = [df.select(F.lit(check).alias("check"), *columns, "as_of_date") for check, df in parts if df is not None]
    if not found:
        raise ValueError(f"no findings are committed under {root}")
    return reduce(DataFrame.unionByName, found).select(*FINDING_COLUMNS, "as_of_date")
