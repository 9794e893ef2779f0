"""Instance-level listings: database and instance facts, resource limits,
invalid objects, backups, alert-log errors, parameters, redo members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.functions.exprs import report_datetime, since
from opslens.plans.ranking import global_rank


def database_details(db_info: DataFrame) -> DataFrame:
    """Columns: dbid, name, created, log_mode, open_mode."""
    return db_info.select("dbid", "name", "created", "log_mode", "open_mode")


def instance_details(instance_info: DataFrame) -> DataFrame:
    """Columns: instance_name, host_name, version, status."""
    return instance_info.select("instance_name", "host_name", "version", "status")


def resource_utilization(resource_limit: DataFrame,
                         names: Sequence[str] = codes.RESOURCE_NAMES) -> DataFrame:
    """Current / max utilisation of the named resources. Limits stay text
    (they may read ' UNLIMITED').
    Columns: resource_name, current_utilization, max_utilization,
    initial_allocation, limit_value."""
    return (resource_limit.where(F.col("resource_name").isin(list(names)))
            .select("resource_name", "current_utilization", "max_utilization",
                    "initial_allocation", "limit_value"))


def invalid_objects(db_objects: DataFrame, con_id: int | None = None) -> DataFrame:
    """Objects with status INVALID, of one container or (``con_id=None``) all.
    Columns: owner, object_name, object_type, last_ddl_run (+ con_id when all)."""
    df = db_objects.where(F.col("status") == "INVALID")
    cols = ["owner", "object_name", "object_type", F.col("last_ddl_time").alias("last_ddl_run")]
    if con_id is not None:
        return df.where(F.col("con_id") == F.lit(con_id)).select(*cols)
    return df.select("con_id", *cols)


def invalid_object_counts(db_objects: DataFrame) -> DataFrame:
    """Fleet view: number of invalid objects per container, owner and type.
    Columns: con_id, owner, object_type, invalid_objects."""
    return (db_objects.where(F.col("status") == "INVALID")
            .groupBy("con_id", "owner", "object_type")
            .agg(F.count(F.lit(1)).alias("invalid_objects")))


def backup_summary(backup_jobs: DataFrame, as_of, days: int = 5,
                   order_by_time: bool = False, ordered: bool = True, ranked: bool = False) -> DataFrame:
    """Backup jobs started in the last ``days`` days, times as
    'DD-MON-YYYY HH24:MI:SS' text. The source report sorts on that text
    (so 31-JAN sorts above 01-FEB); ``order_by_time=True`` sorts on the time.
    ``ranked`` shows the places in that order instead.
    Columns: (rank,) session_key, start_time, end_time, status, autobackup_done,
    autobackup_count, input_type, elapsed_seconds."""
    df = backup_jobs.where(F.col("start_time") > since(as_of, days=days))
    out = df.select("session_key", report_datetime("start_time").alias("start_time"),
                    report_datetime("end_time").alias("end_time"), "status", "autobackup_done",
                    "autobackup_count", "input_type", "elapsed_seconds",
                    F.col("start_time").alias("_t"))
    key = F.col("_t") if order_by_time else F.col("start_time")
    order = [key.desc_nulls_first(), F.col("session_key").asc_nulls_last()]
    if ranked:
        out = global_rank(out, order)
    elif ordered:
        out = out.orderBy(*order)
    return out.drop("_t")


def alert_log_errors(alert_log: DataFrame, as_of, hours: float = 12,
                     pattern: str = codes.ERROR_PATTERN, ordered: bool = True) -> DataFrame:
    """Alert-log lines of the last ``hours`` hours that match a LIKE pattern,
    oldest first (``ordered=False``: no global sort).
    Columns: timestamp (text), message_text."""
    df = alert_log.where((F.col("originating_timestamp") > since(as_of, hours=hours))
                         & F.col("message_text").like(pattern))
    out = df.select(report_datetime("originating_timestamp").alias("timestamp"), "message_text",
                    "originating_timestamp")
    if ordered:
        out = out.orderBy(F.col("originating_timestamp").asc_nulls_last(), F.col("message_text").asc_nulls_last())
    return out.drop("originating_timestamp")


def parameters_like(parameters: DataFrame, token: str, ordered: bool = True) -> DataFrame:
    """Configuration parameters whose name contains ``token`` (any case), by
    name, then value (one name repeats in every database of a fleet).
    Columns: name, type, value."""
    out = parameters.where(F.lower("name").contains(token.lower())).select("name", "type", "value")
    return out.orderBy("name", "value", "type") if ordered else out


def redo_members(members: DataFrame) -> DataFrame:
    """Columns: group_no, member."""
    return members.select("group_no", "member")
