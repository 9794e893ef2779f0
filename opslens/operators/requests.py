"""Batch-request reports: queue managers, long-running, failed and summarised
requests, runs of one program, and the latest profile changes.

The request table is the large side; programs, responsibilities, queues and
services are dimensions and go through the size-checked broadcast. Users can
be large (one row per account), so that join is left to the planner; AQE
turns it into a broadcast at run time when the filtered side is small and
splits skewed partitions when one user or program holds a large share.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.functions.exprs import (as_of_lit, decode, decode_or_self, minutes_between,
                                     report_datetime, report_datetime_short, parse_as_of, since,
                                     text_concat)
from opslens.plans.joins import broadcast_if_small
from opslens.plans.ranking import global_rank


#: Factor by which more of the newest values are tried, twice, when too few of them have a name and a user.
FAN_OUT_STEP = 64


def queue_status(queues: DataFrame, queues_vl: DataFrame, only_at_target: bool = True,
                 ranked: bool = False) -> DataFrame:
    """Queue managers with their node, actual and target process counts and
    decoded control state (unknown codes give NULL), largest target first.
    By default only managers running exactly their target count are listed;
    ``only_at_target=False`` lists all. ``ranked`` shows the places in that
    order instead.
    Columns: (rank,) concurrent_manager, server_node, actual, target, status."""
    q = queues
    if only_at_target:
        q = q.where(F.col("running_processes") == F.col("max_processes"))
    names = queues_vl.select("queue_id", "user_queue_name", "control_code")
    out = (q.join(broadcast_if_small(names), "queue_id")
           .select(F.col("user_queue_name").alias("concurrent_manager"),
                   F.col("target_node").alias("server_node"),
                   F.col("running_processes").alias("actual"),
                   F.col("max_processes").alias("target"),
                   decode("control_code", codes.QUEUE_CONTROL).alias("status"))
           .distinct())
    order = [F.col("target").desc_nulls_first(), F.col("concurrent_manager").asc_nulls_last(),
             F.col("server_node").asc_nulls_last()]
    return global_rank(out, order) if ranked else out.orderBy(*order)


def long_running_requests(requests: DataFrame, users: DataFrame, responsibilities: DataFrame,
                          programs: DataFrame, as_of, minutes: float = 60, ordered: bool = True) -> DataFrame:
    """Running requests (status R) whose run time at ``as_of``, rounded to two
    decimals, is above ``minutes``. Programs are matched on id and
    application id. Distinct rows, ordered by program id then request id
    descending.
    Columns: requestid, username, responsibility_name, program_name,
    start_datetime, status, runtime_min, report_arguments."""
    runtime = F.round(minutes_between("actual_start_date", as_of_lit(as_of)), 2)
    # a rounded run time above the limit implies a start before it: that bound reaches the scan
    r = (requests.where((F.col("status_code") == "R") & (F.col("actual_start_date") <= since(as_of, hours=minutes / 60)))
         .withColumn("runtime_min", runtime)
         .where(F.col("runtime_min") > F.lit(float(minutes))))
    progs = broadcast_if_small(programs.select("program_id", "application_id", "user_program_name"))
    resp = broadcast_if_small(responsibilities.select("responsibility_id", "responsibility_name"))
    u = users.select(F.col("user_id").alias("requested_by"), "user_name")
    df = (r.join(progs, ["program_id", "application_id"])
           .join(resp, "responsibility_id")
           .join(u, "requested_by"))
    out = (df.select(F.col("request_id").alias("requestid"), F.col("user_name").alias("username"),
                      "responsibility_name", F.col("user_program_name").alias("program_name"),
                      report_datetime("actual_start_date").alias("start_datetime"),
                      decode_or_self("status_code", codes.RUNNING_STATUS).alias("status"),
                      "runtime_min", F.col("argument_text").alias("report_arguments"),
                      "program_id")
           .distinct())
    if ordered:
        out = out.orderBy(F.col("program_id").asc_nulls_last(), F.col("requestid").desc_nulls_first())
    return out.drop("program_id")


def failed_requests(requests: DataFrame, programs: DataFrame, as_of, hours: float = 12,
                    language: str = "US", ordered: bool = True) -> DataFrame:
    """Requests ended in error (E) or warning (G) whose requested start is in
    the last ``hours`` hours, counted per program, status, message and start
    time, most frequent first. A 'Report Set' shows the request description
    instead of the program name. Programs are matched on id only.
    Columns: program_name, status, error_message, start_date, request_count."""
    r = requests.where(F.col("status_code").isin("E", "G")
                       & (F.col("requested_start_date") > since(as_of, hours=hours)))
    p = broadcast_if_small(programs.where(F.col("language") == language)
                           .select("program_id", "user_program_name"))
    name = F.when(F.col("user_program_name") == codes.REPORT_SET, F.col("description")) \
            .otherwise(F.col("user_program_name"))
    status = decode("status_code", codes.FAILED_STATUS)
    out = (r.join(p, "program_id")
            .groupBy("user_program_name", "description", name.alias("program_name"),
                     status.alias("status"), F.col("completion_text").alias("error_message"),
                     F.col("actual_start_date").alias("start_date"))
            .agg(F.count(F.lit(1)).alias("request_count"))
            .drop("user_program_name", "description"))
    if ordered:
        out = out.orderBy(F.col("request_count").desc(), F.col("start_date").desc_nulls_last(),
                          F.col("program_name").asc_nulls_last(), F.col("error_message").asc_nulls_last())
    return out


def request_summary(requests: DataFrame, as_of, hours: float = 12,
                    merge_labels: bool = False) -> DataFrame:
    """Requests of the last ``hours`` hours counted per phase and status and
    labelled '<Phase> With <Status>' (an unknown code reads as empty text).
    Counts are per raw code pair, so several rows can share a label;
    ``merge_labels=True`` counts per label.
    Columns: status, request_count."""
    r = requests.where(F.col("requested_start_date") > since(as_of, hours=hours))
    phase = decode("phase_code", codes.SUMMARY_PHASE)
    label = text_concat(phase, " With ", decode("status_code", codes.SUMMARY_STATUS))
    if merge_labels:
        out = r.groupBy(label.alias("status"), phase.alias("_phase")) \
               .agg(F.count(F.lit(1)).alias("request_count"))
    else:
        out = (r.groupBy("phase_code", "status_code").agg(F.count(F.lit(1)).alias("request_count"))
               .select(label.alias("status"), phase.alias("_phase"), "request_count"))
    return (out.orderBy(F.col("_phase").asc_nulls_last(), F.col("request_count").desc())
            .drop("_phase"))


def program_runs(requests: DataFrame, programs: DataFrame, users: DataFrame, as_of,
                 name: str = codes.GATHER_STATS_PROGRAM, days: int = 30,
                 min_commas: int = 8, ordered: bool = True) -> DataFrame:
    """Runs of one named program completed since the day after
    ``trunc(as_of - days)``, with at least ``min_commas`` commas in the
    arguments. The name table is matched on program id only (every language),
    and rows are distinct.
    Columns: requestid, program_name, process_time, requestdate, startdate,
    completedate, username, phasecode, statuscode, program_arg."""
    # trunc(completion) > as_of - days  <=>  completion >= trunc(as_of - days) + 1 day;
    # the right-hand form is a literal bound on the raw column, so it is pushed to the scan.
    lower = (parse_as_of(as_of) - _dt.timedelta(days=days)).replace(
        hour=0, minute=0, second=0, microsecond=0) + _dt.timedelta(days=1)
    pattern = "%" + ",%" * min_commas
    r = requests.where((F.col("actual_completion_date") >= as_of_lit(lower))
                       & F.col("argument_text").like(pattern))
    p = broadcast_if_small(programs.where(F.col("user_program_name") == name)
                           .select("program_id", "user_program_name"))
    u = users.select(F.col("user_id").alias("requested_by"), "user_name")
    df = r.join(p, "program_id").join(u, "requested_by")
    out = (df.select(
        F.col("request_id").alias("requestid"), F.col("user_program_name").alias("program_name"),
        F.round(minutes_between("actual_start_date", "actual_completion_date"), 2).alias("process_time"),
        report_datetime_short("request_date").alias("requestdate"),
        report_datetime_short("actual_start_date").alias("startdate"),
        report_datetime_short("actual_completion_date").alias("completedate"),
        F.col("user_name").alias("username"),
        decode("phase_code", codes.RUN_PHASE, codes.RUN_PHASE_DEFAULT).alias("phasecode"),
        decode("status_code", codes.RUN_STATUS, codes.RUN_STATUS_DEFAULT).alias("statuscode"),
        F.col("argument_text").alias("program_arg"))
        .distinct())
    return out.orderBy(F.col("requestid").desc_nulls_first()) if ordered else out


def latest_profile_changes(options: DataFrame, values: DataFrame, options_tl: DataFrame,
                           users: DataFrame, n: int = 2, days: float | None = None, as_of=None,
                           language: str | None = None) -> DataFrame:
    """The ``n`` most recent profile-option value changes (rows, after joining
    the option names in every language, so one change in two languages fills
    two rows), then distinct. ``days`` keeps every change of the last
    ``days`` days instead; ``language`` filters the name table.
    Ties on the change time are broken by option, level, value and user so
    the cut is deterministic.

    Only the newest values are joined: those no older than the k-th newest, with
    all ties. If they make ``n`` rows or more, the ``n`` newest are among them,
    since every other value is older; if not (values without a name or user), k
    grows twice, then all are joined. So the bound on the time stands under the joins, at
    the scan; finding it runs a top-k job over one column.
    Columns: profile_option, option_level, profile_value, change_date, user_name."""
    tl = options_tl
    if language is not None:
        tl = tl.where(F.col("language") == language)

    def named(some: DataFrame) -> DataFrame:
        df = (some.join(options, "profile_option_id")
              .join(tl, "profile_option_name")
              .join(users.select(F.col("user_id").alias("last_updated_by"), "user_name"), "last_updated_by"))
        return df.select(F.col("user_profile_option_name").alias("profile_option"),
                         decode("level_id", codes.PROFILE_LEVEL, codes.PROFILE_LEVEL_DEFAULT).alias("option_level"),
                         F.col("profile_option_value").alias("profile_value"),
                         F.col("last_update_date").alias("change_date"), "user_name")

    order = [F.col("change_date").desc_nulls_first(), F.col("profile_option").asc_nulls_last(),
             F.col("option_level").asc_nulls_last(), F.col("profile_value").asc_nulls_last(),
             F.col("user_name").asc_nulls_last()]
    if days is not None:
        return named(values).where(F.col("change_date") > since(as_of, days=days)).distinct().orderBy(*order)
    changed = F.col("last_update_date")
    for k in (n, n * FAN_OUT_STEP, n * FAN_OUT_STEP ** 2):  # their times go through the driver, hence no further
        newest = values.select(changed).orderBy(changed.desc_nulls_first()).limit(k).collect()
        if len(newest) < k:  # fewer values than that
            out = named(values)
            break
        bound = newest[-1][0]
        out = named(values.where(changed.isNull() if bound is None else changed.isNull() | (changed >= F.lit(bound).cast("timestamp_ntz"))))
        if out.limit(n).count() >= n:
            break
    else:
        out = named(values)
    out = out.orderBy(*order).limit(n)
    return out.distinct().orderBy(*order)
