"""The whole health check as one job: every report for one ``as_of``.

This replaces the source's single run that appends each section to one
document. Here each report is a table written under ``out_dir/<report>/``
partitioned by ``as_of_date`` (a re-run overwrites that day's folder), plus the findings table;
``staged`` runs write to folders of their own and are committed at one moment (``sources.commits``),
so that readers see the old day or the new one, whole. The tablespace usage
frame feeds both its report and the capacity alert, so it is persisted for
the run and released afterwards (the source ran that query twice). The
fleet-sized listings are written unsorted: a table needs no global order.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.functions.exprs import as_of_lit, parse_as_of
from opslens.operators import activity, components, database, findings, hosts, requests, storage
from opslens.sources import commits


def health_check(s, as_of, *, threshold: float = codes.CAPACITY_THRESHOLD,
                 pdb_con_id: int | None = None,
                 profile_timeout_minutes=None) -> tuple[dict[str, DataFrame], DataFrame]:
    """All report frames (lazy) and the findings frame, for ``as_of``. ``s`` has
    the logical tables as attributes: landed ones (``landing.LandedSnapshot``)
    or the test projections (``fixtures.Snapshot``).
    The caller owns the returned usage frame's cache (see ``run``)."""
    usage = storage.capacity_usage(s.data_files, s.free_space, s.temp_files, s.containers, ordered=False) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    alerts = storage.capacity_alerts(usage, threshold, ordered=False)
    users = s.app_users
    reports: dict[str, DataFrame] = {
        "database_details": database.database_details(s.db_info),
        "instance_details": database.instance_details(s.instance_info),
        "database_size": storage.database_size(s.data_files, s.temp_files, s.pdbs),
        "datafile_details": storage.datafile_details(s.data_files, s.pdbs, ordered=False),
        "tablespace_usage": usage,
        "tablespace_alerts": alerts,
        "resource_utilization": database.resource_utilization(s.resource_limit),
        "archive_per_day": storage.archive_per_day(s.archived_log, as_of),
        "temp_usage": storage.temp_usage(s.sort_segment, s.tablespaces, s.temp_files),
        "block_corruption": storage.block_corruption(s.block_corruption, ordered=False),
        "invalid_objects": database.invalid_objects(s.db_objects, pdb_con_id),
        "invalid_object_counts": database.invalid_object_counts(s.db_objects),
        "backup_summary": database.backup_summary(s.backup_jobs, as_of, ordered=False),
        "alert_log_errors": database.alert_log_errors(s.alert_log, as_of, ordered=False),
        "recovery_area": storage.recovery_area(s.recovery_dest),
        "online_user_count": activity.online_user_count(s.app_sessions, users, as_of,
                                                        profile_timeout_minutes),
        "online_users": activity.online_users(s.app_sessions, users, as_of, profile_timeout_minutes),
        "inactive_sessions": activity.inactive_sessions(s.db_sessions, ordered=False),
        "queue_status": requests.queue_status(s.queues, s.queues_vl),
        "long_running_requests": requests.long_running_requests(s.requests, users, s.responsibilities,
                                                                s.programs, as_of, ordered=False),
        "failed_requests": requests.failed_requests(s.requests, s.programs, as_of, ordered=False),
        "request_summary": requests.request_summary(s.requests, as_of),
        "program_runs": requests.program_runs(s.requests, s.programs, users, as_of, ordered=False),
        "latest_profile_changes": requests.latest_profile_changes(
            s.profile_options, s.profile_values, s.profile_options_tl, users),
        "component_status": components.component_status(s.components, s.component_params,
                                                        s.queues, s.services),
        "mailer_status": components.mailer_status(s.components),
        **{f"parameters_{t}": database.parameters_like(s.parameters, t, ordered=False) for t in codes.PARAMETER_TOKENS},
        "log_tail": hosts.log_tail(s.host_log),
        "redo_members": database.redo_members(s.redo_members),
        "server_process_counts": hosts.server_process_counts(s.proc_snapshot),
        "probe_status": hosts.latest_probe_status(s.probe_results),
        "filesystem_usage": hosts.filesystem_usage(s.fs_usage),
        "filesystem_alerts": hosts.filesystem_alerts(s.fs_usage),
        "cpu_usage": hosts.cpu_usage(s.cpu_samples),
        "memory": hosts.recent_memory(s.mem_samples),
        "uptime": hosts.uptime_by_host(s.boot_samples, as_of),
        "load_average": hosts.load_average(s.uptime_lines),
        "logged_on_users": hosts.logged_on_users(s.who_lines),
        "top_cpu_processes": hosts.top_processes(s.proc_snapshot, "pcpu"),
        "top_memory_processes": hosts.top_processes(s.proc_snapshot, "pmem"),
        "zombie_processes": hosts.zombie_processes(s.proc_snapshot),
        "watched_processes": hosts.processes_matching(s.proc_snapshot),
        "thread_count": hosts.thread_count(s.proc_snapshot, s.host_limits),
        "listening_ports": hosts.listening_ports(s.listeners),
        "disk_average": hosts.disk_average(s.disk_samples),
        "vmstat": hosts.vmstat_samples(s.vmstat_lines),
    }
    reports["missing_ports"] = hosts.missing_ports(s.listeners, s.proc_snapshot)
    return reports, _findings(reports, as_of, threshold)


# report tables the findings are built from, by findings argument
_FINDING_SOURCES = {"capacity_alerts": "tablespace_alerts", "filesystem_alerts": "filesystem_alerts",
                    "long_running": "long_running_requests", "failed_requests": "failed_requests",
                    "mailer_status": "mailer_status", "zombies": "zombie_processes",
                    "missing_ports": "missing_ports"}


def _findings(frames: dict[str, DataFrame], as_of, threshold: float) -> DataFrame:
    return findings.standard_findings(
        as_of=as_of, capacity_threshold=threshold,
        **{arg: frames[name] for arg, name in _FINDING_SOURCES.items()})


def run(s, as_of, out_dir: str, parallel_jobs: int = 4, staged: bool = False, **kwargs) -> dict[str, str]:
    """Compute and write every report and the findings for ``as_of``.

    Most reports are small next to the cluster, so up to ``parallel_jobs``
    report writes are submitted at once from driver threads (Spark schedules
    concurrent jobs side by side); each write is still a distributed job.
    The findings are then built from the written alert tables (read back for
    this day only), not recomputed from the sources: no second scan, and the
    lineage starts at a durable table.

    ``staged``: nothing is visible before the commit at the end, and all of it
    after; read with ``commits.read`` and ``findings.read_findings``.
    Returns report name -> output path."""
    reports, _ = health_check(s, as_of, **kwargs)
    threshold = kwargs.get("threshold", codes.CAPACITY_THRESHOLD)
    base = out_dir.rstrip("/")
    day = F.to_date(as_of_lit(as_of))
    stage = commits.Run(s.spark, base, parse_as_of(as_of).date().isoformat()) if staged else None

    def write(item) -> tuple[str, str]:
        name, df = item
        if stage:
            return name, stage.write(df, name)
        path = f"{base}/{name}"
        (df.write.mode("overwrite").option("partitionOverwriteMode", "static")
           .parquet(f"{path}/as_of_date={parse_as_of(as_of).date().isoformat()}"))
        return name, path

    try:
        # the shared usage frame first, so the alert and findings reuse its cache
        paths = dict([write(("tablespace_usage", reports["tablespace_usage"]))])
        rest = [(n, d) for n, d in reports.items() if n != "tablespace_usage"]
        with ThreadPoolExecutor(max_workers=max(1, parallel_jobs)) as pool:
            paths.update(pool.map(write, rest))
        spark = s.spark
        paths["findings"] = f"{base}/findings"
        checks = [findings.CHECKS[arg] for arg in _FINDING_SOURCES]
        if stage:
            written = {name: spark.read.schema(reports[name].schema).parquet(paths[name]) for name in _FINDING_SOURCES.values()}
            findings.stage_findings(_findings(written, as_of, threshold), stage, checks)
            stage.commit()
            return paths
        # read back with the known schema: an empty report has no data files to infer it from
        written = {name: (spark.read.schema(reports[name].withColumn("as_of_date", day).schema)
                          .parquet(paths[name]).where(F.col("as_of_date") == day).drop("as_of_date"))
                   for name in _FINDING_SOURCES.values()}
        findings.write_findings(_findings(written, as_of, threshold), paths["findings"], as_of, checks)
    finally:
        reports["tablespace_usage"].unpersist()
    return paths
