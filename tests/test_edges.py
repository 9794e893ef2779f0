"""Hand-written edge rows (NULL codes, exact thresholds, equal sizes, text
ordering, parsing) that the derived snapshot tables cannot show."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opslens.operators import activity, database, hosts, requests, storage

GB = 1073741824
AS_OF = "2024-01-31 00:00:00"


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _storage_frames(spark, data, free, temp=()):
    containers = spark.createDataFrame([(1, "ROOT"), (2, "PDB1")], "con_id int, name string")
    data_files = spark.createDataFrame(
        [(c, t, i, f"/f{i}", "AVAILABLE", "YES", b, m) for i, (c, t, b, m) in enumerate(data)],
        "con_id int, tablespace_name string, file_id bigint, file_name string, status string, "
        "autoextensible string, bytes bigint, maxbytes bigint")
    free_space = spark.createDataFrame(list(free), "con_id int, tablespace_name string, bytes bigint")
    temp_files = spark.createDataFrame(
        [(c, 0, t, b, b, 8192) for c, t, b in temp],
        "con_id int, ts_no int, tablespace_name string, bytes bigint, maxbytes bigint, block_size bigint")
    return data_files, free_space, temp_files, containers


def test_capacity_full_tablespace_literal_vs_keep_full(spark):
    df, fs, tf, c = _storage_frames(spark, [(2, "FULL", 10 * GB, 10 * GB)], [])
    literal = storage.capacity_usage(df, fs, tf, c)
    assert literal.count() == 0
    full = storage.capacity_usage(df, fs, tf, c, keep_full=True)
    alerts = storage.capacity_alerts(full)
    assert _rows(alerts, "tablespace_name", "used_percentage") == [("FULL", 100.0)]


def test_capacity_zero_allocation_gives_null(spark):
    df, fs, tf, c = _storage_frames(spark, [(2, "EMPTY", 0, 0)], [(2, "EMPTY", 0)])
    usage = storage.capacity_usage(df, fs, tf, c)
    pct = usage.select(F.try_divide(F.col("allocated_space_gb") - F.col("free_space_gb"),
                                    F.col("allocated_space_gb")).alias("p")).first()["p"]
    assert pct is None
    assert storage.capacity_alerts(usage).count() == 0


def test_threshold_edges(spark):
    # 90 % used exactly: tablespace alert uses '>', file-system alert '>='
    df, fs, tf, c = _storage_frames(spark, [(2, "T", 10 * GB, 10 * GB)], [(2, "T", GB)])
    assert storage.capacity_alerts(storage.capacity_usage(df, fs, tf, c)).count() == 0
    fsu = spark.createDataFrame([("h", "/dev/sda", 90), ("h", "tmpfs", 99), ("h", "/dev/cdrom", 95)],
                                "host string, filesystem string, use_pct int")
    assert _rows(hosts.filesystem_alerts(fsu), "filesystem") == [("/dev/sda",)]


def test_temp_rows_only_with_flag(spark):
    df, fs, tf, c = _storage_frames(spark, [(2, "T", 10 * GB, 10 * GB)], [(2, "T", 0)],
                                    temp=[(2, "TEMP", GB), (2, "ZERO", 0)])
    usage = storage.capacity_usage(df, fs, tf, c)
    assert storage.capacity_alerts(usage).count() == 1
    with_temp = storage.capacity_alerts(usage, include_temp=True)
    assert _rows(with_temp, "tablespace_name") == [("T",), ("TEMP",)]


def test_database_size_union_collapses_equal_totals(spark):
    data = spark.createDataFrame([(2, 2 * GB)], "con_id int, bytes bigint")
    temp = spark.createDataFrame([(2, 2 * GB)], "con_id int, bytes bigint")
    pdbs = spark.createDataFrame([(2, "PDB1")], "con_id int, name string")
    assert storage.database_size(data, temp, pdbs).first()["total_size_gb"] == 2.0
    assert storage.database_size(data, temp, pdbs, union_all=True).first()["total_size_gb"] == 4.0
    root = spark.createDataFrame([(1, GB)], "con_id int, bytes bigint")
    assert storage.database_size(root, root.limit(0), pdbs).first()["database_name"] == "CDB"


def _sessions(spark, rows):
    s = spark.createDataFrame(
        rows, "session_id bigint, user_id bigint, last_connect timestamp_ntz, disabled_flag string, "
              "pseudo_flag string, limit_time int, counter int, limit_connects int")
    u = spark.createDataFrame([(1, "ALICE", "a"), (0, "GUEST", "g")],
                              "user_id bigint, user_name string, description string")
    return s, u


def test_online_users_timeout_parameter(spark):
    t = dt.datetime(2024, 1, 30, 23, 0)  # one hour before as_of
    s, u = _sessions(spark, [(1, 1, t, "N", "N", 2, 0, 45)])
    # profile NULL or 0 -> the row's own 2 h limit -> online
    assert activity.online_users(s, u, AS_OF).count() == 1
    assert activity.online_users(s, u, AS_OF, timeout_minutes=0).count() == 1
    # 30 minutes -> 0.5 h -> expired
    assert activity.online_users(s, u, AS_OF, timeout_minutes=30).count() == 0
    # per-database value as a column
    assert activity.online_users(s, u, AS_OF, timeout_minutes=F.lit(None).cast("double")).count() == 1


def test_online_users_null_flag_and_guest_dropped(spark):
    t = dt.datetime(2024, 1, 30, 23, 0)
    s, u = _sessions(spark, [(1, 1, t, None, "N", 2, 0, 45), (2, 0, t, "N", "N", 2, 0, 45),
                             (3, 1, t, "N", "N", 2, 45, 45), (4, 1, t, "N", "N", 2, 44, 45)])
    assert _rows(activity.online_users(s, u, AS_OF), "session_id") == [(4,)]
    assert activity.online_user_count(s, u, AS_OF).first()["online_users"] == 1


def _requests(spark, rows):
    return spark.createDataFrame(
        rows, "request_id bigint, requested_by bigint, program_id bigint, application_id int, "
              "responsibility_id int, phase_code string, status_code string, request_date timestamp_ntz, "
              "requested_start_date timestamp_ntz, actual_start_date timestamp_ntz, "
              "actual_completion_date timestamp_ntz, completion_text string, description string, "
              "argument_text string")


def test_request_summary_null_phase_label(spark):
    t = dt.datetime(2024, 1, 30, 20, 0)
    r = _requests(spark, [(1, 1, 1, 0, 0, None, "E", t, t, t, t, "x", "d", "a"),
                          (2, 1, 1, 0, 0, "R", "R", t, t, t, t, "x", "d", "a"),
                          (3, 1, 1, 0, 0, "R", "I", t, t, t, t, "x", "d", "a")])
    out = _rows(requests.request_summary(r, AS_OF), "status", "request_count")
    assert out == [(" With Error", 1), ("Running With Normal", 1), ("Running With Normal", 1)]
    merged = _rows(requests.request_summary(r, AS_OF, merge_labels=True), "status", "request_count")
    assert merged == [(" With Error", 1), ("Running With Normal", 2)]


def test_long_running_rounds_before_compare(spark):
    start = dt.datetime(2024, 1, 30, 23, 0, 0, 300)  # 59.999995 min before as_of -> rounds to 60.0
    late = dt.datetime(2024, 1, 30, 22, 58)
    r = _requests(spark, [(1, 1, 7, 1, 0, "R", "R", start, start, start, start, "", "", "a"),
                          (2, 1, 7, 1, 0, "R", "R", late, late, late, late, "", "", "a")])
    users = spark.createDataFrame([(1, "BOB")], "user_id bigint, user_name string")
    resp = spark.createDataFrame([(0, "SYSADMIN")], "responsibility_id int, responsibility_name string")
    progs = spark.createDataFrame([(7, 1, "US", "P7")],
                                  "program_id bigint, application_id int, language string, user_program_name string")
    out = requests.long_running_requests(r, users, resp, progs, AS_OF)
    assert _rows(out, "requestid", "runtime_min", "status") == [(2, 62.0, "R:RUNNING")]


def test_backup_order_is_text_order_by_default(spark):
    b = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 31, 10), dt.datetime(2024, 1, 31, 11)),
         (2, dt.datetime(2024, 2, 1, 10), dt.datetime(2024, 2, 1, 11))],
        "session_key bigint, start_time timestamp_ntz, end_time timestamp_ntz").select(
        "*", F.lit("COMPLETED").alias("status"), F.lit("YES").alias("autobackup_done"),
        F.lit(1).alias("autobackup_count"), F.lit("DB FULL").alias("input_type"),
        F.lit(60).cast("bigint").alias("elapsed_seconds"))
    as_of = "2024-02-02 00:00:00"
    literal = [r["session_key"] for r in database.backup_summary(b, as_of).collect()]
    fixed = [r["session_key"] for r in database.backup_summary(b, as_of, order_by_time=True).collect()]
    assert literal == [1, 2]  # '31-JAN-...' > '01-FEB-...' as text
    assert fixed == [2, 1]


def test_month_format(spark):
    from opslens.functions.exprs import report_datetime, report_datetime_short
    df = spark.createDataFrame([(dt.datetime(2025, 1, 2, 3, 4, 5),)], "t timestamp_ntz")
    row = df.select(report_datetime("t").alias("a"), report_datetime_short("t").alias("b")).first()
    assert (row["a"], row["b"]) == ("02-JAN-2025 03:04:05", "02-JAN-25 03:04:05")


def test_whole_word_process_match(spark):
    p = spark.createDataFrame([("h", 1, "smon"), ("h", 2, "ora_smon_X"), ("h", 3, "tnslsnr -inherit")],
                              "host string, pid bigint, comm string")
    assert _rows(hosts.processes_matching(p), "pid") == [(1,), (3,)]


def test_uptime_line_parse(spark):
    lines = spark.createDataFrame(
        [("h", dt.datetime(2024, 1, 1), " 10:00:00 up 3 days, 1 user,  load average: 0.1, 0.2, 0.3")],
        "host string, ts timestamp_ntz, line string")
    r = hosts.load_average(lines).first()
    assert (r["load_1"], r["load_5"], r["load_15"]) == (0.1, 0.2, 0.3)


def test_vmstat_lines(spark):
    fields = " ".join(str(i) for i in range(17)) + " 2024-01-30 10:00:00"
    lines = spark.createDataFrame(
        [("h", 1, "--procs-- -----memory-----"), ("h", 2, " r  b  swpd  free"), ("h", 3, "  " + fields)],
        "host string, line_no bigint, line string")
    out = hosts.vmstat_samples(lines)
    assert out.count() == 1
    r = out.first()
    assert len(out.columns) == 21 and r["run"] == 0 and r["steal"] == 16 and r["time"] == "10:00:00"


def test_logged_on_users(spark):
    w = spark.createDataFrame([("h1", "alice pts/0 2024-01-30 10:00"), ("h1", "bob pts/1 2024-01-30 10:01"),
                               ("h1", "alice pts/2 2024-01-30 10:02")], "host string, line string")
    assert _rows(hosts.logged_on_users(w), "user_name", "sessions") == [("alice", 2), ("bob", 1)]


def test_latest_profile_changes_languages(spark):
    opts = spark.createDataFrame([(1, "OPT1"), (2, "OPT2")], "profile_option_id bigint, profile_option_name string")
    tl = spark.createDataFrame([("OPT1", "US", "Opt one"), ("OPT1", "D", "Opt eins"), ("OPT2", "US", "Opt two")],
                               "profile_option_name string, language string, user_profile_option_name string")
    vals = spark.createDataFrame([(1, 10001, "v1", dt.datetime(2024, 1, 30), 5),
                                  (2, 10009, "v2", dt.datetime(2024, 1, 29), 5)],
                                 "profile_option_id bigint, level_id int, profile_option_value string, "
                                 "last_update_date timestamp_ntz, last_updated_by bigint")
    users = spark.createDataFrame([(5, "ADMIN")], "user_id bigint, user_name string")
    literal = requests.latest_profile_changes(opts, vals, tl, users)
    assert _rows(literal, "profile_value") == [("v1",), ("v1",)]
    us = requests.latest_profile_changes(opts, vals, tl, users, language="US")
    assert _rows(us, "profile_value", "option_level") == [("v1", "Site"), ("v2", "No idea, boss")]


def test_cpu_first_sample_and_reset(spark):
    cols = "host string, ts timestamp_ntz, user bigint, nice bigint, system bigint, idle bigint, " \
           "iowait bigint, irq bigint, softirq bigint, steal bigint"
    t = [dt.datetime(2024, 1, 1, 0, m) for m in range(3)]
    cpu = spark.createDataFrame([("h", t[0], 100, 0, 0, 100, 0, 0, 0, 0),
                                 ("h", t[1], 150, 0, 0, 150, 0, 0, 0, 0),   # 50 busy / 100 -> 50 %
                                 ("h", t[2], 10, 0, 0, 10, 0, 0, 0, 0)],    # reset -> NULL
                                cols)
    out = sorted((r["end_ts"], r["cpu_pct"]) for r in hosts.cpu_usage(cpu).collect())
    assert out == [(t[1], 50.0), (t[2], None)]


def test_swap_not_enabled(spark):
    m = spark.createDataFrame([("h", dt.datetime(2024, 1, 1), 100, 50, 0, 0)],
                              "host string, ts timestamp_ntz, mem_total bigint, mem_used bigint, "
                              "swap_total bigint, swap_used bigint")
    r = hosts.swap_usage(m).first()
    assert r["swap_state"] == "Not Enabled" and r["swap_pct"] is None
    assert hosts.recent_memory(m).first()["mem_pct_avg"] == 50.0


def test_missing_ports(spark):
    lst = spark.createDataFrame([("h1", "tcp", 7052), ("h1", "tcp", 17052)], "host string, proto string, port int")
    hosts_df = spark.createDataFrame([("h1",), ("h2",)], "host string")
    out = _rows(hosts.missing_ports(lst, hosts_df), "host", "port")
    assert out == [("h1", 1571), ("h1", 8050), ("h2", 1571), ("h2", 7052), ("h2", 8050)]
    assert hosts.listening_ports(lst).count() == 2           # 17052 matches as text
    assert hosts.listening_ports(lst, exact=True).count() == 1


def test_archive_whole_days(spark):
    log = spark.createDataFrame(
        [(dt.datetime(2024, 1, 25, 1, 0), 1, 8192), (dt.datetime(2024, 1, 24, 23, 0), 1, 8192),
         (dt.datetime(2024, 1, 30, 12, 0), 2, 8192)],
        "completion_time timestamp_ntz, blocks bigint, block_size bigint")
    as_of = "2024-01-31 12:00:00"  # 6 days back: 2024-01-25 12:00
    partial = _rows(storage.archive_per_day(log, as_of), "day", "archives_generated_per_day")
    assert partial == [(dt.datetime(2024, 1, 30), 1)]
    whole = _rows(storage.archive_per_day(log, as_of, whole_days=True), "day", "archives_generated_per_day")
    assert whole == [(dt.datetime(2024, 1, 25), 1), (dt.datetime(2024, 1, 30), 1)]
