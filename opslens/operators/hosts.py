"""Host checks over sample and snapshot tables of a whole fleet.

Every per-host ordering runs partitioned by host (never an unpartitioned
window). Ordered windows that need neighbouring rows (CPU deltas, rolling
means) go through ``plans.skew`` so that one host with a large share of the
samples is split by time bucket; top-n per host relies on the partial window
group limit Spark plans for ``row_number() <= n``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.functions.exprs import as_of_lit, time_bucket
from opslens.plans.joins import broadcast_if_small
from opslens.plans.skew import previous_values, rolling_mean, top_n_per_key

CPU_FIELDS = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
IDLE_FIELDS = ("idle", "iowait")
DEFAULT_BUCKET = "hour"


def _bucket(ts: str, unit: str | None) -> Column | None:
    """Time bucket of the skew-safe windows; ``None`` runs the plain per-host
    window instead (for fleets where no host can hold a large share)."""
    return None if unit is None else time_bucket(ts, unit)


# ---------------------------------------------------------------- probes

def probe_status(probe_results: DataFrame) -> DataFrame:
    """Each probe with its outcome: 200 is SUCCESS, anything else ERROR.
    Columns: host, url, ts, http_status, outcome."""
    return probe_results.select(
        "host", "url", "ts", "http_status",
        F.when(F.col("http_status") == 200, "SUCCESS").otherwise("ERROR").alias("outcome"))


def availability(probe_results: DataFrame, by: Sequence[str] = ("url",)) -> DataFrame:
    """Share of successful probes (percent, 2 decimals).
    Columns: <by...>, probes, successes, availability_pct."""
    ok = F.when(F.col("http_status") == 200, 1).otherwise(0)
    return (probe_results.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("probes"), F.sum(ok).alias("successes"))
            .withColumn("availability_pct",
                        F.round(F.col("successes") / F.col("probes") * F.lit(100.0), 2)))


def latest_probe_status(probe_results: DataFrame, by: Sequence[str] = ("url",)) -> DataFrame:
    """Final status of each page: the status of its latest probe.
    Columns: <by...>, last_probe_ts, http_status."""
    return (probe_results.groupBy(*by)
            .agg(F.max("ts").alias("last_probe_ts"),
                 F.max_by("http_status", F.struct("ts", "http_status")).alias("http_status")))


# ------------------------------------------------------------- CPU, memory

def cpu_usage(cpu_samples: DataFrame, bucket: str | None = DEFAULT_BUCKET) -> DataFrame:
    """CPU busy percentage between consecutive counter samples of a host:
    (delta total - delta idle) / delta total * 100, 2 decimals, where total is
    the sum of the listed counter fields and idle is idle + iowait. NULL when
    a counter went backwards (reset) or nothing elapsed. One row per pair of
    consecutive samples.
    Columns: host, start_ts, end_ts, cpu_pct."""
    total = sum((F.col(c) for c in CPU_FIELDS[1:]), F.col(CPU_FIELDS[0]))
    idle = F.col(IDLE_FIELDS[0]) + F.col(IDLE_FIELDS[1])
    df = cpu_samples.select("host", "ts", total.alias("total"), idle.alias("idle_t"))
    df = previous_values(df, ["host"], ["ts", "total", "idle_t"], ["ts", "total", "idle_t"], _bucket("ts", bucket))
    d_total = F.col("total") - F.col("prev_total")
    d_idle = F.col("idle_t") - F.col("prev_idle_t")
    pct = F.when((d_total > 0) & (d_idle >= 0) & (d_idle <= d_total),
                 F.round((d_total - d_idle) / d_total * F.lit(100.0), 2))
    return (df.where(F.col("prev_ts").isNotNull())
            .select("host", F.col("prev_ts").alias("start_ts"), F.col("ts").alias("end_ts"),
                    pct.alias("cpu_pct")))


def memory_usage(mem_samples: DataFrame, samples: int = 5, bucket: str | None = DEFAULT_BUCKET) -> DataFrame:
    """Memory used percentage per sample, and its mean over the host's last
    ``samples`` samples (fewer at the start), 2 decimals.
    Columns: host, ts, mem_pct, mem_pct_avg."""
    pct = F.try_divide(F.col("mem_used") * F.lit(100.0), F.col("mem_total"))
    df = mem_samples.select("host", "ts", pct.alias("mem_pct"))
    out = rolling_mean(df, ["host"], ["ts", "mem_pct"], {"mem_pct_avg": F.col("mem_pct")}, samples,
                       _bucket("ts", bucket))
    return out.select("host", "ts", F.round("mem_pct", 2).alias("mem_pct"),
                      F.round("mem_pct_avg", 2).alias("mem_pct_avg"))


def swap_usage(mem_samples: DataFrame, samples: int = 5, bucket: str | None = DEFAULT_BUCKET) -> DataFrame:
    """Swap used percentage as ``memory_usage`` does it; hosts without swap
    (total 0) read 'Not Enabled' and have no percentage.
    Columns: host, ts, swap_pct, swap_pct_avg, swap_state."""
    enabled = F.col("swap_total") > 0
    pct = F.when(enabled, F.col("swap_used") * F.lit(100.0) / F.col("swap_total"))
    df = mem_samples.select("host", "ts", pct.alias("swap_pct"), enabled.alias("_on"))
    out = rolling_mean(df, ["host"], ["ts", "swap_pct"], {"swap_pct_avg": F.col("swap_pct")}, samples,
                       _bucket("ts", bucket))
    return out.select("host", "ts", F.round("swap_pct", 2).alias("swap_pct"),
                      F.round("swap_pct_avg", 2).alias("swap_pct_avg"),
                      F.when(F.col("_on"), "Enabled").otherwise("Not Enabled").alias("swap_state"))


def recent_memory(mem_samples: DataFrame, samples: int = 5) -> DataFrame:
    """Report form: per host, mean memory and swap percentage of the latest
    ``samples`` samples (swap NULL when not enabled).
    Columns: host, samples, mem_pct_avg, swap_pct_avg, swap_state."""
    last = top_n_per_key(mem_samples, ["host"], [F.col(c).desc() for c in ("ts", "mem_used", "swap_used")], samples)
    enabled = F.col("swap_total") > 0
    return (last.groupBy("host").agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.avg(F.try_divide(F.col("mem_used") * F.lit(100.0), F.col("mem_total"))), 2)
        .alias("mem_pct_avg"),
        F.round(F.avg(F.when(enabled, F.col("swap_used") * F.lit(100.0) / F.col("swap_total"))), 2)
        .alias("swap_pct_avg"),
        F.when(F.max(enabled.cast("int")) == 1, "Enabled").otherwise("Not Enabled").alias("swap_state")))


# ------------------------------------------------------------ file systems

def filesystem_alerts(fs_usage: DataFrame, threshold: float = codes.CAPACITY_THRESHOLD,
                      exclude: str = codes.FS_EXCLUDE_PATTERN) -> DataFrame:
    """File systems (not tmpfs / cdrom) at or above ``threshold`` percent use.
    Columns: host, filesystem, use_pct."""
    return (fs_usage.where(~F.col("filesystem").rlike(exclude)
                           & (F.col("use_pct") >= F.lit(threshold)))
            .select("host", "filesystem", "use_pct"))


def filesystem_usage(fs_usage: DataFrame) -> DataFrame:
    """File-system listing without tmpfs.
    Columns: host, filesystem, size, used, available, use_pct, mounted_on."""
    return fs_usage.where(~F.col("filesystem").contains("tmpfs")).select(
        "host", "filesystem", "size", "used", "available", "use_pct", "mounted_on")


# ------------------------------------------------------------ text parsers

def load_average(uptime_lines: DataFrame) -> DataFrame:
    """1, 5 and 15 minute load averages out of `uptime` lines: the text after
    the first 'letter:' ('average:'), split on commas.
    Columns: host, ts, load_1, load_5, load_15."""
    tail = F.get(F.split(F.col("line"), "[a-z]:"), F.lit(1))
    parts = F.split(tail, ",")
    loads = [F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in range(3)]
    return uptime_lines.select("host", "ts", loads[0].alias("load_1"), loads[1].alias("load_5"),
                               loads[2].alias("load_15"))


def uptime_by_host(boot_samples: DataFrame, as_of) -> DataFrame:
    """Uptime at ``as_of`` from the boot time reported with each host's latest
    sample. Columns: host, boot_time, uptime_hours."""
    latest = boot_samples.groupBy("host").agg(F.max_by("boot_time", F.struct("ts", "boot_time")).alias("boot_time"))
    hours = F.timestamp_diff("MICROSECOND", F.col("boot_time"), as_of_lit(as_of)) / F.lit(3.6e9)
    return latest.select("host", "boot_time", hours.alias("uptime_hours"))


def vmstat_samples(vmstat_lines: DataFrame, columns: Sequence[str] = codes.VMSTAT_COLUMNS) -> DataFrame:
    """`vmstat -t -w` lines as typed rows: header lines (not starting with a
    number) and lines cut short are dropped and the whitespace-separated
    fields are named by position; counters are BIGINT, date and time stay text.
    Columns: host, line_no, run ... steal, date, time."""
    parts = F.split(F.trim(F.col("line")), r"\s+")
    data = vmstat_lines.where(F.col("line").rlike(r"^\s*[0-9]") & (F.size(parts) >= len(columns)))
    out = [F.col("host"), F.col("line_no")]
    for i, name in enumerate(columns):
        v = F.get(parts, F.lit(i))
        out.append((v if name in ("date", "time") else v.try_cast("bigint")).alias(name))
    return data.select(*out)


def logged_on_users(who_lines: DataFrame) -> DataFrame:
    """Users logged on per host with their session count (first field of each
    `who` line). Columns: host, user_name, sessions."""
    user = F.regexp_extract(F.col("line"), r"^(\S+)", 1)
    return (who_lines.select("host", user.alias("user_name"))
            .groupBy("host", "user_name").agg(F.count(F.lit(1)).alias("sessions")))


# --------------------------------------------------------------- processes

PROCESS_COLUMNS = ("ruser", "pid", "ppid", "nice", "wchan", "pmem", "pcpu", "cpu_time", "euser", "state", "flags",
                   "start_time", "thcount", "comm")


def top_processes(proc_snapshot: DataFrame, by: str = "pcpu", n: int = codes.TOP_PROCESSES) -> DataFrame:
    """The ``n`` processes with the highest ``by`` per host (ties: lower pid
    first). Columns: host, rank, ruser, pid, ppid, nice, wchan, pmem, pcpu,
    cpu_time, euser, state, flags, start_time, thcount, comm."""
    ranked = top_n_per_key(proc_snapshot, ["host"], [F.col(by).desc_nulls_last(), F.col("pid").asc()], n)
    return ranked.select("host", "rank", *PROCESS_COLUMNS)


def zombie_processes(proc_snapshot: DataFrame) -> DataFrame:
    """Processes in state Z. Columns: host, pid, comm, state."""
    return proc_snapshot.where(F.col("state").startswith("Z")).select("host", "pid", "comm", "state")


def processes_matching(proc_snapshot: DataFrame, words: Sequence[str] = codes.WATCHED_PROCESS_WORDS,
                       token: bool = False) -> DataFrame:
    """Processes whose command contains one of ``words`` as a whole word
    (underscore is a word character, so 'ora_smon_X' does not match 'smon');
    ``token=True`` splits at everything but letters and digits, so it does.
    Columns: host, pid, comm."""
    any_word = "(" + "|".join(re.escape(w) for w in words) + ")"
    pattern = rf"(^|[^A-Za-z0-9]){any_word}($|[^A-Za-z0-9])" if token else rf"\b{any_word}\b"
    return proc_snapshot.where(F.col("comm").rlike(pattern)).select("host", "pid", "comm")


def thread_count(proc_snapshot: DataFrame, limits: DataFrame) -> DataFrame:
    """Threads in use per host against its hard process limit.
    Columns: host, processes, threads, max_user_processes, used_pct."""
    use = proc_snapshot.groupBy("host").agg(F.count(F.lit(1)).alias("processes"),
                                            F.sum("thcount").cast("bigint").alias("threads"))
    return (use.join(broadcast_if_small(limits.select("host", "max_user_processes")), "host", "left")
            .withColumn("used_pct",
                        F.round(F.try_divide(F.col("threads") * F.lit(100.0), F.col("max_user_processes")), 2)))


def server_process_counts(proc_snapshot: DataFrame,
                          kinds: Sequence[str] = codes.SERVER_PROCESS_KINDS) -> DataFrame:
    """Processes per host whose command contains each kind, in one pass.
    Columns: host, <kind>... (counts)."""
    return proc_snapshot.groupBy("host").agg(
        *[F.count(F.when(F.col("comm").contains(k), 1)).alias(k) for k in kinds])


def listening_ports(listeners: DataFrame, ports: Sequence[int] = codes.WATCHED_PORTS,
                    exact: bool = False) -> DataFrame:
    """Listening sockets on the watched ports. The source filters the text
    line with the port numbers as patterns, so 17052 also matches 7052;
    ``exact=True`` compares port numbers.
    Columns: host, proto, port."""
    if exact:
        cond = F.col("port").isin(list(ports))
    else:
        cond = F.col("port").cast("string").rlike("|".join(str(p) for p in ports))
    return listeners.where(cond).select("host", "proto", "port")


def missing_ports(listeners: DataFrame, hosts: DataFrame,
                  ports: Sequence[int] = codes.WATCHED_PORTS) -> DataFrame:
    """Watched ports a host is not listening on (exact port numbers).
    Columns: host, port."""
    expected = hosts.select("host").distinct().select(
        "host", F.explode(F.array(*[F.lit(int(p)) for p in ports])).alias("port"))
    return expected.join(listeners.select("host", "port"), ["host", "port"], "left_anti")


def disk_average(disk_samples: DataFrame) -> DataFrame:
    """Averages of all disk metrics per host and device, 2 decimals.
    Columns: host, device, samples, avg_tps, avg_rkb_s, avg_wkb_s,
    avg_areq_sz, avg_aqu_sz, avg_await_ms, avg_util."""
    metrics = ("tps", "rkb_s", "wkb_s", "areq_sz", "aqu_sz", "await_ms", "util")
    return disk_samples.groupBy("host", "device").agg(
        F.count(F.lit(1)).alias("samples"), *[F.round(F.avg(m), 2).alias(f"avg_{m}") for m in metrics])


def log_tail(host_log: DataFrame, n: int = codes.LOG_TAIL_LINES, source: str | None = None) -> DataFrame:
    """The last ``n`` lines of each host's log, by line number. ``source``: the
    column that names the file, where a host has several (a live log and older
    ones): lines are numbered in each file, so each file has its own tail.
    Columns: host, (source,) line_no, line."""
    keys = ["host"] + ([source] if source else [])
    return top_n_per_key(host_log, keys, [F.col("line_no").desc()], n, "_r").select(*keys, "line_no", "line")
