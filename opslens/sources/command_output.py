"""Parsers for captured command output and counter files.

The host checks run on structured sample tables; in a fleet those are landed
from the text the collectors print. Each parser takes a DataFrame of lines
``(host, [ts,] line)`` and returns typed rows using only built-in string
functions (split on whitespace, regexp_extract, try_cast), so parsing runs in
the scan's codegen stage and scales with the number of lines. Header and
unrelated lines are dropped by a prefix or pattern filter, never by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"\s+"


def _fields(line: str | Column = "line") -> Column:
    c = F.col(line) if isinstance(line, str) else line
    return F.split(F.trim(c), WS)


def _field(parts: Column, i: int, cast: str | None = None) -> Column:
    """The i-th field (from 1; -1: the last), null where the line is shorter."""
    v = F.try_element_at(parts, F.lit(i))
    return v.try_cast(cast) if cast else v


def _line(pattern: str) -> Column:
    return F.col("line").rlike(pattern)


def _use_pct() -> Column:
    return F.regexp_extract(F.coalesce(_field(_fields(), 5), F.lit("")), r"^([0-9]+)%?$", 1).try_cast("int")


def _port() -> Column:
    return F.regexp_extract(F.coalesce(_field(_fields(), 4), F.lit("")), r":([0-9]+)$", 1).try_cast("int")


PS_FIELDS = 14


def _rules(kind: str) -> tuple[Column, Column]:
    """Which lines of a kind carry data, and which of these are whole. A line
    cut short or wrapped by its collector is not."""
    n = F.size(_fields())
    return {
        "proc_stat": (_line(r"^cpu\s"), (n >= 5) & _field(_fields(), 5, "bigint").isNotNull()),
        "free": (_line("^(Mem|Swap):"), (n >= 3) & _field(_fields(), 3, "bigint").isNotNull()),
        "meminfo": (_line("^(MemTotal|MemAvailable|SwapTotal|SwapFree):"), _field(_fields(), 2, "bigint").isNotNull()),
        "df": (_line(r"\S") & ~_line("^Filesystem"), (n >= 6) & _use_pct().isNotNull()),
        "ps": (_line(r"^\S") & ~_line("^RUSER"), (n >= PS_FIELDS) & _field(_fields(), 2, "bigint").isNotNull()),
        "netstat": (_line("^(tcp|udp)"), _port().isNotNull()),
        "sar": (_line("^[0-9]{2}:[0-9]{2}:[0-9]{2}") & ~_line(r"\sDEV\s"), (n >= 9) & _field(_fields(), 9, "double").isNotNull()),
        "who": (_line(r"^\S"), n >= 6),
    }[kind]


def whole_lines(lines: DataFrame, kind: str) -> DataFrame:
    """The data lines of a kind that can be parsed."""
    data, whole = _rules(kind)
    return lines.where(data & whole)


def rejected_lines(lines: DataFrame, kind: str) -> DataFrame:
    """Data lines and those of them that the parser leaves out, per host.
    Columns: host, data_lines, rejected."""
    data, whole = _rules(kind)
    return lines.where(data).groupBy("host").agg(
        F.count(F.lit(1)).alias("data_lines"), F.count(F.when(~F.coalesce(whole, F.lit(False)), 1)).alias("rejected"))


def _keys(df: DataFrame, *extra: str) -> list[str]:
    return ["host"] + [c for c in ("ts",) + extra if c in df.columns]


def proc_stat_cpu(lines: DataFrame) -> DataFrame:
    """The aggregate ``cpu`` line of /proc/stat (per-core ``cpuN`` and other
    counters are dropped) as cumulative counters.
    Columns: host, ts, user, nice, system, idle, iowait, irq, softirq, steal."""
    names = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
    parts = _fields()
    return whole_lines(lines, "proc_stat").select(
        *_keys(lines), *[F.coalesce(_field(parts, i + 2, "bigint"), F.lit(0).cast("bigint")).alias(n) for i, n in enumerate(names)])


def core_counts(lines: DataFrame) -> DataFrame:
    """Cores per host: the distinct ``cpuN`` lines of /proc/stat.
    Columns: host, cores."""
    core = F.regexp_extract(F.col("line"), r"^(cpu[0-9]+)\s", 1)
    return (lines.where(_line(r"^cpu[0-9]+\s")).groupBy("host", core.alias("core")).agg(F.lit(1).alias("one"))
            .groupBy("host").agg(F.count(F.lit(1)).alias("cores")))


def free_memory(lines: DataFrame) -> DataFrame:
    """`free` output (one ``Mem:`` and one ``Swap:`` line per sample; the header
    is dropped) as one row per sample, both lines folded in one aggregation.
    Columns: host, ts, mem_total, mem_used, swap_total, swap_used."""
    parts = _fields()
    kind = _field(parts, 1)
    rows = whole_lines(lines, "free").select(
        *_keys(lines), kind.alias("kind"), _field(parts, 2, "bigint").alias("total"),
        _field(parts, 3, "bigint").alias("used"))

    def pick(k: str, c: str) -> Column:
        return F.max(F.when(F.col("kind") == k, F.col(c)))

    return rows.groupBy(*_keys(lines)).agg(
        pick("Mem:", "total").alias("mem_total"), pick("Mem:", "used").alias("mem_used"),
        pick("Swap:", "total").alias("swap_total"), pick("Swap:", "used").alias("swap_used"))


def meminfo(lines: DataFrame) -> DataFrame:
    """/proc/meminfo as one row per sample: used is total less available, as
    ``free`` counts it; a swap total of 0 means that swap is not enabled.
    Columns: host, ts, mem_total, mem_used, swap_total, swap_used."""
    parts = _fields()
    rows = whole_lines(lines, "meminfo").select(*_keys(lines), _field(parts, 1).alias("name"), _field(parts, 2, "bigint").alias("kb"))

    def value(name: str) -> Column:
        return F.max(F.when(F.col("name") == f"{name}:", F.col("kb")))

    return rows.groupBy(*_keys(lines)).agg(
        value("MemTotal").alias("mem_total"), (value("MemTotal") - value("MemAvailable")).alias("mem_used"),
        value("SwapTotal").alias("swap_total"), (value("SwapTotal") - value("SwapFree")).alias("swap_used"))


def df_usage(lines: DataFrame) -> DataFrame:
    """`df` output: the header is dropped, the file system is the first field,
    use percentage the fifth with '%' stripped, mount point the last.
    Columns: host, filesystem, size, used, available, use_pct, mounted_on."""
    parts = _fields()
    return whole_lines(lines, "df").select(
        *_keys(lines), _field(parts, 1).alias("filesystem"), _field(parts, 2).alias("size"), _field(parts, 3).alias("used"),
        _field(parts, 4).alias("available"), _use_pct().alias("use_pct"), _field(parts, -1).alias("mounted_on"))


def ps_snapshot(lines: DataFrame) -> DataFrame:
    """`ps -eo ruser,pid,ppid,nice,wchan,pmem,pcpu,time,euser,state,flags,stime,
    thcount,comm` output (header dropped).
    Columns: host, ruser, pid, ppid, nice, wchan, pmem, pcpu, cpu_time, euser,
    state, flags, start_time, thcount, comm."""
    # at most 14 parts: the command may contain blanks and stays whole in the last one
    parts = F.split(F.trim(F.col("line")), WS, PS_FIELDS)
    fields = [("ruser", None), ("pid", "bigint"), ("ppid", "bigint"), ("nice", "int"), ("wchan", None), ("pmem", "double"), ("pcpu", "double"),
              ("cpu_time", None), ("euser", None), ("state", None), ("flags", None), ("start_time", None), ("thcount", "int"), ("comm", None)]
    return whole_lines(lines, "ps").select(*_keys(lines), *[_field(parts, i + 1, cast).alias(name) for i, (name, cast) in enumerate(fields)])


def netstat_listeners(lines: DataFrame) -> DataFrame:
    """`netstat -tuln` output: protocol and the port of the local address
    (after its last colon); the two header lines are dropped.
    Columns: host, proto, port."""
    return whole_lines(lines, "netstat").select(*_keys(lines), _field(_fields(), 1).alias("proto"), _port().alias("port"))


# place in the line; the last four counted from its end, since newer versions print a discard rate before them
SAR_FIELDS = {"tps": 3, "rkb_s": 4, "wkb_s": 5, "areq_sz": -4, "aqu_sz": -3, "await_ms": -2, "util": -1}


def sar_disk(lines: DataFrame) -> DataFrame:
    """`sar -pd` interval lines as disk samples. Header lines (they name the
    ``DEV`` column) and the ``Average:`` summary lines are dropped: the
    averages are recomputed from the samples (``hosts.disk_average``).
    Fields: time, device, tps, rkB/s, wkB/s, areq-sz, aqu-sz, await, %util.
    Columns: host, ts, device, tps, rkb_s, wkb_s, areq_sz, aqu_sz, await_ms, util."""
    parts = _fields()
    return whole_lines(lines, "sar").select(*_keys(lines), _field(parts, 2).alias("device"),
                                            *[_field(parts, i, "double").alias(n) for n, i in SAR_FIELDS.items()])


def who_sessions(lines: DataFrame) -> DataFrame:
    """`who -u` lines: user, terminal, login date and time, idle time, pid.
    Columns: host, user_name, terminal, login_time, idle, pid."""
    parts = _fields()
    return whole_lines(lines, "who").select(
        *_keys(lines), _field(parts, 1).alias("user_name"), _field(parts, 2).alias("terminal"),
        F.concat_ws(" ", _field(parts, 3), _field(parts, 4)).alias("login_time"), _field(parts, 5).alias("idle"),
        _field(parts, 6, "bigint").alias("pid"))


_UPTIME_UNITS = (("week", 7 * 24 * 60), ("day", 24 * 60), ("hour", 60), ("minute", 1))


def uptime_pretty(lines: DataFrame) -> DataFrame:
    """`uptime -p` lines ('up 1 week, 2 days, 3 hours, 4 minutes') as the boot
    time implied at each sample: ``ts - uptime``.
    Columns: host, ts, uptime_minutes, boot_time."""
    line = F.col("line")

    def count(unit: str) -> Column:
        # absent units extract '' -> NULL -> 0; the pattern only matches digits,
        # so a plain cast is safe (a failing try_cast per row would be slow)
        digits = F.nullif(F.regexp_extract(line, rf"([0-9]+) {unit}s?\b", 1), F.lit(""))
        return F.coalesce(digits.cast("bigint"), F.lit(0).cast("bigint"))

    minutes = sum((count(unit) * F.lit(m) for unit, m in _UPTIME_UNITS), F.lit(0).cast("bigint"))
    return (lines.where(line.startswith("up "))
            .select(*_keys(lines), minutes.alias("uptime_minutes"))
            .withColumn("boot_time", F.col("ts") - F.make_dt_interval(
                F.lit(0), F.lit(0), F.col("uptime_minutes").cast("int"), F.lit(0))))
