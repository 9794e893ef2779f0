"""Text parsers on real-looking command output, and the text-line source."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from opslens.sources import command_output as co
from opslens.sources.tables import read_text_lines

T = dt.datetime(2024, 1, 30, 12, 0)


def _lines(spark, rows, with_ts=True):
    if with_ts:
        return spark.createDataFrame([("h1", T, r) for r in rows], "host string, ts timestamp_ntz, line string")
    return spark.createDataFrame([("h1", r) for r in rows], "host string, line string")


def test_proc_stat(spark):
    lines = _lines(spark, ["cpu  4705 356 584 3699176 23060 0 277 0 0 0",
                           "cpu0 1393 280 260 914350 5606 0 134 0 0 0",
                           "intr 114930548 113199788 3 0 5 263 0 4"])
    r = co.proc_stat_cpu(lines).collect()
    assert len(r) == 1 and (r[0]["user"], r[0]["idle"], r[0]["softirq"]) == (4705, 3699176, 277)


def test_free(spark):
    lines = _lines(spark, ["               total        used        free      shared  buff/cache   available",
                           "Mem:        16303412     3420848     9466072      174540     3416492    12415904",
                           "Swap:        2097148           0     2097148"])
    r = co.free_memory(lines).first()
    assert (r["mem_total"], r["mem_used"], r["swap_total"], r["swap_used"]) == (16303412, 3420848, 2097148, 0)


def test_df(spark):
    lines = _lines(spark, ["Filesystem      Size  Used Avail Use% Mounted on",
                           "/dev/sda1        53G   48G  2.8G  95% /",
                           "tmpfs           8.4G     0  8.4G   0% /dev/shm"], with_ts=False)
    out = sorted((r["filesystem"], r["use_pct"], r["mounted_on"]) for r in co.df_usage(lines).collect())
    assert out == [("/dev/sda1", 95, "/"), ("tmpfs", 0, "/dev/shm")]


def test_ps(spark):
    lines = _lines(spark, ["RUSER      PID    PPID  NI WCHAN  %MEM %CPU     TIME EUSER    S F STIME THCNT COMMAND",
                           "oracle    1234       1   0 ep_pol  3.1 12.5 00:10:02 oracle   S 0 10:01    40 ora_pmon_CDB",
                           "root         7       2  -5 -       0.0  0.0 00:00:00 root     Z 1 Jan01     1 tnslsnr LISTENER -inherit"], with_ts=False)
    out = sorted((r["pid"], r["pcpu"], r["state"], r["comm"]) for r in co.ps_snapshot(lines).collect())
    assert out == [(7, 0.0, "Z", "tnslsnr LISTENER -inherit"), (1234, 12.5, "S", "ora_pmon_CDB")]
    r = co.ps_snapshot(lines).where("pid = 1234").first()
    assert (r["ruser"], r["ppid"], r["nice"], r["wchan"], r["pmem"], r["cpu_time"], r["euser"], r["flags"], r["start_time"], r["thcount"]) == (
        "oracle", 1, 0, "ep_pol", 3.1, "00:10:02", "oracle", "0", "10:01", 40)


def test_torn_lines_are_left_out_and_counted(spark):
    torn = {
        "proc_stat": (["cpu  1 2 3 4 5 6 7", "cpu", "cpu  1 2", "cpu0 1 2 3 4 5 6 7 8"], co.proc_stat_cpu, 1, (2, 1)),
        "free": (["Mem:   10   5", "Mem:", "Swap:  4", "total used"], co.free_memory, 1, (3, 2)),
        "meminfo": (["MemTotal:  10 kB", "MemAvailable:", "MemFree: 1 kB"], co.meminfo, 1, (2, 1)),
        "df": (["Filesystem Size", "/dev/mapper/long", "   10G  9G  1G  90% /x", "/dev/sda 10G 9G 1G 90% /"], co.df_usage, 1, (3, 2)),
        "ps": (["oracle 12", "root x 1 0 - 1 1 0 a S 0 0 1 cmd"], co.ps_snapshot, 0, (2, 2)),
        "netstat": (["tcp 0", "tcp 0 0 1.2.3.4:", "tcp 0 0 1.2.3.4:22 0.0.0.0:* LISTEN"], co.netstat_listeners, 1, (3, 2)),
        "sar": (["10:00:00 sda 1.0", "10:00:00 sda 1 2 3 4 5 6 7"], co.sar_disk, 1, (2, 1)),
        "who": (["u pts/1", "u pts/1 2024-01-01 10:00 . 77"], co.who_sessions, 1, (2, 1)),
    }
    for kind, (text, parse, rows, counts) in torn.items():
        lines = _lines(spark, text)
        assert len(parse(lines).collect()) == rows, kind
        r = co.rejected_lines(lines, kind).first()
        assert (r["data_lines"], r["rejected"]) == counts, kind


def test_short_uptime_and_vmstat_lines(spark):
    from opslens.operators import hosts
    lines = _lines(spark, [" 10:00:00 up 3 days", " 10:00:00 up 1 day, load average: 1.5, 2.5"])
    out = sorted((r["load_1"] or 0, r["load_5"] or 0, r["load_15"]) for r in hosts.load_average(lines).collect())
    assert out == [(0, 0, None), (1.5, 2.5, None)]
    vm = lines.selectExpr("host", "cast(1 as bigint) as line_no", "' 1 2 3' as line")
    assert hosts.vmstat_samples(vm).collect() == []


def test_core_counts(spark):
    lines = _lines(spark, ["cpu  1 2 3 4", "cpu0 1 2 3 4", "cpu1 1 2 3 4", "cpu1 2 3 4 5", "intr 4"])
    assert co.core_counts(lines).first()["cores"] == 2


def test_log_tail_of_each_file(spark):
    from opslens.operators import hosts
    rows = [("h", "alert.log", i, f"new {i}") for i in range(5)] + [("h", "alert.log.1", i, f"old {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "host string, source string, line_no long, line string")
    got = {(r["source"], r["line"]) for r in hosts.log_tail(df, 2, source="source").collect()}
    assert got == {("alert.log", "new 3"), ("alert.log", "new 4"), ("alert.log.1", "old 48"), ("alert.log.1", "old 49")}


def test_netstat(spark):
    lines = _lines(spark, ["Active Internet connections (only servers)",
                           "Proto Recv-Q Send-Q Local Address           Foreign Address         State",
                           "tcp        0      0 0.0.0.0:7052            0.0.0.0:*               LISTEN",
                           "tcp6       0      0 :::1571                 :::*                    LISTEN",
                           "udp        0      0 127.0.0.1:323           0.0.0.0:*"], with_ts=False)
    out = sorted((r["proto"], r["port"]) for r in co.netstat_listeners(lines).collect())
    assert out == [("tcp", 7052), ("tcp6", 1571), ("udp", 323)]


def test_text_line_source_keeps_file_order(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="opslens-text-"), "hostA")
    os.makedirs(d)
    with open(os.path.join(d, "alert.log"), "w") as fh:
        fh.write("\n".join(f"line {i}" for i in range(50)) + "\n")
    df = read_text_lines(spark, d)
    rows = sorted(df.collect(), key=lambda r: r["line_no"])
    assert [r["line"] for r in rows] == [f"line {i}" for i in range(50)]
    assert {r["host"] for r in rows} == {"hostA"}


def test_sar_disk(spark):
    lines = _lines(spark, [
        "12:00:01          DEV       tps     rkB/s     wkB/s     dkB/s   areq-sz    aqu-sz     await     %util",
        "12:00:03          sda     12.50      0.00    100.00      0.00      8.00      0.01      0.80      1.25",
        "12:00:03      nvme0n1      3.00      4.00      0.00      0.00      1.33      0.00      0.10      0.30",
        "Average:          sda     11.00      0.00     90.00      0.00      8.18      0.01      0.75      1.10"])
    out = sorted((r["device"], r["tps"], r["util"]) for r in co.sar_disk(lines).collect())
    assert out == [("nvme0n1", 3.0, 0.3), ("sda", 12.5, 1.25)]


def test_uptime_pretty(spark):
    lines = _lines(spark, ["up 1 week, 2 days, 3 hours, 4 minutes", "up 5 minutes", "up 1 hour"])
    got = sorted(r["uptime_minutes"] for r in co.uptime_pretty(lines).collect())
    assert got == [5, 60, 7 * 1440 + 2 * 1440 + 3 * 60 + 4]
    r = co.uptime_pretty(_lines(spark, ["up 2 hours"])).first()
    assert r["boot_time"] == T - dt.timedelta(hours=2)
