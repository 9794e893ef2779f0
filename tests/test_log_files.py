"""Rotated text files of many hosts: places of lines over splits and files, tails, stream = batch."""

from __future__ import annotations

import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from opslens.sources import log_files
from opslens.streaming import jobs

STAMPS = ("2024-01-01", "2024-01-02", "2024-01-03")


@pytest.fixture(scope="module")
def log(spark):
    """Three periods, the second with most lines, in several files each. Returns its folder and its lines in order."""
    lines = []
    for stamp, n in zip(STAMPS, (40, 900, 60), strict=True):
        for i in range(n):
            host = "hot" if i % 3 else f"h{i % 7}"
            lines.append((stamp, i, host, f"line {i}  of {stamp} é " + "x" * (i % 50)))
    path = os.path.join(tempfile.mkdtemp(prefix="opslens-log-"), "log")
    df = spark.createDataFrame(lines, "stamp string, i int, host string, line string").repartition(4)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(merge)
    spark.conf.set(merge, "false")  # small as they are, partitions stay apart
    log_files.write_log(df.select("host", "line", "stamp", "i"), path, F.col("stamp"), [F.col("i")])
    spark.conf.set(merge, old)
    return path, lines


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "100"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_files_follow_each_other(log):
    path, _ = log
    assert sorted(d for d in os.listdir(path) if d.startswith("stamp=")) == [f"stamp={s}" for s in STAMPS]
    assert len([f for f in os.listdir(os.path.join(path, "stamp=2024-01-02")) if f.startswith("part")]) > 1


def test_lines_come_back_numbered(spark, log, small_splits):
    path, lines = log
    numbered = log_files.number_lines(log_files.read_log(spark, path))
    splits = numbered.select("stamp", "file", "block").distinct().count()
    assert splits > 20  # files were cut
    got = sorted((r["stamp"], r["line_no"], r["host"], r["line"]) for r in numbered.collect())
    assert got == sorted((s, i + 1, h, line) for s, i, h, line in lines)
    by_file = log_files.number_lines(log_files.read_log(spark, path), by=("stamp", "file"))
    first = by_file.groupBy("stamp", "file").agg(F.min("line_no"), F.max("line_no"), F.count("*")).collect()
    assert all(r[2] == 1 and r[3] == r[4] for r in first)


def test_tail_over_rotations(spark, log, small_splits):
    path, lines = log
    got = {}
    for r in log_files.log_tail(log_files.read_log(spark, path), 25).orderBy("host", "rank").collect():
        got.setdefault(r["host"], []).append((r["stamp"], r["line"]))
    want = {}
    for stamp, _, host, line in reversed(lines):
        want.setdefault(host, [])
        if len(want[host]) < 25:
            want[host].append((stamp, line))
    assert got == want
    assert {s for s, _ in got["h3"]} == {"2024-01-03", "2024-01-02"}  # reaches into the rotation before


def test_stamp_bounds_read_their_folders(spark, log):
    some = log_files.read_log(spark, log[0], since="2024-01-02", until="2024-01-02")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stamp" in plan, plan
    assert some.count() == sum(s == "2024-01-02" for s, *_ in log[1])
    assert log_files.read_log(spark, log[0], since="2024-01-02").count() == sum(s >= "2024-01-02" for s, *_ in log[1])


def test_odd_lines(spark):
    path = tempfile.mkdtemp(prefix="opslens-odd-log-")
    os.makedirs(os.path.join(path, "stamp=a"))
    with open(os.path.join(path, "stamp=a", "part-0.txt"), "w", encoding="utf-8", newline="") as f:
        f.write("host1 plain\n\nnoblank\nhost2  two blanks\nhost1 \nhost3 no end")
    got = [(r["line_no"], r["host"], r["line"]) for r in log_files.number_lines(log_files.read_log(spark, path)).orderBy("line_no").collect()]
    assert got == [(1, "host1", "plain"), (2, "", ""), (3, "noblank", ""), (4, "host2", " two blanks"), (5, "host1", ""), (6, "host3", "no end")]


def test_stream_tail_equals_batch(spark, log):
    """Files arrive one a batch, the newest period first."""
    path, _ = log
    arriving, out = (tempfile.mkdtemp(prefix=f"opslens-tail-{x}-") for x in ("in", "out"))
    when = 1_700_000_000
    for stamp in reversed(STAMPS):
        os.makedirs(os.path.join(arriving, f"stamp={stamp}"))
        for f in sorted(os.listdir(os.path.join(path, f"stamp={stamp}"))):
            if f.startswith("part"):
                to = os.path.join(arriving, f"stamp={stamp}", f)
                shutil.copy(os.path.join(path, f"stamp={stamp}", f), to)
                os.utime(to, (when, when))
                when += 10
    q = jobs.start_log_tail(spark, arriving, out, lines=25, available_now=True, max_files_per_trigger=1, name=f"tail-{os.path.basename(out)}")
    q.awaitTermination(600)
    assert q.exception() is None, q.exception()
    versions = sorted(int(v[2:]) for v in os.listdir(out))
    assert len(versions) == 2 and versions[-1] > 3  # older ones are gone
    got = spark.read.parquet(f"{out}/v={versions[-1]}").select("host", "stamp", "line")
    want = log_files.log_tail(log_files.read_log(spark, path), 25).select("host", "stamp", "line")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
