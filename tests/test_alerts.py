"""Alerts on samples that arrive in any order: keyed state, one batch at a time
by DataFrame operations, and all at once give the same transitions, and these
are what a plain walk over the sorted samples gives."""

from __future__ import annotations

import datetime as dt
import os
import random
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from opslens.plans import inspect as pi
from opslens.streaming import alerts, jobs, streams
from tests.conftest import SF_SMALL

START = dt.datetime(2024, 1, 1)
LATE = dt.timedelta(hours=3)
SILENT = dt.timedelta(hours=5)
SCHEMA = "check string, host string, ts timestamp_ntz, value double, above boolean"


def made(n: int = 600, seed: int = 5):
    """Samples of two checks; one host has most of them; times to the microsecond, with gaps and ties."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        host = "hot" if rnd.random() < 0.5 else f"h{rnd.randrange(6)}"
        ts = START + dt.timedelta(microseconds=rnd.randrange(0, 4 * 24 * 3600 * 10 ** 6, 10 ** rnd.choice([0, 9])))
        value = rnd.choice([10.0, 89.9, 90.0, 95.0])
        out.append((rnd.choice(["disk", "memory"]), host, ts, value, value >= 90.0))
    return out


def walked(samples, silent=None, now=None):
    """The rules, one sample after the other."""
    out, state = [], {}
    for check, host, ts, value, above in sorted(samples, key=lambda s: s[:4]):
        last = state.get((check, host))
        was_open = bool(last and last[1])
        if was_open and silent is not None and ts > last[0] + silent:
            out.append((check, host, last[0] + silent, "CLEARED", None))
            was_open = False
        if above != was_open:
            out.append((check, host, ts, "RAISED" if above else "CLEARED", value))
        state[check, host] = (ts, above)
    for (check, host), (ts, above) in state.items():
        if above and silent is not None and now is not None and ts + silent < now:
            out.append((check, host, ts + silent, "CLEARED", None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in alerts.TRANSITIONS) for r in df.collect()), key=repr)


def arrivals(samples):
    """Micro-batches in the wrong order, no sample more than ``LATE`` behind what has come before."""
    rnd = random.Random(9)
    shaken = sorted(samples, key=lambda s: s[2] + rnd.random() * 0.95 * LATE)
    return [shaken[i:i + 90] for i in range(0, len(shaken), 90)]


#: A last sample far ahead: its watermark passes all others.
FLUSH = ("memory", "flush", START + dt.timedelta(days=30), 0.0, False)


@pytest.mark.parametrize("silent", [None, SILENT])
def test_batch_equals_walk(spark, silent):
    samples = made()
    now = START + dt.timedelta(days=4)
    df = spark.createDataFrame(samples, SCHEMA).repartition(5)
    got = rows_of(alerts.alert_transitions_batch(df, silent, now))
    assert got == walked(samples, silent, now)
    assert any(r[4] is None for r in got) == (silent is not None)


@pytest.mark.parametrize("silent", [None, SILENT])
def test_one_batch_at_a_time_equals_walk(spark, silent):
    samples = made()
    batches = [*arrivals(samples), [FLUSH]]
    assert any(a[2] > b[2] for x, y in zip(batches, batches[1:]) for a in x for b in y)  # out of order over batches
    # one sample beyond the lateness, after the third batch
    late = ("memory", "hot", min(s[2] for s in samples), 95.0, True)
    batches[3] = [late, *batches[3]]
    standing, got, behind = alerts.Standing(None), [], []
    for rows in batches:
        out, too_late, after = alerts.advance(spark.createDataFrame(rows, SCHEMA), standing, LATE, silent)
        got += rows_of(out)
        behind += [tuple(r) for r in too_late.collect()]
        # as a job does, the standing is stored between batches
        standing = alerts.Standing(after.watermark, *(spark.createDataFrame(d.select(*alerts.SAMPLES).collect(), SCHEMA) for d in (after.held, after.open)))
    assert behind == [late]
    end = FLUSH[2] - LATE
    assert sorted(got, key=repr) == walked(samples, silent, end)
    assert standing.held.count() == 1  # the flush sample itself
    assert silent is None or standing.open.count() == 0  # silent hosts leave no state


def write_files(batches) -> str:
    d = tempfile.mkdtemp(prefix="opslens-alerts-")
    schema = pa.schema([("check", pa.string()), ("host", pa.string()), ("ts", pa.timestamp("us")), ("value", pa.float64()), ("above", pa.bool_())])
    for i, rows in enumerate(batches):
        path = os.path.join(d, f"samples-{i}.parquet")
        pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema), path)
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)
    return d


@pytest.mark.parametrize("silent", [None, SILENT])
def test_keyed_state_equals_walk(spark, silent):
    samples = made(300)
    batches = [*arrivals(samples), [FLUSH]]
    late = ("memory", "hot", min(s[2] for s in samples), 95.0, True)
    batches[3] = [late, *batches[3]]
    d = write_files(batches)
    spark.conf.set(*alerts.STATE_STORE)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(d)
        name = f"alerts_{os.path.basename(d)}".replace("-", "_")
        q = (alerts.alert_transitions(stream, LATE, silent).writeStream.outputMode("append").format("memory").queryName(name)
             .option("checkpointLocation", streams.stream_checkpoint(spark, name)).trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert q.exception() is None, q.exception()
    finally:
        spark.conf.unset(alerts.STATE_STORE[0])
    assert rows_of(spark.table(name)) == walked(samples, silent, FLUSH[2] - LATE)


def test_check_samples_leaves_out_what_is_no_sample(spark):
    rows = [("h", START, 95.0), (None, START, 95.0), ("h", None, 95.0), ("h", START, None)]
    df = spark.createDataFrame(rows, "host string, ts timestamp_ntz, v double")
    assert [tuple(r) for r in alerts.check_samples(df, "memory", F.col("v"), 90).collect()] == [("memory", "h", START, 95.0, True)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(alerts.alert_transitions_batch(none, SILENT, START)) == []
    out, late, after = alerts.advance(none, alerts.Standing(None), LATE, SILENT)
    assert rows_of(out) == [] and late.count() == 0 and after == alerts.Standing(None, after.held, after.open)


def test_windows_of_a_batch_are_bucketed(spark):
    plan = pi.physical_plan(alerts.alert_transitions_batch(spark.createDataFrame(made(50), SCHEMA), SILENT))
    assert not pi.has_unpartitioned_window(plan) and "_bucket" in plan


def test_job_in_wrong_order_with_one_late_file(spark):
    """Files arrive out of order; one comes back beyond the lateness and goes to the late table alone."""
    t = pq.read_table(os.path.join(SF_SMALL, "events.parquet")).sort_by("ts")
    n = t.num_rows
    cuts = [t.slice(i * n // 6, (i + 1) * n // 6 - i * n // 6) for i in range(6)]
    span = max(cuts[i + 1]["ts"][-1].as_py() - cuts[i]["ts"][0].as_py() for i in range(5)) + dt.timedelta(microseconds=1)
    d, out = (tempfile.mkdtemp(prefix=f"opslens-late-{x}-") for x in ("in", "out"))
    for i, k in enumerate((1, 0, 3, 2, 5, 4)):  # neighbours swapped: at most two slices behind
        pq.write_table(cuts[k], os.path.join(d, f"events-{i}.parquet"))
        os.utime(os.path.join(d, f"events-{i}.parquet"), (1_700_000_000 + 10 * i,) * 2)
    pq.write_table(t.slice(0, 5), os.path.join(d, "events-6.parquet"))  # rows of the first slice once more, far too late
    os.utime(os.path.join(d, "events-6.parquet"), (1_700_000_100,) * 2)
    path = os.path.join(out, "findings")
    q = jobs.start_threshold_findings(spark, d, path, threshold=90.0, late=span, glob="events-*.parquet", available_now=True,
                                      max_files_per_trigger=1, name=f"late-{os.path.basename(d)}")
    q.awaitTermination(300)
    assert q.exception() is None, q.exception()
    from opslens.sources.fixtures import Snapshot
    mem = Snapshot(spark, SF_SMALL).mem_samples
    samples = alerts.check_samples(mem, jobs.MEMORY_CHECK, F.try_divide(F.col("mem_used") * F.lit(100.0), F.col("mem_total")), 90.0)
    watermark = t["ts"][-1].as_py() - span
    want = [r for r in rows_of(alerts.alert_transitions_batch(samples)) if r[2] <= watermark]
    got = sorted(((r["check"], r["entity"], r["as_of"], r["metric"], r["value"]) for r in spark.read.parquet(path).collect()), key=repr)
    assert got == want and got
    late = spark.read.parquet(f"{path}_late")
    assert late.count() == 5 and late.select("batch_id").distinct().count() == 1
    assert late.where("as_of > watermark").count() == 0
