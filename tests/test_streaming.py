"""Stream = batch for the three streaming reports, over several micro-batches."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from opslens.plans.compare import spark_rows
from opslens.sources.fixtures import Snapshot
from opslens.streaming import streams
from tests.conftest import SF_SMALL

THRESHOLD = 90.0


@pytest.fixture(scope="module")
def event_dir():
    """The events table split by time into 4 files, written oldest first, so a
    one-file-per-trigger stream sees 4 micro-batches in event-time order."""
    d = tempfile.mkdtemp(prefix="opslens-stream-src-")
    t = pq.read_table(os.path.join(SF_SMALL, "events.parquet")).sort_by("ts")
    n = t.num_rows
    for i in range(4):
        pq.write_table(t.slice(i * n // 4, (i + 1) * n // 4 - i * n // 4), os.path.join(d, f"events-{i}.parquet"))
        os.utime(os.path.join(d, f"events-{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    assert pc.sum(pc.is_valid(t["ts"])).as_py() == n
    return d


def _run(spark, df, mode, name):
    ckpt = streams.stream_checkpoint(spark, f"{name}-{os.getpid()}-{id(df)}")
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None, q.exception()
    return spark.table(name)


def _stream_snapshot(spark, event_dir):
    ev = streams.read_table_stream(spark, event_dir, "events", max_files_per_trigger=1,
                                   glob="events-*.parquet")
    return Snapshot(spark, SF_SMALL, overrides={"events": ev})


def _batch_snapshot(spark, event_dir):
    ev = spark.read.option("pathGlobFilter", "events-*.parquet").parquet(event_dir)
    return Snapshot(spark, SF_SMALL, overrides={"events": ev})


def _same(a, b):
    ra, rb = spark_rows(a), spark_rows(b)
    assert ra[0] == rb[0]
    assert sorted(ra[1], key=repr) == sorted(rb[1], key=repr)


def test_error_counts_stream_equals_batch(spark, event_dir):
    out = _run(spark, streams.error_counts(_stream_snapshot(spark, event_dir).alert_log), "complete", "t1")
    _same(out, streams.error_counts(_batch_snapshot(spark, event_dir).alert_log))
    assert out.count() > 0


def test_window_avg_stream_equals_batch(spark, event_dir):
    s = _stream_snapshot(spark, event_dir).disk_samples
    out = _run(spark, streams.metric_window_avg(s, "util"), "complete", "t2")
    _same(out, streams.metric_window_avg(_batch_snapshot(spark, event_dir).disk_samples, "util"))


def test_jobs_write_parquet_and_findings(spark, event_dir):
    from pyspark.sql import functions as F

    from opslens.streaming import jobs

    out = tempfile.mkdtemp(prefix="opslens-stream-out-")
    tag = f"{os.getpid()}-{id(out)}"
    q = jobs.start_error_counts(spark, event_dir, os.path.join(out, "errors"), glob="events-*.parquet",
                                available_now=True, name=f"errors-{tag}")
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(os.path.join(out, "errors"))
    batch = streams.error_counts(_batch_snapshot(spark, event_dir).alert_log)
    # append mode: only windows closed by the watermark are written, each exactly once
    assert got.count() > 0 and got.count() <= batch.count()
    assert got.join(batch, ["window_start", "window_end", "errors"], "left_anti").count() == 0
    assert got.groupBy("window_start").count().where("count > 1").count() == 0

    # without lateness every sample is passed by the watermark in the end
    q = jobs.start_threshold_findings_stateful(spark, event_dir, os.path.join(out, "findings"), threshold=THRESHOLD,
                                      late=dt.timedelta(0), glob="events-*.parquet", available_now=True,
                                      max_files_per_trigger=1, name=f"findings-{tag}")
    q.awaitTermination(300)
    assert q.exception() is None
    f = spark.read.parquet(os.path.join(out, "findings"))
    mem = _batch_snapshot(spark, event_dir).mem_samples.withColumn(
        "mem_pct", F.col("mem_used") * F.lit(100.0) / F.col("mem_total"))
    expected = streams.threshold_transitions_batch(mem, "mem_pct", THRESHOLD)
    assert f.select("batch_id").distinct().count() >= 2
    assert sorted((r["entity"], r["metric"]) for r in f.collect()) == \
        sorted((r["host"], r["event"]) for r in expected.collect())


def test_scaled_transitions_job_equals_batch(spark, event_dir):
    from pyspark.sql import functions as F

    from opslens.streaming import jobs

    out = tempfile.mkdtemp(prefix="opslens-stream-out2-")
    q = jobs.start_threshold_findings(spark, event_dir, os.path.join(out, "findings"),
                                             threshold=THRESHOLD, glob="events-*.parquet",
                                             late=dt.timedelta(0), available_now=True, max_files_per_trigger=1,
                                             name=f"scaled-{os.getpid()}-{id(out)}")
    q.awaitTermination(300)
    assert q.exception() is None
    f = spark.read.parquet(os.path.join(out, "findings"))
    mem = _batch_snapshot(spark, event_dir).mem_samples.withColumn(
        "mem_pct", F.col("mem_used") * F.lit(100.0) / F.col("mem_total"))
    expected = streams.threshold_transitions_batch(mem, "mem_pct", THRESHOLD)
    assert f.select("batch_id").distinct().count() >= 2
    assert sorted((r["entity"], r["metric"], r["as_of"]) for r in f.collect()) == \
        sorted((r["host"], r["event"], r["ts"]) for r in expected.collect())


def test_window_avg_job(spark, event_dir):
    from opslens.streaming import jobs

    out = os.path.join(tempfile.mkdtemp(prefix="opslens-stream-out3-"), "disk")
    q = jobs.start_disk_window_avg(spark, event_dir, out, glob="events-*.parquet", available_now=True,
                                   name=f"disk-{os.getpid()}-{id(out)}")
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(out)
    batch = streams.metric_window_avg(_batch_snapshot(spark, event_dir).disk_samples, "util")
    assert 0 < got.count() <= batch.count()
    # every window written is final: equal to the batch window
    assert got.join(batch, ["host", "window_start", "window_end", "samples", "avg_value"], "left_anti").count() == 0
