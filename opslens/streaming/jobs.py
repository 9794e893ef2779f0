"""Runnable streaming jobs: source directory in, Parquet tables out.

Each job keeps its offsets and state under the cluster's shared checkpoint
folder (``stream_checkpoint``), so a restarted driver resumes where it
stopped and a lost executor's work is recomputed from the source files.

* ``start_error_counts``: hourly error counts, append mode; a window is
  written once the watermark has passed its end.
* ``start_disk_window_avg``: per-host sliding-window disk averages, append
  mode.
* ``start_threshold_findings``: alert transitions per check and host in the
  findings layout (day, check, then batch), with the state as a versioned table
  and DataFrame operations only, and a table of late samples. A batch replayed
  after a failure replaces its own partitions.
* ``start_threshold_findings_stateful``: the same transitions with Spark's keyed
  state and timers (``transformWithState``), for fleets of many small hosts.
* ``start_log_tail``: the last lines of every host of a log of rotated text files.
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opslens.session import delete_path
from opslens.sources import log_files
from opslens.sources.fixtures import Snapshot
from opslens.streaming import alerts, streams

MEMORY_CHECK = "memory_threshold"


def _trigger(writer, available_now: bool, interval: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def start_error_counts(spark: SparkSession, source_dir: str, out_path: str, *, glob: str = "events*.parquet",
                       window: str = "1 hour", late: str = "10 minutes", available_now: bool = False,
                       interval: str = "1 minute", name: str = "error_counts") -> StreamingQuery:
    """Hourly alert-log error counts from event files arriving in ``source_dir``."""
    ev = streams.read_table_stream(spark, source_dir, "events", glob=glob)
    counts = streams.error_counts(Snapshot(spark, source_dir, overrides={"events": ev}).alert_log,
                                  window=window, late=late)
    w = (counts.writeStream.outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", streams.stream_checkpoint(spark, name)).queryName(name))
    return _trigger(w, available_now, interval).start()


def start_disk_window_avg(spark: SparkSession, source_dir: str, out_path: str, *, value: str = "util",
                          glob: str = "events*.parquet", window: str = "1 hour", slide: str = "15 minutes",
                          late: str = "10 minutes", available_now: bool = False, interval: str = "1 minute",
                          name: str = "disk_window_avg") -> StreamingQuery:
    """Per-host sliding-window averages of a disk metric, append mode: a
    window is written once the watermark has passed its end."""
    ev = streams.read_table_stream(spark, source_dir, "events", glob=glob)
    disk = Snapshot(spark, source_dir, overrides={"events": ev}).disk_samples
    avg = streams.metric_window_avg(disk, value, window=window, slide=slide, late=late)
    w = (avg.writeStream.outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", streams.stream_checkpoint(spark, name)).queryName(name))
    return _trigger(w, available_now, interval).start()


def _finding_rows(tr: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    threshold = F.create_map(*[F.lit(v) for check, t in thresholds.items() for v in (check, float(t))])
    return tr.select(
        "check", F.when(F.col("event") == "RAISED", "WARNING").otherwise("INFO").alias("severity"),
        F.col("host").alias("entity"), F.col("event").alias("metric"), F.col("value").cast("double").alias("value"),
        F.element_at(threshold, F.col("check")).alias("threshold"), F.col("ts").alias("as_of"))


def _write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Rows of a batch under (day, check, batch); a replayed batch replaces its own."""
    (rows.withColumn("as_of_date", F.to_date("as_of")).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("as_of_date", "check", "batch_id").parquet(path))


def _read_standing(spark: SparkSession, path: str, batch_id: int) -> alerts.Standing:
    if batch_id == 0:
        return alerts.Standing(None)
    at = f"{path}/v={batch_id - 1}"
    try:
        watermark = spark.read.parquet(f"{at}/watermark").first()["watermark"]
        return alerts.Standing(watermark, spark.read.parquet(f"{at}/held"), spark.read.parquet(f"{at}/open"))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise RuntimeError(f"the state of batch {batch_id - 1} is lost ({path}); open alerts "
                               "would be raised again: start the stream with a new checkpoint") from exc
        raise


def _write_standing(spark: SparkSession, path: str, batch_id: int, now: alerts.Standing) -> None:
    at = f"{path}/v={batch_id}"
    now.held.write.mode("overwrite").parquet(f"{at}/held")
    now.open.write.mode("overwrite").parquet(f"{at}/open")
    spark.createDataFrame([(now.watermark,)], "watermark timestamp_ntz").write.mode("overwrite").parquet(f"{at}/watermark")
    if batch_id > 1:  # a replay of this batch reads the version before it, none older
        delete_path(spark, f"{path}/v={batch_id - 2}")


def _alert_writer(spark: SparkSession, out_path: str, late_path: str, state_path: str, thresholds: dict[str, float],
                  late: dt.timedelta, silent: dt.timedelta | None):
    """foreachBatch body: state version N-1 in; transitions, late samples and
    state version N out. Batch N always reads version N-1, so a replayed batch
    recomputes the same output and overwrites its own partitions and version."""
    def write(batch: DataFrame, batch_id: int) -> None:
        before = _read_standing(spark, state_path, batch_id)
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            out, too_late, now = alerts.advance(rows, before, late, silent)
            _write_batch(_finding_rows(out, thresholds), batch_id, out_path)
            behind = F.lit(before.watermark).cast("timestamp_ntz")
            _write_batch(too_late.select("check", "host", F.col("ts").alias("as_of"), "value", behind.alias("watermark")), batch_id, late_path)
            _write_standing(spark, state_path, batch_id, now)
        finally:
            rows.unpersist()
    return write


def _memory_samples(spark: SparkSession, source_dir: str, glob: str, threshold: float, max_files: int | None) -> DataFrame:
    ev = streams.read_table_stream(spark, source_dir, "events", glob=glob, max_files_per_trigger=max_files)
    mem = Snapshot(spark, source_dir, overrides={"events": ev}).mem_samples
    return alerts.check_samples(mem, MEMORY_CHECK, F.try_divide(F.col("mem_used") * F.lit(100.0), F.col("mem_total")), threshold)


def start_threshold_findings(spark: SparkSession, source_dir: str, out_path: str, *, threshold: float = 90.0,
                             late: dt.timedelta = alerts.LATE, silent: dt.timedelta | None = None,
                             late_path: str | None = None, glob: str = "events*.parquet", available_now: bool = False,
                             interval: str = "1 minute", max_files_per_trigger: int | None = None,
                             name: str = "memory_threshold") -> StreamingQuery:
    """Memory alerts, written as findings rows. Files may arrive in any order
    within ``late``; samples further behind go to ``late_path`` (default: beside
    ``out_path``, with the ending ``_late``), by batch, and nowhere else. The
    state is a small versioned table under the stream's checkpoint folder and
    every step a DataFrame operation, so no host is processed in one task. A lost
    state version fails the stream instead of raising every open alert again."""
    samples = _memory_samples(spark, source_dir, glob, threshold, max_files_per_trigger)
    ckpt = streams.stream_checkpoint(spark, name)
    write = _alert_writer(spark, out_path, late_path or f"{out_path}_late", f"{ckpt}/standing", {MEMORY_CHECK: threshold}, late, silent)
    w = samples.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", ckpt).queryName(name)
    return _trigger(w, available_now, interval).start()


def start_threshold_findings_stateful(spark: SparkSession, source_dir: str, out_path: str, *, threshold: float = 90.0,
                                      late: dt.timedelta = alerts.LATE, silent: dt.timedelta | None = None,
                                      glob: str = "events*.parquet", available_now: bool = False,
                                      interval: str = "1 minute", max_files_per_trigger: int | None = 8,
                                      name: str = "memory_threshold_stateful") -> StreamingQuery:
    """Same output as ``start_threshold_findings`` with Spark's keyed state and
    event-time timers: the samples of one (check, host) in a micro-batch, and
    those held, are one task's, so the files of a micro-batch are limited. Samples
    behind the watermark are dropped. Sets the session's state store, if it is
    still the default one, to the one that keyed state with timers needs."""
    samples = _memory_samples(spark, source_dir, glob, threshold, max_files_per_trigger)
    if "RocksDB" not in spark.conf.get(alerts.STATE_STORE[0]):
        spark.conf.set(*alerts.STATE_STORE)
    tr = alerts.alert_transitions(samples, late, silent)

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(_finding_rows(batch, {MEMORY_CHECK: threshold}), batch_id, out_path)

    w = (tr.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", streams.stream_checkpoint(spark, name)).queryName(name))
    return _trigger(w, available_now, interval).start()


def start_log_tail(spark: SparkSession, log_dir: str, out_path: str, *, lines: int = 30, available_now: bool = False,
                   interval: str = "1 minute", max_files_per_trigger: int | None = None,
                   name: str = "log_tail") -> StreamingQuery:
    """The last lines of every host of a log that grows by rotated files
    (``sources.log_files``), as one version of a table per micro-batch under
    ``out_path/v=<batch>``: version N is made of version N-1 and the new lines,
    of which at most ``lines`` a host leave their partition. Files may arrive in
    any order, since places go by stamp and name. A replayed batch rewrites its
    version; versions older than the one before are deleted."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = log_files.placed(batch).select("host", "line", *log_files.PLACE)
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{out_path}/v={batch_id - 1}"))
        tail = log_files.log_tail(rows, lines, keep=("file", "block", "at"))
        tail.drop("rank").write.mode("overwrite").parquet(f"{out_path}/v={batch_id}")
        if batch_id > 1:
            delete_path(spark, f"{out_path}/v={batch_id - 2}")

    log = log_files.raw_lines(spark, log_dir, stream=True, max_files_per_trigger=max_files_per_trigger)
    w = (log.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", streams.stream_checkpoint(spark, name)).queryName(name))
    return _trigger(w, available_now, interval).start()
