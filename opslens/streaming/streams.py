"""Streaming variants of three reports.

They take the same logical tables as the batch reports (build them with
``Snapshot(..., overrides={"events": spark.readStream...})`` so the column
expressions are shared) and run in Structured Streaming:

* ``error_counts``  - alert-log errors per tumbling window, with a watermark
  for late lines;
* ``metric_window_avg`` - per-host averages over sliding windows;
* ``threshold_transitions_batch`` - per-host alert raised once when a metric
  crosses a threshold and cleared once when it falls back; its streams are in
  ``streaming.alerts``.

Each has a batch form (the same function over a batch frame) that the tests
compare with the stream.
``withWatermark`` needs a zoned TIMESTAMP; the NTZ event time is converted to
it as if it were UTC (``ntz_to_instant``, independent of the session zone) and
the window bounds are converted back to NTZ on output, so window boundaries
fall on the same wall-clock times in every session zone.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.functions.exprs import instant_to_ntz, ntz_to_instant, time_bucket
from opslens.plans.skew import previous_values
from opslens.session import ensure_checkpoint_dir


def read_table_stream(spark: SparkSession, sf_dir: str, name: str,
                      max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A raw table's Parquet files in ``sf_dir`` as a stream: ``<name>.parquet``,
    or every file matching ``glob`` as it arrives. The schema is taken from
    the first matching file, since streams need a declared schema."""
    pattern = glob or f"{name}.parquet"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(sf_dir).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(sf_dir)


def _zoned(c: str):
    return ntz_to_instant(c)


def error_counts(alert_log: DataFrame, window: str = "1 hour", late: str = "10 minutes",
                 pattern: str = codes.ERROR_PATTERN) -> DataFrame:
    """Alert-log lines matching ``pattern`` per tumbling ``window``.
    Columns: window_start, window_end, errors."""
    df = (alert_log.where(F.col("message_text").like(pattern))
          .select(_zoned("originating_timestamp").alias("event_time"))
          .withWatermark("event_time", late))
    return (df.groupBy(F.window("event_time", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("errors"))
            .select(instant_to_ntz("w.start").alias("window_start"),
                    instant_to_ntz("w.end").alias("window_end"), "errors"))


def metric_window_avg(samples: DataFrame, value_col: str, window: str = "1 hour",
                      slide: str = "15 minutes", late: str = "10 minutes",
                      ts_col: str = "ts") -> DataFrame:
    """Per-host average of ``value_col`` over sliding windows.
    Columns: host, window_start, window_end, samples, avg_value."""
    df = (samples.select("host", _zoned(ts_col).alias("event_time"), F.col(value_col).alias("v"))
          .withWatermark("event_time", late))
    return (df.groupBy("host", F.window("event_time", window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("v"), 2).alias("avg_value"))
            .select("host", instant_to_ntz("w.start").alias("window_start"),
                    instant_to_ntz("w.end").alias("window_end"), "samples", "avg_value"))


# --------------------------------------------------- threshold transitions

def _metric(samples: DataFrame, value: str) -> DataFrame:
    return samples.select("host", "ts", F.col(value).cast("double").alias("value"))


def threshold_transitions_batch(samples: DataFrame, value: str, threshold: float,
                                bucket: str = "hour") -> DataFrame:
    """Batch form: a RAISED row where a host's value reaches ``threshold``
    (>=) after being below it (or on its first sample), a CLEARED row where it
    falls back below. Columns: host, ts, event, value."""
    df = _metric(samples, value).withColumn("above", F.col("value") >= F.lit(threshold))
    df = previous_values(df, ["host"], ["ts"], ["above"], time_bucket("ts", bucket))
    before = F.coalesce(F.col("prev_above"), F.lit(False))
    return (df.where(F.col("above") != before)
            .select("host", "ts", F.when(F.col("above"), "RAISED").otherwise("CLEARED").alias("event"),
                    "value"))


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Checkpoint location of a named stream under the shared checkpoint
    folder (the cluster's ``spark.checkpoint.dir``), so a restarted driver
    resumes from its offsets and state."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)
