"""Captured text as it lies in a collector's folders: rotated files of lines.

A log is a folder of ``stamp=<period>/`` sub-folders, one per rotation, in which
files follow each other by name; a line starts with its host. Rotation by stamp
never renames a file, so a stream reads each line once. ``write_log`` lays lines
down like that (a large period in several files), ``read_log`` reads them back,
in batch or as a stream.

Lines of a file keep an order without one task reading the whole file: a line's
place is (stamp, file, block, at), where ``block`` is the start of the split it
was read in and ``at`` grows within a split. ``number_lines`` makes dense line
numbers of it, from the sizes of the splits before; only one row per split is
summed up and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.plans.joins import broadcast_if_small
from opslens.plans.skew import top_n_per_key

PLACE = ("stamp", "file", "block", "at")
_SCHEMA = "value string, stamp string"


def write_log(lines: DataFrame, path: str, stamp: Column, order: Sequence[Column]) -> None:
    """``lines`` (host, line) as a log under ``path``: text files under
    ``stamp=...`` that hold the lines of a period in ``order`` (a total order
    within a period), file after file by name. Range partitions make the files,
    so a period with most of the lines is written by many tasks. Hosts hold no
    blank and lines no line break."""
    full = [F.col("stamp"), *[F.col(f"_o{i}") for i in range(len(order))]]
    rows = lines.select(stamp.alias("stamp"), F.concat_ws(" ", "host", "line").alias("value"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    (rows.repartitionByRange(*full).sortWithinPartitions(*full).select("stamp", "value")
     .write.mode("overwrite").partitionBy("stamp").text(path))


def raw_lines(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, stream: bool = False,
              max_files_per_trigger: int | None = None) -> DataFrame:
    """The lines under ``path`` as they are: stamp, file, block, value. With
    ``since`` and ``until`` (stamps, both included) only those folders are read.
    A stream reads a file whole in one micro-batch."""
    reader = (spark.readStream if stream else spark.read).schema(_SCHEMA).option("lineSep", "\n")
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(path)
    for bound, inside in ((since, F.col("stamp") >= F.lit(since)), (until, F.col("stamp") <= F.lit(until))):
        lines = lines if bound is None else lines.where(inside)
    return lines.select("stamp", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def placed(raw: DataFrame) -> DataFrame:
    """``raw_lines`` with their place in the split: stamp, file, block, at, host,
    line. Of a stream it takes the micro-batches (``foreachBatch``). Filters on
    the result do not reach the scan, since places come first. A line without a
    blank is all host."""
    host = F.substring_index("value", " ", 1)
    at = F.monotonically_increasing_id().alias("at")
    return raw.select("stamp", "file", "block", at, "value").select(
        *PLACE, host.alias("host"), F.col("value").substr(F.char_length(host) + 2, F.char_length("value")).alias("line"))


def read_log(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The lines of a log and their places: stamp, file, block, at, host, line."""
    return placed(raw_lines(spark, path, since, until))


def number_lines(log: DataFrame, by: Sequence[str] = ("stamp",)) -> DataFrame:
    """``log`` with ``line_no``, dense from 1 within ``by``: the lines of the
    splits before (files by name, then blocks) and the place in the split."""
    split = ["stamp", "file", "block"]
    sizes = log.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    inner = [c for c in split if c not in by]
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(*inner)) - F.col("n")
    starts = broadcast_if_small(sizes.select(*split, (before - F.col("first") + 1).alias("_start")))
    return log.join(starts, split).withColumn("line_no", F.col("at") + F.col("_start")).drop("_start")


def log_tail(log: DataFrame, n: int, keep: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` lines of every host over all rotations, newest first by
    ``rank``. Columns: host, rank, stamp, line and those named in ``keep``."""
    last = top_n_per_key(log, ["host"], [F.col(c).desc() for c in PLACE], n)
    return last.select("host", "rank", "stamp", "line", *keep)
