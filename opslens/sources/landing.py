"""Landed snapshot layout: one Parquet table per logical table, partitioned by
``snapshot_date`` (and ``con_id`` for per-container catalog views).

A report for one ``as_of`` then reads one date partition, and a per-container
report (the source's container switch) reads one container partition; both
prune at the scan (``PartitionFilters``) instead of filtering rows. Writes use
dynamic partition overwrite, so re-landing a day replaces only that day and a
failed landing job can simply be re-run.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import DateType, StructField, StructType

from opslens.functions.exprs import parse_as_of
from opslens.sources.schemas import NAMES, conform, schema


def _day(d) -> str:
    if isinstance(d, _dt.date) and not isinstance(d, _dt.datetime):
        return d.isoformat()
    return parse_as_of(d).date().isoformat()


def land(df: DataFrame, path: str, snapshot_date, by_container: bool | None = None) -> None:
    """Write one logical table's snapshot for ``snapshot_date``."""
    if by_container is None:
        by_container = "con_id" in df.columns
    # the day's own folder is overwritten, so a container that is gone leaves nothing behind
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy("con_id") if by_container else writer).parquet(
        f"{path.rstrip('/')}/snapshot_date={_day(snapshot_date)}")


def read_landed(spark: SparkSession, path: str, as_of=None,
                con_ids: Sequence[int] | None = None) -> DataFrame:
    """A landed table, restricted to the snapshot of ``as_of``'s day and to
    ``con_ids``; both restrictions are partition filters."""
    df = spark.read.parquet(path)
    if as_of is not None:
        df = df.where(F.col("snapshot_date") == F.to_date(F.lit(_day(as_of))))
    if con_ids is not None:
        df = df.where(F.col("con_id").isin(list(con_ids)))
    return df


class LandedSnapshot:
    """The logical tables of one day, read from landed tables under ``root``
    (a folder per table, see ``land``): what the reports and the command line
    run on. Every attribute named in ``schemas.NAMES`` is a DataFrame with the
    declared columns, restricted to the day (and to ``con_ids`` where the table
    has containers) by partition filters. Nothing is kept between accesses, so
    files that arrive later are seen."""

    def __init__(self, spark: SparkSession, root: str, as_of, con_ids: Sequence[int] | None = None):
        self.spark, self.root, self.as_of, self.con_ids = spark, root.rstrip("/"), as_of, con_ids

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in NAMES:
            raise AttributeError(name)
        declared = schema(name)
        # the schema is given: a table landed empty has no file to infer it from
        landed = self.spark.read.schema(StructType([*declared.fields, StructField("snapshot_date", DateType())])).parquet(f"{self.root}/{name}")
        day = landed.where(F.col("snapshot_date") == F.to_date(F.lit(_day(self.as_of))))
        if self.con_ids is not None and "con_id" in declared.names:
            day = day.where(F.col("con_id").isin(list(self.con_ids)))
        return conform(day, name)


def land_all(snapshot, root: str, snapshot_date, names: Sequence[str] = NAMES) -> None:
    """Land the tables of ``snapshot`` (any object with them as attributes)."""
    for name in names:
        land(conform(getattr(snapshot, name), name), f"{root.rstrip('/')}/{name}", snapshot_date)
