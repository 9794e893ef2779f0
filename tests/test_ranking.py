"""Places in a global order equal row_number() over it, by range partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from opslens.plans import inspect as pi
from opslens.plans import ranking
from tests.conftest import SF_SMALL


def order():
    return [F.col("a").desc_nulls_first(), F.col("b").asc_nulls_last()]


@pytest.fixture(scope="module")
def rows(spark):
    """Nulls, ties, one value that most rows share, and equal rows."""
    rnd = random.Random(3)
    data = [(rnd.choice([None, 1, 2, 7, 7, 7, 7, 7]), rnd.choice([None, "x", "y", "é"]), rnd.randrange(4)) for _ in range(4000)]
    return spark.createDataFrame(data, "a int, b string, c int").repartition(7)


@pytest.mark.parametrize("block", [2, 256])
def test_rank_equals_row_number(spark, rows, block, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", block)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        # small partitions are not merged, so that several blocks of partitions are summed up
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = ranking.global_rank(rows, order())
        assert got.columns == ["rank", "a", "b", "c"]
        full = Window.orderBy(*order(), *[F.col(c).asc_nulls_last() for c in rows.columns])
        want = rows.select(F.row_number().over(full).cast("long").alias("rank"), "*")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_rows_are_dealt_to_many_partitions(spark):
    same = spark.range(20_000).select(F.lit(1).alias("a"), F.lit("x").alias("b"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = ranking.global_rank(same, order())
        parts = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 4 and max(r["count"] for r in parts) < 8000
        assert got.agg(F.sum("rank"), F.count_distinct("rank")).first()[:] == (20_000 * 20_001 // 2, 20_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_empty_and_one_row(spark):
    none = spark.createDataFrame([], "a int, b string")
    assert ranking.global_rank(none, order()).count() == 0
    assert [tuple(r) for r in ranking.global_rank(spark.createDataFrame([(None, None)], "a int, b string"), order()).collect()] == [(1, None, None)]


@pytest.mark.parametrize("name,plain", [("o1_block_corruption_ranked", "r09_block_corruption"), ("o2_backup_summary_ranked", "r11_backup_summary"),
                                        ("o3_queue_status_ranked", "r21_queue_status_all"), ("o4_datafile_details_ranked", "r04_datafile_details")])
def test_listings_in_rank_order(spark, name, plain):
    qs = E.queries()
    ranked = qs[name](spark, SF_SMALL)
    assert not pi.has_unpartitioned_window(pi.physical_plan(ranked))
    listed = [tuple(r) for r in qs[plain](spark, SF_SMALL).collect()]  # ordered as the report orders it
    got = [tuple(r)[1:] for r in ranked.orderBy("rank").collect()]
    keys = {"o1_block_corruption_ranked": (0, 1), "o2_backup_summary_ranked": (1, 0), "o3_queue_status_ranked": (3, 0, 1), "o4_datafile_details_ranked": (0,)}[name]
    assert [[r[k] for k in keys] for r in got] == [[r[k] for k in keys] for r in listed]
    assert sorted(got, key=repr) == sorted(listed, key=repr)
