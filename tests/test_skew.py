"""The bucketed per-key windows equal the plain per-key windows, whatever the
bucket width, with one key holding most rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opslens.plans.skew import previous_values, rolling_mean, top_n_per_key


@pytest.fixture(scope="module")
def samples(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        host = "hot" if rnd.random() < 0.6 else f"h{rnd.randrange(5)}"
        # irregular gaps, some hours empty, bursts inside one hour
        ts = base + dt.timedelta(seconds=rnd.randrange(0, 5 * 24 * 3600))
        rows.append((host, ts, i, rnd.random() * 100))
    return spark.createDataFrame(rows, "host string, ts timestamp_ntz, seq bigint, v double")


def _collect(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "week"])
def test_previous_values_equals_lag(samples, unit):
    w = Window.partitionBy("host").orderBy("ts", "seq")
    plain = samples.select("host", "ts", "seq", F.lag("v").over(w).alias("prev_v"),
                           F.lag("seq").over(w).alias("prev_seq"))
    ours = previous_values(samples, ["host"], ["ts", "seq"], ["v", "seq"], F.date_trunc(unit, "ts"))
    cols = ["host", "ts", "seq", "prev_v", "prev_seq"]
    assert _collect(ours.select(*cols), cols) == _collect(plain, cols)


@pytest.mark.parametrize("unit,n", [("minute", 5), ("hour", 5), ("hour", 1), ("day", 12)])
def test_rolling_mean_equals_window_avg(samples, unit, n):
    w = Window.partitionBy("host").orderBy("ts", "seq").rowsBetween(-(n - 1), 0)
    plain = samples.select("host", "seq", F.round(F.avg("v").over(w), 9).alias("m"))
    ours = rolling_mean(samples, ["host"], ["ts", "seq"], {"m": F.col("v")}, n, F.date_trunc(unit, "ts"))
    ours = ours.select("host", "seq", F.round("m", 9).alias("m"))
    assert _collect(ours, ["host", "seq", "m"]) == _collect(plain, ["host", "seq", "m"])


def test_rolling_mean_keeps_all_rows(samples):
    out = rolling_mean(samples, ["host"], ["ts", "seq"], {"m": F.col("v")}, 5, F.date_trunc("hour", "ts"))
    assert out.count() == samples.count()
    assert set(out.columns) == set(samples.columns) | {"m"}


def test_top_n_per_key(samples):
    out = top_n_per_key(samples, ["host"], [F.col("v").desc(), F.col("seq")], 3)
    assert out.groupBy("host").count().where("count != 3").count() == 0
    from opslens.plans.inspect import physical_plan
    assert "WindowGroupLimit" in physical_plan(out)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 500), st.floats(0, 100)),
                 min_size=1, max_size=40)


@settings(max_examples=12, deadline=None)
@given(rows=_rows, width=st.sampled_from([1, 7, 60, 1000]), n=st.integers(1, 6))
def test_random_frames_match_plain_windows(spark, rows, width, n):
    base = dt.datetime(2024, 1, 1)
    data = [(h, base + dt.timedelta(minutes=m), i, v) for i, (h, m, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "host string, ts timestamp_ntz, seq bigint, v double")
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(width * 60_000_000))
    w = Window.partitionBy("host").orderBy("ts", "seq")
    plain = df.select("seq", F.lag("v").over(w).alias("p"),
                      F.round(F.avg("v").over(w.rowsBetween(-(n - 1), 0)), 9).alias("m"))
    lag = previous_values(df, ["host"], ["ts", "seq"], ["v"], bucket).select("seq", F.col("prev_v").alias("p"))
    roll = rolling_mean(df, ["host"], ["ts", "seq"], {"m": F.col("v")}, n, bucket) \
        .select("seq", F.round("m", 9).alias("m"))
    ours = lag.join(roll, "seq")
    assert _collect(ours, ["seq", "p", "m"]) == _collect(plain, ["seq", "p", "m"])


def test_plain_window_option_matches(spark):
    from opslens.operators import hosts
    from opslens.sources.fixtures import Snapshot
    from tests.conftest import SF_SMALL
    s = Snapshot(spark, SF_SMALL)
    for op in (hosts.cpu_usage, hosts.memory_usage, hosts.swap_usage):
        a = op(s.cpu_samples if op is hosts.cpu_usage else s.mem_samples)
        b = op(s.cpu_samples if op is hosts.cpu_usage else s.mem_samples, bucket=None)
        cols = sorted(a.columns)
        assert _collect(a, cols) == _collect(b, cols)


def test_null_times_and_ties_equal_the_plain_window(spark):
    from opslens.functions.exprs import time_bucket
    from opslens.plans.skew import previous_values, rolling_mean
    rows = [("h", None, 1), ("h", None, 2), ("h", "2024-01-01 00:10:00", 3), ("h", "2024-01-01 00:10:00", 4),
            ("h", "2024-01-01 05:00:00", 5), ("g", "2024-01-01 05:00:00", 6), ("g", None, 7)]
    df = spark.createDataFrame(rows, "host string, ts string, v long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    key = lambda r: repr(tuple(r))
    for run in (lambda b: previous_values(df, ["host"], ["ts", "v"], ["v"], b),
                lambda b: rolling_mean(df, ["host"], ["ts", "v"], {"m": F.col("v")}, 3, b)):
        assert sorted(run(time_bucket("ts", "hour")).collect(), key=key) == sorted(run(None).collect(), key=key)
