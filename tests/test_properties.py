"""Properties: alert is a subset of usage, monotone in the threshold,
keep_full is a superset of the literal form, the count report equals the
list report, the capacity parts agree."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.operators import activity, storage

AS_OF = "2024-01-31 00:00:00"
KEY = ("con_id", "tablespace_name")


def _keys(df):
    return {tuple(r[k] for k in KEY) for r in df.select(*KEY).collect()}


def test_alert_subset_of_usage(snap_small):
    s = snap_small
    usage = storage.capacity_usage(s.data_files, s.free_space, s.temp_files, s.containers)
    alerts = storage.capacity_alerts(usage, include_temp=True)
    assert _keys(alerts) <= _keys(usage)


@settings(max_examples=8, deadline=None)
@given(t1=st.floats(0, 100), t2=st.floats(0, 100))
def test_threshold_monotone(snap_small, t1, t2):
    s = snap_small
    usage = storage.capacity_usage(s.data_files, s.free_space, s.temp_files, s.containers).cache()
    lo, hi = sorted((t1, t2))
    assert _keys(storage.capacity_alerts(usage, hi)) <= _keys(storage.capacity_alerts(usage, lo))


def test_keep_full_superset(snap_small):
    s = snap_small
    lit = storage.capacity_usage(s.data_files, s.free_space, s.temp_files, s.containers)
    full = storage.capacity_usage(s.data_files, s.free_space, s.temp_files, s.containers, keep_full=True)
    assert _keys(lit) <= _keys(full)


def test_count_report_equals_list_report(snap_small):
    s = snap_small
    n = activity.online_user_count(s.app_sessions, s.app_users, AS_OF).first()["online_users"]
    assert n == activity.online_users(s.app_sessions, s.app_users, AS_OF).count()


def test_usage_and_size_agree(snap_small):
    s = snap_small
    usage = storage.capacity_usage(s.data_files, s.free_space, s.temp_files, s.containers,
                                   keep_full=True)
    per_con = {r["con_id"]: r["a"] for r in usage.where("free_space_gb is not null")
               .groupBy("con_id").agg({"allocated_space_gb": "sum"}).withColumnRenamed(
                   "sum(allocated_space_gb)", "a").collect()}
    size = storage.database_size(s.data_files, s.temp_files.limit(0), s.pdbs)
    for r in size.collect():
        assert abs(r["total_size_gb"] - per_con[r["con_id"]]) < 1e-6


@settings(max_examples=40, deadline=None)
@given(as_of_min=st.integers(0, 60 * 24 * 3), comp_min=st.integers(-60 * 24 * 40, 0))
def test_truncated_date_rewrite(as_of_min, comp_min):
    """trunc(x) > as_of - 30 days  <=>  x >= trunc(as_of - 30 days) + 1 day (the
    rewrite program_runs uses so the bound is pushed to the scan)."""
    import datetime as dt
    as_of = dt.datetime(2024, 1, 31) + dt.timedelta(minutes=as_of_min)
    x = as_of + dt.timedelta(minutes=comp_min, seconds=17)
    literal = dt.datetime.combine(x.date(), dt.time()) > as_of - dt.timedelta(days=30)
    lower = (as_of - dt.timedelta(days=30)).replace(hour=0, minute=0, second=0, microsecond=0) \
        + dt.timedelta(days=1)
    assert literal == (x >= lower)


def test_request_summary_counts_add_up(snap_small):
    from pyspark.sql import functions as F

    from opslens.functions.exprs import since
    from opslens.operators import requests
    s = snap_small
    total = s.requests.where(F.col("requested_start_date") > since(AS_OF, hours=12)).count()
    rows = requests.request_summary(s.requests, AS_OF).collect()
    assert sum(r["request_count"] for r in rows) == total
