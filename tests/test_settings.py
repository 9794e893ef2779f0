"""The setting that holds: first level with a value, nothing dropped or repeated."""

from __future__ import annotations

import random

import __spark_entry__ as E
from opslens.operators import settings
from opslens.plans import inspect as pi
from tests.conftest import SF_SMALL

SCHEMA = "setting string, level_id int, level_value long, value double"


def test_equals_nested_lookup(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 1, 2, 3, 3, 3, 3, 9]), rnd.choice([None, 10, 11, 12])) for i in range(500)]
    held = [("T", 10004, 1, 5.0), ("T", 10004, 2, None), ("T", 10004, None, 99.0), ("T", 10003, 10, 7.0), ("T", 10003, 10, 8.0), ("T", 10003, 11, None),
            ("OTHER", 10004, 3, 1.0), ("T", 10001, 0, 30.0), ("T", 10005, 1, 1000.0)]
    df = spark.createDataFrame(rows, "id long, user_id long, responsibility_id long")
    for given in (held, held[:-2], []):
        got = settings.with_setting(df, spark.createDataFrame(given, SCHEMA), "T", "t")
        assert got.columns == ["id", "user_id", "responsibility_id", "t", "t_level"]

        def of(level, place=None, any_place=False):
            values = [v for s, lv, p, v in given if s == "T" and lv == level and v is not None and (any_place or (place is not None and p == place))]
            return max(values, default=None)

        want = []
        for i, u, r in rows:
            found = [(of(10004, u), 10004), (of(10003, r), 10003), (of(10001, any_place=True), 10001)]
            value, level = next(((v, lv) for v, lv in found if v is not None), (None, None))
            want.append((i, u, r, value, level))
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_all_three_levels_decide(spark):
    df = E.queries()["f16_session_timeouts"](spark, SF_SMALL)
    assert {r[0] for r in df.select("timeout_minutes_level").distinct().collect()} == {10004, 10003, 10001}
    plan = pi.physical_plan(df)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert E.queries()["r13_online_users_by_profile"](spark, SF_SMALL).count() > 0
