"""The newest profile changes: the bound under the joins changes no row."""

from __future__ import annotations

import datetime as dt
import random

import pytest

import __spark_entry__ as E
from opslens.operators import requests
from opslens.plans import inspect as pi
from tests.conftest import SF_SMALL

START = dt.datetime(2024, 1, 1)


def made(spark, n: int, named: float, seed: int, ties: int = 40):
    """Values of which only the share ``named`` has an option with a name and a user; some have no time."""
    rnd = random.Random(seed)
    ok = [rnd.random() < named for _ in range(n)]
    values = [(i % 7 if ok[i] else 100 + i, rnd.choice([10001, 10004, 99]), f"v{i % 5}", rnd.choice([None] + [START + dt.timedelta(days=rnd.randrange(ties))] * 30),
               rnd.randrange(3) if rnd.random() < 0.9 else 77) for i in range(n)]
    df = spark.createDataFrame(values, "profile_option_id long, level_id long, profile_option_value string, last_update_date timestamp_ntz, last_updated_by long")
    options = spark.createDataFrame([(i, f"opt{i}") for i in range(7)], "profile_option_id long, profile_option_name string")
    tl = spark.createDataFrame([(f"opt{i}", f"Option {i} {lang}", lang) for i in range(6) for lang in ("US", "D")], "profile_option_name string, user_profile_option_name string, language string")
    users = spark.createDataFrame([(i, f"u{i}") for i in range(3)], "user_id long, user_name string")
    return options, df, tl, users


def plain(options, values, tl, users, n, language=None):
    """All values joined, then cut."""
    names = {(r["profile_option_name"], r["language"]): r["user_profile_option_name"] for r in tl.collect()}
    of = {r["profile_option_id"]: r["profile_option_name"] for r in options.collect()}
    who = {r["user_id"]: r["user_name"] for r in users.collect()}
    level = {r["level_id"]: r["l"] for r in values.select("level_id", requests.decode("level_id", requests.codes.PROFILE_LEVEL, requests.codes.PROFILE_LEVEL_DEFAULT).alias("l")).distinct().collect()}
    rows = [(title, level[v["level_id"]], v["profile_option_value"], v["last_update_date"], who[v["last_updated_by"]])
            for v in values.collect() if v["profile_option_id"] in of and v["last_updated_by"] in who
            for (name, lang), title in names.items() if name == of[v["profile_option_id"]] and language in (None, lang)]
    rows.sort(key=lambda r: (r[3] is not None, -(r[3] - START).total_seconds() if r[3] else 0, r[0], r[1], r[2], r[4]))
    return sorted(set(rows[:n]), key=repr)


@pytest.mark.parametrize("named,n", [(1.0, 2), (0.5, 7), (0.02, 5), (0.0, 3)])
@pytest.mark.parametrize("language", [None, "US"])
def test_equals_joining_everything(spark, named, n, language):
    tables = made(spark, 400, named, seed=int(named * 100))
    got = requests.latest_profile_changes(*tables, n=n, language=language).collect()
    assert sorted(map(tuple, got), key=repr) == plain(*tables, n, language)


def test_k_grows_step_by_step(spark, monkeypatch):
    monkeypatch.setattr(requests, "FAN_OUT_STEP", 2)
    tables = made(spark, 300, 0.05, seed=9, ties=300)
    assert sorted(map(tuple, requests.latest_profile_changes(*tables, n=3).collect()), key=repr) == plain(*tables, 3)


def test_more_than_there_are_and_none(spark):
    options, values, tl, users = made(spark, 5, 1.0, seed=1)
    assert sorted(map(tuple, requests.latest_profile_changes(options, values, tl, users, n=1000).collect()), key=repr) == plain(options, values, tl, users, 1000)
    assert requests.latest_profile_changes(options, values.limit(0), tl, users).count() == 0


def test_bound_reaches_the_scan(spark):
    plan = pi.physical_plan(E.queries()["r26_latest_profile_changes"](spark, SF_SMALL))
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(" in plan, plan
