"""Alerts raised once and cleared once, whatever order samples arrive in.

An alert belongs to a (check, host). It is RAISED by the first sample at or
above the check's threshold, CLEARED by the first one below it, and CLEARED
without a value (``silent`` after its last sample) when the host falls silent
while it is open. What counts is event time: a sample is held until the
watermark, the latest time seen less ``late``, has passed it, and held samples
are then taken in time order. So files may arrive in any order, as long as no
row is more than ``late`` behind; later ones belong to a stretch that has been
reported already and go to the late sink (``split_late``) instead.

Three forms of the same rules, equal on the same rows:

* ``alert_transitions``: Spark's keyed state. Held samples and the open flag
  lie in the state of their (check, host); an event-time timer wakes the key when
  the watermark passes its earliest held sample or its time-out. One key's rows
  within ``late`` are one task's.
* ``advance``: one micro-batch by DataFrame operations, the state in tables. A
  (check, host) with a large share of the rows is split by time bucket.
* ``alert_transitions_batch``: all rows at once.

Samples are (check, host, ts, value, above); see ``check_samples``. Rows without
a time, host or value are no samples.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opslens.functions.exprs import instant_to_ntz, ntz_to_instant, time_bucket
from opslens.plans.skew import previous_values

SAMPLES = ("check", "host", "ts", "value", "above")
TRANSITIONS = ("check", "host", "ts", "event", "value")
KEY = ["check", "host"]
LATE = dt.timedelta(minutes=10)
#: Keyed state with timers needs this state store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def check_samples(samples: DataFrame, check: str, value: Column, threshold: float) -> DataFrame:
    """Samples (host, ts, ...) of one check; several checks are put together by
    ``unionByName``."""
    v = value.cast("double")
    return (samples.select(F.lit(check).alias("check"), "host", "ts", v.alias("value"), (v >= F.lit(float(threshold))).alias("above"))
            .where(F.col("host").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull()))


def _microseconds(span: dt.timedelta | None) -> int | None:
    return None if span is None else span // dt.timedelta(microseconds=1)


# ------------------------------------------------------------ keyed state

class _Alert(StatefulProcessor):
    """The alert of one (check, host): ``held`` samples not yet passed by the
    watermark, and whether it is open since which last sample (microseconds)."""

    def __init__(self, silent_us: int | None):
        self.silent_us = silent_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, value double, above boolean")
        self.status = handle.getValueState("status", "open boolean, last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            us = pdf["us"].tolist()
            self.held.appendList(list(zip(us, pdf["value"].tolist(), pdf["above"].tolist(), strict=True)))
        yield self._take(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._take(key, timerValues)

    def _take(self, key, timers) -> pd.DataFrame:
        """Transitions of the held samples that the watermark has passed, and
        the timer of what comes next."""
        passed = timers.getCurrentWatermarkInMs() * 1000
        held = sorted(self.held.get()) if self.held.exists() else []
        ready = [s for s in held if s[0] <= passed]
        is_open, last = self.status.get() if self.status.exists() else (False, None)
        out = []

        def expire(before: int) -> bool:
            if is_open and self.silent_us is not None and before > last + self.silent_us:
                out.append((last + self.silent_us, "CLEARED", None))
                return False
            return is_open

        for us, value, above in ready:
            is_open = expire(us)
            if above != is_open:
                out.append((us, "RAISED" if above else "CLEARED", value))
            is_open, last = above, us
        held = held[len(ready):]
        is_open = expire(passed)
        if ready:
            self.held.put(held) if held else self.held.clear()
        if is_open:
            self.status.update((True, last))
        elif self.status.exists():
            self.status.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a timer fires once the watermark is beyond it; the first sample or time-out decides which
        ends = ([held[0][0]] if held else []) + ([last + self.silent_us] if is_open and self.silent_us is not None else [])
        if ends:
            self.handle.registerTimer(max(-(-min(ends) // 1000), timers.getCurrentWatermarkInMs() + 1))
        return pd.DataFrame([(*key, *row) for row in out], columns=["check", "host", "us", "event", "value"]).astype(
            {"check": object, "host": object, "us": "int64", "event": object, "value": "float64"})

    def close(self) -> None:
        pass


def alert_transitions(samples: DataFrame, late: dt.timedelta = LATE, silent: dt.timedelta | None = None) -> DataFrame:
    """Transitions (check, host, ts, event, value) of a stream of samples. The
    session must use the state store of ``STATE_STORE`` when the query starts."""
    zoned = ntz_to_instant("ts")
    rows = (samples.select("check", "host", F.unix_micros(zoned).alias("us"), "value", "above", zoned.alias("event_time"))
            .withWatermark("event_time", f"{_microseconds(late)} microseconds"))
    out = rows.groupBy(*KEY).transformWithStateInPandas(
        _Alert(_microseconds(silent)), outputStructType="check string, host string, us long, event string, value double",
        outputMode="append", timeMode="EventTime")
    return out.select("check", "host", instant_to_ntz(F.timestamp_micros("us")).alias("ts"), "event", "value")


# ------------------------------------------------------ DataFrame operations

def _micros(span: dt.timedelta) -> Column:
    return F.lit(_microseconds(span))


def _after(ts: Column, span: dt.timedelta) -> Column:
    return F.timestamp_add("MICROSECOND", _micros(span), ts)


def _changes(rows: DataFrame, silent: dt.timedelta | None, bucket: str) -> DataFrame:
    """Transitions at the samples of ``rows`` (samples with a flag ``known`` on
    those that only tell what came before)."""
    rows = previous_values(rows, KEY, ["ts", "value"], ["above", "ts"], time_bucket("ts", bucket))
    was_open = F.coalesce(F.col("prev_above"), F.lit(False))
    expired = was_open & (F.col("ts") > _after(F.col("prev_ts"), silent)) if silent is not None else F.lit(False)
    end = _after(F.col("prev_ts"), silent) if silent is not None else F.col("ts")
    events = F.array(
        F.when(expired, F.struct(end.alias("ts"), F.lit("CLEARED").alias("event"), F.lit(None).cast("double").alias("value"))),
        F.when(F.col("above") != (was_open & ~expired), F.struct(
            "ts", F.when(F.col("above"), "RAISED").otherwise("CLEARED").alias("event"), "value")))
    return rows.where(~F.col("known")).select(*KEY, F.explode(F.array_compact(events)).alias("e")).select(*KEY, "e.*")


def _newest(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("ts", "value", "above"), F.struct("ts", "value"))
    return rows.groupBy(*KEY).agg(newest.alias("n")).select(*KEY, "n.*")


def _timed_out(newest: DataFrame, silent: dt.timedelta | None, now: Column) -> DataFrame:
    """Time-outs of alerts whose newest sample left them open."""
    if silent is None:
        return newest.limit(0).select(*KEY, "ts", F.lit("CLEARED").alias("event"), "value")
    end = _after(F.col("ts"), silent)
    return newest.where(F.col("above") & (end < now)).select(*KEY, end.alias("ts"), F.lit("CLEARED").alias("event"), F.lit(None).cast("double").alias("value"))


def alert_transitions_batch(samples: DataFrame, silent: dt.timedelta | None = None, now: dt.datetime | None = None,
                            bucket: str = "hour") -> DataFrame:
    """Transitions (check, host, ts, event, value) of all samples, in any order.
    With ``now``, alerts open at the end are cleared if their host has been
    silent for longer by then."""
    out = _changes(samples.select(*SAMPLES, F.lit(False).alias("known")), silent, bucket)
    if silent is not None and now is not None:
        out = out.unionByName(_timed_out(_newest(samples), silent, F.lit(now).cast("timestamp_ntz")))
    return out


@dataclass(frozen=True)
class Standing:
    """What one micro-batch leaves to the next: the watermark (None before the
    first sample), samples beyond it, and the newest sample of every open alert."""
    watermark: dt.datetime | None
    held: DataFrame | None = None
    open: DataFrame | None = None


def split_late(samples: DataFrame, watermark: dt.datetime | None) -> tuple[DataFrame, DataFrame]:
    """Samples in time, and those at or before the watermark."""
    if watermark is None:
        return samples, samples.limit(0)
    late = F.col("ts") <= F.lit(watermark).cast("timestamp_ntz")
    return samples.where(~late), samples.where(late)


def advance(batch: DataFrame, before: Standing, late: dt.timedelta = LATE, silent: dt.timedelta | None = None,
            bucket: str = "hour") -> tuple[DataFrame, DataFrame, Standing]:
    """One micro-batch of samples: its transitions, its late samples, and the
    standing after it. One value, the latest time of the batch, goes through the
    driver. ``batch`` is read several times and should be persisted."""
    in_time, too_late = split_late(batch.select(*SAMPLES), before.watermark)
    latest = batch.agg(F.max("ts")).first()[0]
    watermark = before.watermark
    if latest is not None and (watermark is None or latest - late > watermark):
        watermark = latest - late
    rows = in_time if before.held is None else in_time.unionByName(before.held.select(*SAMPLES))
    passed = F.col("ts") <= F.lit(watermark).cast("timestamp_ntz") if watermark is not None else F.lit(False)
    ready = rows.where(passed).withColumn("known", F.lit(False))
    if before.open is not None:
        ready = ready.unionByName(before.open.select(*SAMPLES, F.lit(True).alias("known")))
    newest = _newest(ready)
    now = F.lit(watermark).cast("timestamp_ntz")
    out = _changes(ready, silent, bucket).unionByName(_timed_out(newest, silent, now))
    still = newest.where(F.col("above"))
    if silent is not None:
        still = still.where(_after(F.col("ts"), silent) >= now)
    return out, too_late, Standing(watermark, rows.where(~passed), still)
