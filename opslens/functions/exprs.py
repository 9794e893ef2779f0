"""Column builders for the idioms the reports rely on.

Everything returns a ``Column`` made of built-in functions, so it stays inside
whole-stage codegen and folds to literals where the inputs are literals.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1073741824  # bytes per GiB; the reports divide by 1024 three times
MICROS_PER_MINUTE = 60_000_000


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Code -> label as a CASE chain. A NULL code matches no key and takes the
    default (NULL when there is none), like DECODE without a NULL key."""
    c = col_(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def decode_or_self(c: str | Column, mapping: Mapping) -> Column:
    """Relabel the listed codes, pass every other code through unchanged."""
    c = col_(c)
    return F.coalesce(decode(c, mapping), c)


def text_concat(*parts: str | Column) -> Column:
    """Concatenation in which a NULL part counts as empty text (Spark's
    ``concat`` would return NULL)."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def gib(c: str | Column) -> Column:
    """Bytes -> GiB as DOUBLE; exact scaling by a power of two."""
    return col_(c) / F.lit(GIB)


def pct_used(alloc: str | Column, free: str | Column) -> Column:
    """(alloc - free) / alloc * 100; NULL on zero allocation instead of an error."""
    a, f = col_(alloc), col_(free)
    return F.try_divide(a - f, a) * F.lit(100)


# ----------------------------------------------------------------- time

def ts_text(ts: str | _dt.datetime) -> str:
    if isinstance(ts, _dt.datetime):
        return ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    return str(ts)


def as_of_lit(ts: str | _dt.datetime) -> Column:
    """Report time as a TIMESTAMP_NTZ literal. A Python datetime passed to
    ``F.lit`` would become a zoned timestamp and tie results to the session
    zone; the NTZ literal does not, and folds into pushed-down filters."""
    return F.expr(f"TIMESTAMP_NTZ '{ts_text(ts)}'")


def parse_as_of(ts: str | _dt.datetime) -> _dt.datetime:
    if isinstance(ts, _dt.datetime):
        return ts
    return _dt.datetime.fromisoformat(str(ts))


def since(as_of, *, days: float = 0, hours: float = 0, minutes: float = 0) -> Column:
    """Literal lower bound ``as_of - interval`` (computed on the driver so the
    comparison against a raw column is pushed to the scan)."""
    bound = parse_as_of(as_of) - _dt.timedelta(days=days, hours=hours, minutes=minutes)
    return as_of_lit(bound)


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Elapsed minutes as DOUBLE from the exact microsecond difference."""
    return F.timestamp_diff("MICROSECOND", col_(start), col_(end)) / F.lit(float(MICROS_PER_MINUTE))


def report_datetime(c: str | Column) -> Column:
    """'DD-MON-YYYY HH24:MI:SS' text, month in capitals (e.g. 02-JAN-2025 03:04:05)."""
    return F.upper(F.date_format(col_(c), "dd-MMM-yyyy HH:mm:ss"))


def report_datetime_short(c: str | Column) -> Column:
    """'DD-MON-YY HH24:MI:SS' text, month in capitals."""
    return F.upper(F.date_format(col_(c), "dd-MMM-yy HH:mm:ss"))


def add_minutes(ts: str | Column, minutes: Column) -> Column:
    """ts + minutes (fractional minutes kept to the microsecond)."""
    secs = (minutes * F.lit(60)).cast("decimal(18,6)")
    return col_(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def ntz_to_instant(c: str | Column) -> Column:
    """NTZ wall-clock time as a zoned TIMESTAMP read as UTC, whatever the
    session zone (a plain cast would use the session zone). Needed where
    Spark requires a zoned timestamp, e.g. ``withWatermark``."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), col_(c))
    return F.timestamp_micros(micros)


def instant_to_ntz(c: str | Column) -> Column:
    """Inverse of ``ntz_to_instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col_(c)), F.expr(_EPOCH_NTZ))


def day_of(c: str | Column) -> Column:
    """Midnight of an NTZ time, as NTZ (no session zone involved)."""
    return col_(c).cast("date").cast("timestamp_ntz")


_UNIT_MICROS = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6,
                "week": 7 * 86400 * 10**6}


def time_bucket(c: str | Column, unit: str) -> Column:
    """Index of the fixed-width time bucket of an NTZ time (BIGINT, never
    decreasing along time, no session zone involved)."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), col_(c))
    return F.floor(micros / F.lit(_UNIT_MICROS[unit]))

