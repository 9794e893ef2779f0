"""Sessions: online application users and idle database sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.functions.exprs import add_minutes, as_of_lit


def _online(app_sessions: DataFrame, app_users: DataFrame, as_of,
            timeout_minutes: float | Column | None) -> DataFrame:
    s = app_sessions
    # Session time-out: the site profile value in minutes; when it is unset
    # (NULL) or 0, the session's own limit in hours. A Column may carry a
    # per-database value.
    if timeout_minutes is None:
        minutes = F.col("limit_time") * F.lit(60)
    else:
        p = timeout_minutes if isinstance(timeout_minutes, Column) else F.lit(float(timeout_minutes))
        minutes = F.when(p.isNull() | (p == 0), F.col("limit_time") * F.lit(60)).otherwise(p)
    live = s.where((F.col("disabled_flag") != "Y") & (F.col("pseudo_flag") == "N")
                   & (F.col("counter") < F.col("limit_connects"))
                   & (add_minutes("last_connect", minutes.cast("double")) > as_of_lit(as_of)))
    users = app_users.where(F.col("user_name") != codes.GUEST_USER)
    return live.join(users, "user_id")


def online_users(app_sessions: DataFrame, app_users: DataFrame, as_of,
                 timeout_minutes: float | Column | None = None) -> DataFrame:
    """Sessions still inside their time-out at ``as_of``: not disabled (a NULL
    flag does not count as 'not disabled'), not pseudo, under the connect
    limit, user not GUEST. Distinct rows.
    Columns: session_id, user_id, user_name, description."""
    return (_online(app_sessions, app_users, as_of, timeout_minutes)
            .select("session_id", "user_id", "user_name", "description").distinct())


def online_user_count(app_sessions: DataFrame, app_users: DataFrame, as_of,
                      timeout_minutes: float | Column | None = None) -> DataFrame:
    """Number of online-session rows. Columns: online_users."""
    return (_online(app_sessions, app_users, as_of, timeout_minutes)
            .agg(F.count(F.lit(1)).alias("online_users")))


def inactive_sessions(db_sessions: DataFrame, idle_seconds: int = 86400,
                      username: str = codes.APPS_USER, by_session: bool = True,
                      ordered: bool = True) -> DataFrame:
    """INACTIVE sessions of one account idle longer than ``idle_seconds``,
    with a row count per group, largest first. The source report groups by
    session id and serial too (count 1 per session); ``by_session=False``
    groups by status, module, program and machine only; ``ordered=False``
    skips the global sort of a fleet-sized result written as a table.
    Columns: [sid, serial_no,] status, module, program, machine, session_count."""
    df = db_sessions.where((F.col("status") == "INACTIVE") & (F.col("username") == username)
                           & (F.col("last_call_et") > idle_seconds))
    keys = (["sid", "serial_no"] if by_session else []) + ["status", "module", "program", "machine"]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("session_count"))
    # the group keys break ties: with a count of 1 on nearly every row the
    # count alone would send all rows to one range partition
    return (out.orderBy(F.col("session_count").desc(), *[F.col(k).asc_nulls_last() for k in keys])
            if ordered else out)
