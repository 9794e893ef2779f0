"""Size-checked broadcast.

A broadcast hint is given only when the optimizer's size estimate of the side
is under a limit; otherwise the join is left to the planner (sort-merge, and
AQE's run-time switch to broadcast once the real shuffle size is known). The
estimate is an upper bound for the tables here (file size of the scanned
columns, not reduced by filters), so the check errs towards not broadcasting.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

DEFAULT_BROADCAST_LIMIT = 32 * 1024 * 1024  # bytes of the estimated side


def estimated_size(df: DataFrame) -> int | None:
    """Optimizer size estimate in bytes, or None when it is not available
    (e.g. a Spark Connect client)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - estimate is best effort
        return None


def broadcast_if_small(df: DataFrame, limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    size = estimated_size(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    log.debug("not broadcasting: estimated %s bytes > %s", size, limit)
    return df
