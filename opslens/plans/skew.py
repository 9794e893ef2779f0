"""Per-key ordered windows that do not put a whole key into one task.

A window ``partitionBy(host).orderBy(ts)`` sends every row of a host to one
task. If one host holds a third of the fleet's samples, that task holds a third
of the data. The helpers here split each key into time buckets (rows per
(key, bucket) are bounded by the sampling rate and the bucket width, not by
fleet size or history length), run the window per (key, bucket), and supply
the rows a bucket needs from before its start as *context rows*:

1. the rows are shuffled once, by (key, bucket); the last ``n_back`` rows of
   every bucket are taken from the shuffled buckets, where they already lie
   together, so the input is read and shuffled once and not a second time for
   the tails (Spark reuses the exchange);
2. over those tails (at most ``n_back`` rows per bucket) each tail row finds
   the later buckets that start within its next ``n_back`` tail rows
   (``lead`` over the per-key tail order) and is copied to them. This window
   holds ``n_back`` rows per non-empty bucket of a key, so pick the bucket
   width to keep buckets per key moderate (an hour over a year is 8,760);
3. the context rows, few, are shuffled to their buckets and joined to them by
   a union of equal partitionings, which moves no row of the input again; the
   window runs, and the context rows are dropped.

The result equals the plain per-key window exactly, whatever the bucket width.

Top-n per key needs no helper: ``row_number() <= n`` over ``partitionBy(key)``
is planned with a partial ``WindowGroupLimit`` on the map side, so each input
partition sends at most n rows per key to the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
CONTEXT = "_context"


def with_context(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                 n_back: int) -> DataFrame:
    """``df`` plus a ``_bucket`` column, a ``_context`` flag, and for every
    (key, bucket) the ``n_back`` rows that precede the bucket (flagged
    ``_context = true`` and re-labelled with the bucket they serve).

    ``order`` must be a total order within a key, and ``bucket`` must not
    decrease along it (e.g. ``date_trunc('hour', ts)`` with ``ts`` first in
    ``order``).
    """
    keys, order = list(keys), list(order)
    # one exchange for the buckets and for their tails; both need every column of it
    base = df.withColumn(BUCKET, bucket).repartition(*keys, BUCKET)
    desc = [F.col(c).desc() for c in order]
    # 1. last n_back rows of every (key, bucket), without a further shuffle
    if n_back == 1:
        others = [c for c in base.columns if c not in keys and c != BUCKET]
        last = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order]))
        tails = (base.groupBy(*keys, BUCKET).agg(last.alias("_last"))
                 .select(*keys, BUCKET, *[F.col(f"_last.{c}").alias(c) for c in others]))
    else:
        w_tail = Window.partitionBy(*keys, BUCKET).orderBy(*desc)
        tails = base.withColumn("_r", F.row_number().over(w_tail)).where(F.col("_r") <= n_back).drop("_r")
    # 2. a tail row is context for every later bucket that starts within the
    #    next n_back tail rows of its key: the buckets among lead(bucket, 1..n_back)
    w_idx = Window.partitionBy(*keys).orderBy(F.col(BUCKET), *[F.col(c) for c in order])
    ahead = F.array(*[F.lead(BUCKET, k).over(w_idx) for k in range(1, n_back + 1)])
    # a null bucket comes first, so a null ahead only means that no row follows
    targets = F.array_distinct(F.filter(ahead, lambda b: b.isNotNull() & ~b.eqNullSafe(F.col(BUCKET))))
    ctx = (tails.withColumn("_targets", targets)
           .withColumn(BUCKET, F.explode("_targets")).drop("_targets")
           .withColumn(CONTEXT, F.lit(True)).repartition(*keys, BUCKET))
    return base.withColumn(CONTEXT, F.lit(False)).unionByName(ctx)


def previous_values(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    cols: Sequence[str], bucket: Column | None, prefix: str = "prev_") -> DataFrame:
    """Attach ``prev_<col>``: the value of ``col`` on the previous row of the
    same key in ``order`` (NULL on a key's first row). Equal to
    ``lag(col).over(partitionBy(keys).orderBy(order))``, which is what
    ``bucket=None`` runs (one read, but a whole key per task)."""
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])
        return df.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in cols])
    x = with_context(df, keys, order, bucket, 1)
    w = Window.partitionBy(*keys, BUCKET).orderBy(*[F.col(c) for c in order])
    for c in cols:
        x = x.withColumn(prefix + c, F.lag(c).over(w))
    return x.where(~F.col(CONTEXT)).drop(CONTEXT, BUCKET)


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 cols: dict[str, Column], n: int, bucket: Column | None) -> DataFrame:
    """Mean of each expression over the current and the ``n - 1`` previous
    rows of the key (fewer at the start of a key). ``cols`` maps output name
    to the expression averaged. Equal to ``avg(expr).over(partitionBy(keys)
    .orderBy(order).rowsBetween(-(n - 1), 0))``, which is what ``bucket=None``
    runs (one read, but a whole key per task)."""
    if bucket is None:
        w = (Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order]).rowsBetween(-(n - 1), 0))
        return df.select("*", *[F.avg(expr).over(w).alias(name) for name, expr in cols.items()])
    tmp = {name: f"_v_{name}" for name in cols}
    src = df.select("*", *[expr.alias(tmp[name]) for name, expr in cols.items()])
    x = with_context(src, keys, order, bucket, n - 1) if n > 1 else \
        src.withColumn(BUCKET, bucket).withColumn(CONTEXT, F.lit(False))
    w = (Window.partitionBy(*keys, BUCKET).orderBy(*[F.col(c) for c in order])
         .rowsBetween(-(n - 1), 0))
    for name in cols:
        x = x.withColumn(name, F.avg(tmp[name]).over(w))
    return x.where(~F.col(CONTEXT)).drop(CONTEXT, BUCKET, *tmp.values())


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n per key by ``order`` (give a total order: ties are
    broken by the trailing columns)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
