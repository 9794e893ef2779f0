"""Helpers shared by the operators: names, lineage cuts, text measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import ensure_checkpoint_dir

#: A word: a run of characters that are neither ASCII space nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder: later uses read the
    files instead of recomputing, and a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand texts to Python tasks in Arrow batches of at most ``rows`` rows. A
    batch is held by the executor and by its Python worker at once, and the
    default of 10,000 rows is sized for narrow rows, not for documents. The
    setting is the session's, since plans are run after the operator returns;
    a smaller one is left as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def release_memory() -> None:
    """At the end of a Python task: freed memory goes back to the system, so
    that idle workers, which Spark keeps, do not hold it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not use (compared the
    way Spark resolves them: without case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A uniform number in [0, 1) fixed by the given strings (52 bits of MD5:
    the same in every engine that has MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def pieces(df: DataFrame, rows_each: int) -> int:
    """How many pieces of about ``rows_each`` rows ``df`` makes, no fewer than
    the session's shuffle partitions."""
    n = df.count()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_each))
