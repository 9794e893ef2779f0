"""Profile settings: the value that holds for a row, by precedence of levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Level ids from the most particular to the most general, with the column of the row that names its
#: place on the level; the last one, the site, has none.
LEVELS: tuple[tuple[int, str | None], ...] = ((10004, "user_id"), (10003, "responsibility_id"), (10001, None))


def with_setting(rows: DataFrame, settings: DataFrame, setting: str, name: str,
                 levels: Sequence[tuple[int, str | None]] = LEVELS) -> DataFrame:
    """``rows`` with the value of ``setting`` (column ``name``) and the id of the
    level it comes from (``<name>_level``): the first level, in the order of
    ``levels``, whose value for the row is set; both NULL where none is. A value
    that is NULL counts as not set, and so does a level on which the row's place
    is NULL.

    ``settings``: setting, level_id, level_value, value; of several values for
    one place the greatest holds. Each level is an equi-join with one row per
    place (the planner broadcasts it if it is small, AQE splits a place with
    many rows); a level without a column is one value, a scalar subquery. No row
    is dropped or repeated."""
    of = settings.where((F.col("setting") == setting) & F.col("value").isNotNull())
    out, found = rows, []
    for level, column in levels:
        here = of.where(F.col("level_id") == level)
        if column is None:
            value = here.agg(F.max("value")).scalar()
        else:
            held = f"_{name}_{level}"
            per_place = here.groupBy("level_value").agg(F.max("value").alias(held)).withColumnRenamed("level_value", f"{held}_at")
            out = out.join(per_place, F.col(column) == F.col(f"{held}_at"), "left").drop(f"{held}_at")
            value = F.col(held)
        found.append((level, value))
    out = out.withColumns({f"_{name}_at_{level}": value for level, value in found})
    values = [F.col(f"_{name}_at_{level}") for level, _ in found]
    level_of = F.coalesce(*[F.when(v.isNotNull(), F.lit(level)) for (level, _), v in zip(found, values, strict=True)])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(*values).alias(name), level_of.alias(f"{name}_level"))
