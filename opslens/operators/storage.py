"""Storage and capacity reports: database size, data files, tablespace usage
and its threshold alert, archive volume, temp usage, corruption, recovery area.

Aggregations run before joins wherever the join only filters or labels (the
container and PDB lists have one row per ``con_id``): the partial/final hash
aggregate shrinks the file-level rows to one row per group on the map side, and
the joins then touch only the group rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.functions.exprs import as_of_lit, day_of, gib, parse_as_of, pct_used
from opslens.plans.joins import broadcast_if_small
from opslens.plans.ranking import global_rank


def database_size(data_files: DataFrame, temp_files: DataFrame, pdbs: DataFrame,
                  union_all: bool = False) -> DataFrame:
    """Total size per container: data-file GiB plus temp-file GiB.

    Temp totals are rounded to whole GiB, data totals are not. The two totals
    are combined with a set union by default, so a container whose data and
    temp totals are equal counts that total once; ``union_all=True`` adds both.
    A container missing from ``pdbs`` (the root) is named 'CDB'.
    Columns: con_id, database_name, total_size_gb.
    """
    names = broadcast_if_small(pdbs.select("con_id", F.col("name").alias("pdb_name")))

    def per_container(files: DataFrame, rounded: bool) -> DataFrame:
        size = gib(F.sum("bytes"))
        agg = files.groupBy("con_id").agg((F.round(size, 0) if rounded else size).alias("size_gb"))
        return agg.join(names, "con_id", "left").select(
            "con_id", F.coalesce("pdb_name", F.lit(codes.MISSING_CONTAINER_LABEL)).alias("database_name"),
            "size_gb")

    both = per_container(data_files, False).unionByName(per_container(temp_files, True))
    if not union_all:
        both = both.distinct()
    return (both.groupBy("con_id", "database_name").agg(F.sum("size_gb").alias("total_size_gb"))
            .orderBy(F.col("con_id").asc_nulls_last()))


def datafile_details(data_files: DataFrame, pdbs: DataFrame,
                     root_label: str = codes.ROOT_CONTAINER_LABEL, ordered: bool = True, ranked: bool = False) -> DataFrame:
    """Every data file with its container name, status and autoextend flag,
    ordered by container name then file id (the file id is not shown).
    The listing grows with the fleet; ``ordered=False`` skips the global sort
    (range-partition sampling plus a full shuffle) when the result is written
    as a table rather than read in order. ``ranked`` shows the place of every
    file in that order instead, for readers of an unordered table.
    Columns: (rank,) container_name, tablespace_name, file_name, status, autoextend."""
    p = broadcast_if_small(pdbs.select(F.col("con_id").alias("pdb_id"), F.col("name").alias("pdb_name")))
    df = data_files.join(p, data_files.con_id == p.pdb_id, "left")
    name = F.when(F.col("con_id") == 1, F.lit(root_label)).otherwise(F.col("pdb_name"))
    out = df.select(name.alias("container_name"), "tablespace_name", "file_name", "status",
                    F.col("autoextensible").alias("autoextend"), "file_id")
    order = [F.col("container_name").asc_nulls_last(), F.col("file_id").asc_nulls_last()]
    if ranked:
        out = global_rank(out, order)
    elif ordered:
        out = out.orderBy(*order)
    return out.drop("file_id")


def _usage_parts(data_files: DataFrame, free_space: DataFrame, temp_files: DataFrame,
                 containers: DataFrame):
    ids = broadcast_if_small(containers.select("con_id", F.col("name").alias("con_name")))
    free = (free_space.groupBy("con_id", "tablespace_name").agg(F.sum("bytes").alias("free_bytes"))
            .join(ids, "con_id", "left_semi"))
    alloc = (data_files.groupBy("con_id", "tablespace_name")
             .agg(F.sum("bytes").alias("alloc_bytes"), F.max("maxbytes").alias("max_bytes"))
             .join(ids, "con_id", "left_semi"))
    temp = (temp_files.groupBy("con_id", "tablespace_name")
            .agg(F.sum("bytes").alias("alloc_bytes"), F.max("maxbytes").alias("max_bytes"))
            .join(ids, "con_id"))
    return ids, free, alloc, temp


# by container as the report orders, then tablespace: a total order that lets
# range partitioning split a container with many tablespaces
def _usage_order():
    return [F.col(c).asc_nulls_last() for c in ("con_id", "con_name", "tablespace_name")]


def capacity_usage(data_files: DataFrame, free_space: DataFrame, temp_files: DataFrame,
                   containers: DataFrame, keep_full: bool = False, ordered: bool = True) -> DataFrame:
    """Free, allocated and largest-file GiB per container and tablespace, temp
    tablespaces appended with NULL free space. ``max_allocated_gb`` is the
    largest single file's maximum, not a sum.

    By default a tablespace without any free-space row is left out (the
    free/allocated join is inner); ``keep_full=True`` keeps it with 0 free.
    Columns: con_id, con_name, tablespace_name, free_space_gb,
    allocated_space_gb, max_allocated_gb.
    """
    ids, free, alloc, temp = _usage_parts(data_files, free_space, temp_files, containers)
    if keep_full:
        perm = alloc.join(free, ["con_id", "tablespace_name"], "left") \
                    .withColumn("free_bytes", F.coalesce("free_bytes", F.lit(0).cast("bigint")))
    else:
        perm = free.join(alloc, ["con_id", "tablespace_name"])
    perm = perm.join(ids, "con_id").select(
        "con_id", "con_name", "tablespace_name", gib("free_bytes").alias("free_space_gb"),
        gib("alloc_bytes").alias("allocated_space_gb"), gib("max_bytes").alias("max_allocated_gb"))
    temp = temp.select(
        "con_id", "con_name", "tablespace_name", F.lit(None).cast("double").alias("free_space_gb"),
        gib("alloc_bytes").alias("allocated_space_gb"), gib("max_bytes").alias("max_allocated_gb"))
    out = perm.unionByName(temp)
    return out.orderBy(*_usage_order()) if ordered else out


def capacity_alerts(usage: DataFrame, threshold: float = codes.CAPACITY_THRESHOLD,
                    include_temp: bool = False, ordered: bool = True) -> DataFrame:
    """Tablespaces whose used share of the allocation is strictly above
    ``threshold`` percent; zero allocation gives NULL and no alert. Temp
    tablespaces (no free-space figure) are added only with ``include_temp``,
    and then only when their allocation is above zero.
    Columns: the usage columns plus used_percentage (NULL on temp rows)."""
    # the percentage of a temp row is NULL as its free space is; one pass serves both kinds
    out = usage.withColumn("used_percentage", pct_used("allocated_space_gb", "free_space_gb"))
    alert = F.col("used_percentage") > F.lit(float(threshold))
    if include_temp:
        alert = alert | (F.col("free_space_gb").isNull() & (F.col("allocated_space_gb") > 0))
    out = out.where(alert)
    return out.orderBy(*_usage_order()) if ordered else out


def archive_per_day(archived_log: DataFrame, as_of, days: int = 6,
                    whole_days: bool = False) -> DataFrame:
    """Archived-log GiB (rounded to whole GiB) and count per day, newest day
    first. The window is ``completion_time > as_of - days`` to the second, so
    the oldest day is partial; ``whole_days=True`` starts at midnight instead.
    Columns: day, gb, archives_generated_per_day."""
    bound = parse_as_of(as_of) - _dt.timedelta(days=days)
    if whole_days:
        bound = bound.replace(hour=0, minute=0, second=0, microsecond=0)
    lower = as_of_lit(bound)
    day = day_of("completion_time")
    return (archived_log.where(F.col("completion_time") > lower)
            .groupBy(day.alias("day"))
            .agg(F.round(gib(F.sum(F.col("blocks") * F.col("block_size"))), 0).alias("gb"),
                 F.count(F.lit(1)).alias("archives_generated_per_day"))
            .orderBy(F.col("day").desc_nulls_first()))


def temp_usage(sort_segment: DataFrame, tablespaces: DataFrame, temp_files: DataFrame,
               by_container: bool = False) -> DataFrame:
    """Total and used GiB of each temp tablespace.

    Totals join tablespace names to temp files on the tablespace number only,
    as the source report does, so a number shared by several containers adds
    all their files (``by_container=True`` joins on (con_id, ts_no)). The file
    sizes are summed per number before that join and the used blocks per name
    before the second, so no file-level row is multiplied by the fan-out; the
    sums are the same integers.
    Columns: tablespace_name, total_size_gb, used_size_gb.
    """
    key = ["con_id", "ts_no"] if by_container else ["ts_no"]
    files = temp_files.groupBy(*key, "block_size").agg(F.sum("bytes").alias("bytes"))
    totals = (tablespaces.select(*key, "name").join(files, key)
              .groupBy("name", "block_size").agg(gib(F.sum("bytes")).alias("total_size_gb")))
    used = sort_segment.groupBy("tablespace_name").agg(F.sum("used_blocks").alias("used_blocks"))
    return (used.join(totals, used.tablespace_name == totals.name)
            .groupBy("tablespace_name", "total_size_gb")
            .agg(gib(F.sum(F.col("used_blocks") * F.col("block_size"))).alias("used_size_gb")))


def block_corruption(corruption: DataFrame, ordered: bool = True, ranked: bool = False) -> DataFrame:
    """Corrupt block ranges, highest file number first (then by block);
    ``ranked`` shows the places in that order instead.
    Columns: (rank,) file_no, block_no, blocks, corruption_change_no, corruption_type."""
    out = corruption.select("file_no", "block_no", "blocks", "corruption_change_no", "corruption_type")
    order = [F.col("file_no").desc_nulls_first(), F.col("block_no").asc_nulls_last()]
    if ranked:
        return global_rank(out, order)
    return out.orderBy(*order) if ordered else out


def recovery_area(recovery_dest: DataFrame) -> DataFrame:
    """Recovery area size: total and used GiB, free GiB rounded to whole GiB.
    Columns: name, total_space_gb, used_space_gb, free_space_gb."""
    total, used = gib("space_limit"), gib("space_used")
    return recovery_dest.select("name", total.alias("total_space_gb"), used.alias("used_space_gb"),
                                F.round(total - used, 0).alias("free_space_gb"))


__all__ = ["database_size", "datafile_details", "capacity_usage", "capacity_alerts",
           "archive_per_day", "temp_usage", "block_corruption", "recovery_area"]
