"""Places of rows in a global order, without a window over all rows in one task.

``row_number().over(Window.orderBy(...))`` has no partition key: every row goes
through one task. Here the rows are dealt to range partitions of the order and
sorted there, so a row's place is its position in its partition plus the sizes
of the partitions before it:

1. the order is completed by the other columns and, last, by the row's place in
   the input, so that no group of ties, and not even of equal rows, is kept in
   one partition;
2. the sorted rows are materialised in the shared checkpoint folder with their
   partition and position (``monotonically_increasing_id`` holds both), because
   range bounds are sampled and a second run might deal them otherwise;
3. sizes are summed up in two levels: inside blocks of ``BLOCK`` partitions by
   a window, over the blocks by adding each block's size to all later ones.
   What is joined back has one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from opslens.session import ensure_checkpoint_dir

BLOCK = 256
#: monotonically_increasing_id: the partition above these bits, the position in it below.
POSITION_BITS = 33


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place (1 to n) of every row in ``order`` as its first
    column. Ties go by all columns from left to right, ascending with nulls
    last; equal rows are numbered in any order. Equal to ``row_number()`` over
    that order. Runs the job that sorts the rows; the result holds their places,
    not their order."""
    ensure_checkpoint_dir(df.sparkSession)
    ties = [F.col(f"`{f.name}`").asc_nulls_last() for f in df.schema if not isinstance(f.dataType, MapType)]
    full = [*order, *ties, F.col("_place")]
    dealt = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*full).sortWithinPartitions(*full)
    rows = dealt.drop("_place").withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    rows = rows.select(*df.columns, F.shiftright("_at", POSITION_BITS).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias("_pos"))

    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_block", F.floor(F.col("_part") / BLOCK))
    last = max(0, rows.rdd.getNumPartitions() - 1) // BLOCK
    later = F.when(F.col("_block") < last, F.sequence(F.col("_block") + 1, F.lit(last).cast("long")))
    blocks = (sizes.groupBy("_block").agg(F.sum("n").alias("n")).select("n", F.explode(later).alias("_block"))
              .groupBy("_block").agg(F.sum("n").alias("_blocks_before")))
    in_block = F.sum("n").over(Window.partitionBy("_block").orderBy("_part")) - F.col("n")
    before = (sizes.withColumn("_before", in_block).join(blocks, "_block", "left")
              .select("_part", (F.col("_before") + F.coalesce("_blocks_before", F.lit(0))).alias("_before")))
    place = (F.col("_before") + F.col("_pos") + 1).alias(name)
    return rows.join(F.broadcast(before), "_part").select(place, *df.columns)  # one row per partition
