"""Global positions and running sums without a single-task window.

A window over a whole table, or over one huge group, runs in one task.  Both helpers here cut the
order into blocks, sum the blocks, and add each block's offset to positions found inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

_PREFIX = 4  # hex digits: at most 65,536 blocks, whose counts form a table of known, small size


def hash_rank(df: DataFrame, digest: Column, ties: list[str], out: str = "position") -> DataFrame:
    """0-based position of each row in the order of a hex digest, then of the tie columns.

    Digests are uniform, so their leading digits cut the order into even blocks.
    """
    keyed = df.withColumn("_digest", F.coalesce(digest, F.lit(""))).withColumn("_block", F.substring("_digest", 1, _PREFIX))
    sizes = keyed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_block").orderBy("_digest", *ties)
    return (
        keyed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_block")
        .withColumn(out, F.col("_offset") + F.col("_rank"))
        .drop("_digest", "_block", "_offset", "_rank")
    )


def running_sum(
    df: DataFrame, group: list[str], order: list[Column], value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over the rows before and including each row of its group, in order.

    The rows are range-partitioned by group and order and settled, because a block number taken
    from the partitioning must not change between its readers.  The order must be total.
    """
    keys = [F.col(g) for g in group]
    blocks = settled(
        df.withColumn("_value", value)
        .repartitionByRange(*keys, *order)
        .withColumn("_block", F.spark_partition_id())
    )
    sums = blocks.groupBy(*group, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy(*group, "_block").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocks.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*group, "_block"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_value", "_block", "_offset", "_inside")
    )


def order_rank(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """0-based position of each row in a total order of columns."""
    ranked = running_sum(
        df.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in order], F.lit(1).cast("bigint"), out
    )
    return ranked.withColumn(out, F.col(out) - 1).drop("_all")
