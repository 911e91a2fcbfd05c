"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.runtime import Scratch


def with_rank(frame: DataFrame, order: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """Adds the 0-based position in the order of columns: range partitions are sorted each on its own, and the counts of
    those before give the offset. Ties must be broken by the columns."""
    dealt = scratch.save(lambda: frame.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(offsets, "__part").withColumn(name, F.col("__before") + own - 1).drop("__part", "__before")


def block_of(rank: Column, count: Column, blocks: int) -> Column:
    """Which of `blocks` contiguous near-equal blocks a position is in; the first ones take one more."""
    size, extra = F.floor(count / blocks), count % blocks
    return F.when(rank < extra * (size + 1), F.floor(rank / (size + 1))).otherwise(extra + F.floor((rank - extra * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")


def block_start(block: int, count: int, blocks: int) -> int:
    size, extra = divmod(count, blocks)
    return block * size + min(block, extra)
