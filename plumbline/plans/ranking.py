"""A rank over all rows without one task that holds them: sorted ranges, counted, and numbered inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import materialize


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place (from 1) in ``order``. Rows are dealt by ranges of the order; only one row a range is summed in one window."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_in": inside}))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_before")
    placed = dealt.join(F.broadcast(sizes), F.col("_part") == F.col("_p"))  # one row a partition
    return placed.withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_p", "_before")
