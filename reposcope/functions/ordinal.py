"""Distributed global ordinals.

``row_number()`` over an un-partitioned window moves a whole table into one
task. ``global_rank`` instead range-partitions by the order, sorts inside
each range and numbers rows with ``monotonically_increasing_id`` (range
index in the high bits, position in the low bits) — all in one stage. The
range partitioner samples its bounds on every evaluation, so the numbered
frame is pinned with ``checkpoint()`` (in the shared checkpoint folder)
before it is read twice: once for the per-range sizes (one row per range;
their prefix sum is tiny) and once for the rows. Exact and total when the
order ends in a unique column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.session import checkpoint_root

_LOW_BITS = 33


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank",
                num_ranges: int | None = None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_root(spark)
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid = F.monotonically_increasing_id()
    x = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_mid", mid)
         .withColumn("_range", F.shiftright("_mid", _LOW_BITS))
         .withColumn("_local", F.col("_mid").bitwiseAND((1 << _LOW_BITS) - 1))
         .drop("_mid")
         .checkpoint(eager=True))
    sizes = x.groupBy("_range").agg((F.max("_local") + 1).alias("_n"))
    # One row per range: bounded by the range count, safe in one partition.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_offset"))
    return (x.join(F.broadcast(offsets), "_range")
            .withColumn(name, (F.col("_offset") + F.col("_local") + 1).cast("bigint"))
            .drop("_range", "_local", "_offset"))


def rank_within(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], bucket: Column,
                bucket_desc: bool = False, name: str = "rn") -> DataFrame:
    """``row_number()`` per group, computed without sorting a whole group
    in one task.

    ``bucket`` must be monotone in ``order`` (e.g. the day of the time a
    group is ordered by; descending buckets for a descending order). Rows
    are numbered inside (group, bucket), and each bucket adds the row count
    of the group's earlier buckets, from a per-(group, bucket) count table
    whose aggregate is partial map-side. A group holding a third of all
    rows is spread over its buckets.
    """
    x = df.withColumn("_b", bucket)
    x = x.withColumn("_l", F.row_number().over(Window.partitionBy(*group_cols, "_b").orderBy(*order)))
    sizes = x.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    border = F.desc("_b") if bucket_desc else F.asc("_b")
    before = F.sum("_n").over(Window.partitionBy(*group_cols).orderBy(border)
                              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*group_cols, "_b", F.coalesce(before, F.lit(0)).alias("_off"))
    return (x.join(offsets, [*group_cols, "_b"])
            .withColumn(name, (F.col("_off") + F.col("_l")).cast("bigint"))
            .drop("_b", "_l", "_off"))
