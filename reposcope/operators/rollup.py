"""Growth from a daily rollup of counter snapshots, kept up by batches.

The rollup holds each repository's last snapshot of each day. A day ends with
midnight itself, so that the snapshots at or before a midnight are those of
the days that end by then, and growth since a midnight is read from the rollup
alone: days x repositories, however many snapshots there are. A cutoff inside
a day needs the snapshots of that one day besides.

A batch may hold snapshots of any days in any order: the last one of a day is
a maximum, so batches can be folded in as they come. The stored form is a
``DeltaTable`` by repository; a batch reads and writes only the buckets of its
repositories.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions.time import col_type, minus_days, to_datetime, ts_lit
from reposcope.operators.snapshots import trending_growth
from reposcope.sources.delta_table import DeltaTable

COUNTERS = ("stargazers_count", "forks_count")


def daily(stats: DataFrame, order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """The last snapshot of every repository and day. Applies to snapshots and to rollup rows alike; snapshots without a time are left out.
    → repository_id, day, order columns, stargazers_count, forks_count"""
    day = F.to_date(F.col("event_time") - F.expr("INTERVAL 1 MICROSECOND"))
    last = F.max_by(F.struct(*order_cols, *COUNTERS), F.struct(*order_cols)).alias("_last")
    return stats.where(F.col("event_time").isNotNull()).groupBy("repository_id", day.alias("day")).agg(last).select("repository_id", "day", "_last.*")


def rollup_table(spark: SparkSession, root: str, buckets: int = 32) -> DeltaTable:
    return DeltaTable(spark, root, ["repository_id", "day"], by=["repository_id"], buckets=buckets)


def update_rollup(table: DeltaTable, seq: int, stats: DataFrame, order_cols: Sequence[str] = ("event_time",)) -> None:
    """Fold batch ``seq`` of snapshots into the stored rollup, or start it. A batch that runs again changes nothing."""
    new = daily(stats, order_cols)
    if table.newest(before=seq) is None:
        table.create(new, seq)
    else:
        table.apply(seq, new, lambda now, more: daily(now.unionByName(more), order_cols))


def trending_from_rollup(rollup: DataFrame, as_of, days: int = 30, limit: int = 200, order_cols: Sequence[str] = ("event_time",),
                         snapshots: DataFrame | None = None) -> DataFrame:
    """``trending_growth`` read from the rollup; the same result.

    A cutoff that is not a midnight needs ``snapshots``, of which only those
    of the cutoff's day are read.
    → repository_id, star_growth, fork_growth, growth, rank
    """
    cutoff = to_datetime(minus_days(as_of, days))
    rows = rollup.select("repository_id", *order_cols, *COUNTERS)
    midnight = datetime(cutoff.year, cutoff.month, cutoff.day)
    if cutoff != midnight:
        if snapshots is None:
            raise ValueError("a cutoff inside a day needs the snapshots of that day")
        kind = col_type(snapshots, "event_time")
        of_day = snapshots.where((F.col("event_time") > ts_lit(midnight, kind)) & (F.col("event_time") <= ts_lit(cutoff, kind))
                                 & (F.col("event_time") < ts_lit(midnight + timedelta(days=1), kind)))
        rows = rows.unionByName(of_day.select(*rows.columns))
    return trending_growth(rows, as_of, days, limit, order_cols)
