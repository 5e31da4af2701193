"""Registered queries: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables with flat output columns (bigint / string / double /
timestamp / boolean); doubles are rounded to 6 digits, integers are bigint,
so the DuckDB oracle in ``reposcope.plans.oracle`` can be compared value by
value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.operators import snapshots as S
from reposcope.plans import params as P
from reposcope.sources import fixtures as FX

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    # Import side-effect modules that add more entries.
    from reposcope.plans import catalog_more  # noqa: F401
    return dict(_REGISTRY)


STAT_OUT = ["repository_id", "event_time", "stargazers_count", "watchers_count", "forks_count",
            "open_issues_count", "pushed_at"]
ORDERS_ORDER = ("event_time", "tie")


def _stat_out(df: DataFrame) -> DataFrame:
    return df.select(*STAT_OUT, F.round("score", 6).alias("score"))


# -- snapshots (f_stats: events) ----------------------------------------------------------

@register("trending_growth")
def q_trending_growth(spark, sf):
    return S.trending_growth(FX.stats(spark, sf), P.EVENTS_AS_OF, P.EVENTS_DAYS, P.TRENDING_LIMIT)


@register("trending_growth_30d")
def q_trending_growth_30d(spark, sf):
    return S.trending_growth(FX.stats_long(spark, sf), P.ORDERS_AS_OF, P.ORDERS_DAYS,
                             P.TRENDING_LIMIT, order_cols=ORDERS_ORDER)


@register("latest_counters")
def q_latest_counters(spark, sf):
    return S.latest_counters(FX.stats(spark, sf))


@register("past_counters")
def q_past_counters(spark, sf):
    return S.past_counters(FX.stats(spark, sf), P.EVENTS_CUTOFF)


@register("latest_stat")
def q_latest_stat(spark, sf):
    return _stat_out(S.latest_stat(FX.stats(spark, sf)))


@register("first_stat")
def q_first_stat(spark, sf):
    return _stat_out(S.first_stat(FX.stats(spark, sf)))


@register("last_update")
def q_last_update(spark, sf):
    return S.last_update(FX.stats(spark, sf))


@register("stats_history")
def q_stats_history(spark, sf):
    h = S.stats_history(FX.stats(spark, sf))
    return h.select(*STAT_OUT, F.round("score", 6).alias("score"), "rn")


@register("recently_pushed")
def q_recently_pushed(spark, sf):
    return S.recently_pushed(FX.stats(spark, sf), P.EVENTS_SINCE)


@register("snapshots_by_month")
def q_snapshots_by_month(spark, sf):
    return S.snapshots_by_month(FX.stats_long(spark, sf))


# -- change detection / de-duplication (coarse orders states) -----------------------------

COARSE_OUT = ["repository_id", "event_time", "tie", "stargazers_count", "watchers_count",
              "forks_count", "open_issues_count"]


@register("snapshots_changed")
def q_snapshots_changed(spark, sf):
    return S.snapshots_changed(FX.stats_long(spark, sf, coarse=True),
                               order_cols=ORDERS_ORDER).select(*COARSE_OUT)


@register("dedupe_global")
def q_dedupe_global(spark, sf):
    return S.dedupe_global(FX.stats_long(spark, sf, coarse=True),
                           order_cols=ORDERS_ORDER).select(*COARSE_OUT)


@register("dedupe_check")
def q_dedupe_check(spark, sf):
    return S.dedupe_check(FX.stats_long(spark, sf, coarse=True), order_cols=ORDERS_ORDER)


@register("state_hash")
def q_state_hash(spark, sf):
    """Hash values differ between engines: rows that share one are counted."""
    return S.state_repeats(FX.stats_long(spark, sf, coarse=True)).select("repository_id", "event_time", "tie", "n_same")


@register("snapshot_sink")
def q_snapshot_sink(spark, sf):
    """Snapshots written by month and read back from one month on (partitions pruned)."""
    from reposcope.session import scratch_path
    from reposcope.sources.sinks import append_snapshots
    path = scratch_path(spark, "snapshots")
    append_snapshots(FX.stats_long(spark, sf), path)
    back = spark.read.parquet(path).where(F.col("event_month") >= P.SINK_MONTH)
    return back.select(F.col("event_month").cast("string").alias("event_month"), *COARSE_OUT)


@register("snapshot_rewrite")
def q_snapshot_rewrite(spark, sf):
    """The whole table rewritten with the first row of every state."""
    from reposcope.session import scratch_path
    from reposcope.sources.sinks import rewrite_deduped
    path = scratch_path(spark, "snapshots-deduped")
    rewrite_deduped(FX.stats_long(spark, sf, coarse=True), path, order_cols=ORDERS_ORDER)
    return spark.read.parquet(path).select(*COARSE_OUT)
