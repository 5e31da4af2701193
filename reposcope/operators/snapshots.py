"""Counter-snapshot operators: latest / past values, growth ranking,
change detection, de-duplication.

Snapshots are ``(repository_id, event_time, <counters>, pushed_at, score)``
rows, optionally with extra tie-break columns (``order_cols``) when
``event_time`` is not unique per repository. Aggregating reads (growth,
latest/past counters, recently pushed) are one pass with a single exchange
on ``repository_id`` and map-side partial aggregation; per-key top-1 reads
are WindowGroupLimit; ordered per-repository work (history positions,
change detection) runs per (repository, day) bucket. A repository holding
a third of all rows is therefore never one giant group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposcope.functions.ordinal import rank_within
from reposcope.functions.time import col_type, minus_days, month_key, to_datetime, ts_lit

STAT_COLS = ("stargazers_count", "watchers_count", "forks_count", "open_issues_count", "pushed_at", "score")
STATE_COLS = ("repository_id", "stargazers_count", "watchers_count", "forks_count", "open_issues_count")


def _order_key(order_cols: Sequence[str]) -> Column:
    """Total time order: a scalar when the time is unique, else a struct."""
    if len(order_cols) == 1:
        return F.col(order_cols[0])
    return F.struct(*[F.col(c) for c in order_cols])


def latest_counters(stats: DataFrame, order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """``argMax(counter, event_time)`` per repository over all rows."""
    key = _order_key(order_cols)
    return stats.groupBy("repository_id").agg(
        F.max_by("stargazers_count", key).alias("latest_stars"),
        F.max_by("forks_count", key).alias("latest_forks"),
    )


def past_counters(stats: DataFrame, cutoff, order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """``argMax`` per repository over rows at or before ``cutoff``.

    The filter is on the time column, so it reaches the Parquet scan as a
    pushed data filter.
    """
    key = _order_key(order_cols)
    cut = ts_lit(cutoff, col_type(stats, "event_time"))
    rows = stats.where(F.col("event_time") <= cut)
    if "event_month" in stats.columns:
        # Stored snapshots are partitioned by month: prune whole partitions.
        month = to_datetime(cutoff).strftime("%Y%m")
        numeric = not isinstance(col_type(stats, "event_month"), T.StringType)
        rows = rows.where(F.col("event_month") <= F.lit(int(month) if numeric else month))
    return rows.groupBy("repository_id").agg(
        F.max_by("stargazers_count", key).alias("past_stars"),
        F.max_by("forks_count", key).alias("past_forks"),
    )


def growth_table(stats: DataFrame, cutoff, order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """Latest and past counters in ONE aggregate (one scan, one exchange).

    The past value is ``max_by`` with an ordering that is null after the
    cutoff; ``max_by`` skips null orderings, so it equals ``argMax`` over the
    filtered rows. ``has_past`` marks repositories with a snapshot at or
    before the cutoff (the inner join of the two-CTE form).
    """
    key = _order_key(order_cols)
    cut = ts_lit(cutoff, col_type(stats, "event_time"))
    in_past = F.col("event_time") <= cut
    past_key = F.when(in_past, key)
    return stats.groupBy("repository_id").agg(
        F.max_by("stargazers_count", key).alias("latest_stars"),
        F.max_by("forks_count", key).alias("latest_forks"),
        F.max_by("stargazers_count", past_key).alias("past_stars"),
        F.max_by("forks_count", past_key).alias("past_forks"),
        F.max(in_past).alias("has_past"),
    )


def trending_growth(stats: DataFrame, as_of, days: int = 30, limit: int = 200,
                    order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """Repositories ranked by star+fork growth since ``as_of - days``.

    Kept: a snapshot exists at or before the cutoff and stars or forks went
    up; one of the two may go down (signed growth). Order: growth desc,
    repository_id asc. ``limit`` is the list length (a top-k report), planned
    as TakeOrderedAndProject: each task keeps its local top ``limit``.
    → repository_id, star_growth, fork_growth, growth, rank
    """
    g = growth_table(stats, minus_days(as_of, days), order_cols)
    ranked = (g.where(F.col("has_past") & ((F.col("latest_stars") > F.col("past_stars"))
                                           | (F.col("latest_forks") > F.col("past_forks"))))
              .select("repository_id",
                      (F.col("latest_stars") - F.col("past_stars")).alias("star_growth"),
                      (F.col("latest_forks") - F.col("past_forks")).alias("fork_growth"))
              .withColumn("growth", F.col("star_growth") + F.col("fork_growth"))
              .orderBy(F.desc("growth"), F.asc("repository_id"))
              .limit(limit))
    # ``limit`` rows at most: a single-partition window here is bounded.
    w = Window.orderBy(F.desc("growth"), F.asc("repository_id"))
    return ranked.withColumn("rank", F.row_number().over(w).cast("bigint"))


def _pick_one(stats: DataFrame, order_cols: Sequence[str], latest: bool) -> DataFrame:
    """Whole latest (or earliest) row per repository.

    A window with ``row_number() = 1`` is planned as a WindowGroupLimit
    before the exchange, so only one candidate row per repository and input
    partition is shuffled.
    """
    order = [F.desc(c) if latest else F.asc(c) for c in order_cols]
    w = Window.partitionBy("repository_id").orderBy(*order)
    return stats.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def latest_stat(stats: DataFrame, order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """Newest snapshot per repository (``ORDER BY event_time DESC LIMIT 1``)."""
    return _pick_one(stats, order_cols, latest=True)


def first_stat(stats: DataFrame, order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """Oldest snapshot per repository (the feed's ``stats[len-1]``)."""
    return _pick_one(stats, order_cols, latest=False)


def last_update(stats: DataFrame) -> DataFrame:
    """→ repository_id, event_time (the newest snapshot time)."""
    return stats.groupBy("repository_id").agg(F.max("event_time").alias("event_time"))


def stats_history(stats: DataFrame, ids: DataFrame | None = None,
                  order_cols: Sequence[str] = ("event_time",), bucket: str = "day") -> DataFrame:
    """Every snapshot, newest first per repository, with its position ``rn``.

    ``ids`` (a DataFrame with ``repository_id``) restricts the repositories
    by a semi join; a literal id filter is simply ``where`` on the input.
    Positions are computed per (repository, ``bucket`` of event_time) plus
    the counts of newer buckets, so one busy repository is not sorted in a
    single task.
    """
    if ids is not None:
        stats = stats.join(ids.select("repository_id").distinct(), "repository_id", "left_semi")
    return rank_within(stats, ["repository_id"], [F.desc(c) for c in order_cols],
                       F.date_trunc(bucket, "event_time"), bucket_desc=True, name="rn")


def recently_pushed(stats: DataFrame, since, order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """Repositories whose LATEST snapshot has ``pushed_at > since``.

    Every row tied on the newest time counts (tuple ``IN`` semantics): the
    max of ``(event_time, pushed_at)`` is the newest time with the greatest
    ``pushed_at`` among its ties, so one aggregate decides exactly.
    → repository_id
    """
    s = ts_lit(since, col_type(stats, "pushed_at"))
    latest = stats.groupBy("repository_id").agg(
        F.max(F.struct("event_time", "pushed_at")).alias("_m"))
    return latest.where(F.col("_m.pushed_at") > s).select("repository_id")


def state_hash(stats: DataFrame, state_cols: Sequence[str] = STATE_COLS) -> DataFrame:
    """Add ``row_hash``: a 64-bit hash of the state columns, as text.

    Only equality matters; the hash is for storage and quick checks. Exact
    operators compare the state columns themselves.
    """
    return stats.withColumn("row_hash", F.xxhash64(*[F.col(c) for c in state_cols]).cast("string"))


def snapshots_changed(incoming: DataFrame, latest: DataFrame | None = None,
                      state_cols: Sequence[str] = STATE_COLS,
                      order_cols: Sequence[str] = ("event_time",), bucket: str = "day") -> DataFrame:
    """Rows to append: a snapshot is kept only when its state differs from
    the previous one of the same repository (A→B→A keeps all three).

    Comparing with the direct predecessor is exact (a skipped row equals the
    last kept one). The predecessor comes from ``lag`` inside (repository,
    ``bucket`` of event_time); the first row of a bucket takes the last
    state of the repository's previous non-empty bucket (a partial
    aggregate per bucket, then a ``lag`` over the few buckets of a
    repository), and the first row overall takes ``latest`` — the stored
    newest state per repository, e.g. ``latest_stat(stored)`` — through a
    left join. No task sorts a repository's whole history, and the keyed
    state across batches is a table, not driver memory.
    """
    keyless = [c for c in state_cols if c != "repository_id"]
    key = _order_key(order_cols)
    x = incoming.withColumn("_b", F.date_trunc(bucket, "event_time"))
    w = Window.partitionBy("repository_id", "_b").orderBy(*[F.asc(c) for c in order_cols])
    x = x.select("*", F.struct(*[F.lag(c).over(w).alias(c) for c in keyless]).alias("_prev"),
                 (F.row_number().over(w) == 1).alias("_first_in_bucket"))
    last = x.groupBy("repository_id", "_b").agg(
        F.max_by(F.struct(*[F.col(c) for c in keyless]), key).alias("_last"))
    wb = Window.partitionBy("repository_id").orderBy("_b")
    boundary = last.select("repository_id", "_b", F.lag("_last").over(wb).alias("_before"))
    if latest is not None:
        stored = latest.select("repository_id", F.struct(*[F.col(c) for c in keyless]).alias("_stored"))
        boundary = boundary.join(stored, "repository_id", "left").select(
            "repository_id", "_b", F.coalesce("_before", "_stored").alias("_before"))
    x = x.join(boundary, ["repository_id", "_b"], "left")
    prev = F.when(F.col("_first_in_bucket"), F.col("_before")).otherwise(F.col("_prev"))
    same = F.lit(True)
    for c in keyless:
        same = same & F.col(c).eqNullSafe(prev[c])
    keep = prev.isNull() | ~same
    return x.where(keep).select(*incoming.columns)


def _first_of_state(stats: DataFrame, state_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*state_cols).orderBy(*[F.asc(c) for c in order_cols])
    return stats.withColumn("_rn", F.row_number().over(w))


def dedupe_global(stats: DataFrame, state_cols: Sequence[str] = STATE_COLS,
                  order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """First occurrence of each state over the whole table (A→B→A keeps
    A, B). The state columns include the repository id, so a group is one
    repository's repeated state. Planned as WindowGroupLimit (k=1) before
    the exchange: one row per state and input partition is shuffled.
    """
    return _first_of_state(stats, state_cols, order_cols).where(F.col("_rn") == 1).drop("_rn")


def dedupe_check(stats: DataFrame, state_cols: Sequence[str] = STATE_COLS,
                 order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """→ n_before, n_after (one row): rows and distinct states, counted with
    partial aggregation (a state that repeats is one row per task)."""
    x = stats.groupBy(*state_cols).agg(F.count(F.lit(1)).alias("_n"))
    return x.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_before"), F.count(F.lit(1)).alias("n_after"))


def state_repeats(stats: DataFrame, state_cols: Sequence[str] = STATE_COLS) -> DataFrame:
    """Add ``n_same``: how many rows have the row's ``row_hash``. The counts
    are aggregated partially and joined back."""
    x = state_hash(stats, state_cols)
    return x.join(x.groupBy("row_hash").agg(F.count(F.lit(1)).alias("n_same")), "row_hash")


def with_event_month(stats: DataFrame) -> DataFrame:
    """Add the ``yyyyMM`` partition column used by the snapshot sink."""
    return stats.withColumn("event_month", month_key(F.col("event_time")))


def snapshots_by_month(stats: DataFrame) -> DataFrame:
    """→ event_month, n_snapshots, sum_stars (per-month volume)."""
    return (with_event_month(stats).groupBy("event_month")
            .agg(F.count(F.lit(1)).alias("n_snapshots"),
                 F.sum("stargazers_count").alias("sum_stars")))
