"""Session feeds: history, seen set, cold (trending) and personalised lists,
paging, card rows and detail records — for all sessions in one plan.

Per-session groups stay bounded: the history is a top-``history_limit``
per session (planned as WindowGroupLimit before the exchange, so even a
session holding a third of all views ships at most ``limit`` rows per input
partition), and a personalised candidate list has at most
``history_limit × list size`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposcope.functions.ordinal import global_rank
from reposcope.operators.facets import facet_filter, top_unseen
from reposcope.operators.snapshots import first_stat, latest_stat


def rfc3339(ts) -> "Column":
    """UTC time as JSON serialises it: RFC 3339 with the fractional second
    trimmed of trailing zeros (none when zero) and a ``Z`` suffix."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.regexp_replace(full, r"\.?0+Z$", "Z")


def session_views(events: DataFrame) -> DataFrame:
    """View log rows (session_id, repository_id, viewed_at); duplicates kept."""
    return events.select("session_id", "repository_id", "viewed_at")


def session_seen(views: DataFrame) -> DataFrame:
    """Seen set: distinct (session_id, repository_id)."""
    return views.select("session_id", "repository_id").distinct()


def session_history(views: DataFrame, limit: int = 15) -> DataFrame:
    """The ``limit`` most recent views per session, NOT distinct (a
    repository viewed 3× weighs 3×). → session_id, repository_id,
    viewed_at, rn"""
    w = Window.partitionBy("session_id").orderBy(F.desc("viewed_at"), F.desc("repository_id"))
    return (views.select("session_id", "repository_id", "viewed_at")
            .withColumn("rn", F.row_number().over(w).cast("bigint"))
            .where(F.col("rn") <= limit))


def feed_personalized(views: DataFrame, similarity: DataFrame, langs: DataFrame | None = None,
                      tags: DataFrame | None = None, topics: DataFrame | None = None,
                      languages: Sequence[str] = (), tag_names: Sequence[str] = (),
                      topic_names: Sequence[str] = (), page: int = 0, page_size: int = 50,
                      history_limit: int = 15) -> DataFrame:
    """History → similarity lists → summed score per candidate → facets →
    minus seen → page. Sessions whose history has no similarity rows get
    no rows (no fallback to trending). ``similarity`` is the long form
    (source_id, candidate_id, score). → session_id, rank, repository_id, score
    """
    hist = session_history(views, history_limit)
    sim = similarity.select(F.col("source_id").alias("repository_id"), "candidate_id", "score")
    cand = (hist.join(sim, "repository_id")
            .groupBy("session_id", F.col("candidate_id").alias("repository_id"))
            .agg(F.sum("score").alias("score")))
    if languages or tag_names or topic_names:
        cand = facet_filter(cand, langs, tags, topics, languages, tag_names, topic_names)
    cand = cand.join(session_seen(views), ["session_id", "repository_id"], "left_anti")
    w = Window.partitionBy("session_id").orderBy(F.desc("score"), F.asc("repository_id"))
    lo, hi = page * page_size, (page + 1) * page_size
    return (cand.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where((F.col("rank") > lo) & (F.col("rank") <= hi))
            .select("session_id", "rank", "repository_id", "score"))


def feed_trending(trending: DataFrame, views: DataFrame, sessions: DataFrame,
                  langs: DataFrame | None = None, tags: DataFrame | None = None,
                  topics: DataFrame | None = None, languages: Sequence[str] = (),
                  tag_names: Sequence[str] = (), topic_names: Sequence[str] = (),
                  page: int = 0, page_size: int = 50) -> DataFrame:
    """Cold feed: the growth list (already cut at its length BEFORE
    filtering) → facets (order kept) → minus each session's seen set →
    page. → session_id, rank, repository_id, growth"""
    lst = trending.select("repository_id", F.col("rank").alias("_trank"), "growth")
    if languages or tag_names or topic_names:
        lst = facet_filter(lst, langs, tags, topics, languages, tag_names, topic_names)
    # Dense ranks after filtering, numbered in parallel (any list length).
    lst = global_rank(lst, [F.asc("_trank")], name="rank")
    out = top_unseen(lst.select("repository_id", "rank", "growth"), session_seen(views), sessions,
                     page * page_size, page_size)
    return out.select("session_id", F.col("position").alias("rank"), "repository_id", "growth")


def feed(trending: DataFrame, views: DataFrame, similarity: DataFrame, sessions: DataFrame,
         page: int = 0, page_size: int = 50, history_limit: int = 15, **facets) -> DataFrame:
    """The list endpoint for the given sessions: personalised where a history
    exists, cold trending where it does not. → session_id, rank,
    repository_id, score, source"""
    views = views.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    has_hist = views.select("session_id").distinct()
    warm = feed_personalized(views, similarity, page=page, page_size=page_size,
                             history_limit=history_limit, **facets)
    cold_sessions = sessions.select("session_id").distinct().join(has_hist, "session_id", "left_anti")
    cold = feed_trending(trending, views, cold_sessions, page=page, page_size=page_size, **facets)
    return (warm.withColumn("source", F.lit("personalized"))
            .unionByName(cold.select("session_id", "rank", "repository_id",
                                     F.col("growth").cast("double").alias("score"))
                         .withColumn("source", F.lit("trending"))))


def feed_rows(ranked: DataFrame, enriched: DataFrame, stats: DataFrame, stat: str = "latest",
              order_cols: Sequence[str] = ("event_time",)) -> DataFrame:
    """Card rows for a ranked id list: enriched record + one snapshot
    (``latest`` by default, ``first`` = the oldest, as the list endpoint
    picks). Ids without a record are absent; without a snapshot the
    counters are 0 and ``pushed_at`` is ''.
    → rank, id, name, full_name, description, counters, pushed_at, urls,
      topics (first five), language, license_name, footer
    """
    ids = ranked.select("repository_id").distinct()
    st_in = stats.join(ids, "repository_id", "left_semi")
    st = latest_stat(st_in, order_cols) if stat == "latest" else first_stat(st_in, order_cols)
    st = st.select(F.col("repository_id").alias("id"), "stargazers_count", "forks_count",
                   "watchers_count", "open_issues_count", "pushed_at")
    e = enriched.join(ids.select(F.col("repository_id").alias("id")), "id", "left_semi")
    rows = (ranked.select(F.col("repository_id").alias("id"), "rank")
            .join(e, "id", "inner").join(st, "id", "left"))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "rank", "id", "name", "full_name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("stargazers_count", zero).alias("stargazers_count"),
        F.coalesce("forks_count", zero).alias("forks_count"),
        F.coalesce("watchers_count", zero).alias("watchers_count"),
        F.coalesce("open_issues_count", zero).alias("open_issues_count"),
        F.coalesce(rfc3339(F.col("pushed_at")), F.lit("")).alias("pushed_at"),
        F.concat("html_url", F.lit("/stargazers")).alias("stargazers_url"),
        F.concat("html_url", F.lit("/forks")).alias("forks_url"),
        F.concat_ws(",", F.slice("topics", 1, 5)).alias("topics"),
        "language",
        "license_name",
        F.concat_ws(" | ", "license_name", F.date_format("pushed_at", "yyyy-MM-dd")).alias("footer"),
    )


def repository_detail(enriched: DataFrame, stats: DataFrame, ids: DataFrame) -> DataFrame:
    """Detail records for requested ids (column ``id``): enriched record +
    the NEWEST snapshot (optional). Unknown ids give no row."""
    want = ids.select("id").distinct()
    e = enriched.join(want, "id", "left_semi")
    st = latest_stat(stats.join(want.select(F.col("id").alias("repository_id")), "repository_id",
                                "left_semi"))
    st = st.select(F.col("repository_id").alias("id"), "stargazers_count", "forks_count",
                   "watchers_count", "open_issues_count", "pushed_at",
                   F.col("event_time").alias("stat_time"))
    return e.join(st, "id", "left")
