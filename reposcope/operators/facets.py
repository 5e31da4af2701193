"""Facet filters over ranked lists: OR within a facet, AND across facets.

Facet values are a short user request, so they stay literals: ``isin``
reaches the bridge scan as a pushed filter and each facet becomes a left
semi join, which keeps the left side's order column and duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.functions.ordinal import global_rank

CHUNK = 100_000


def parse_facets(text: Column) -> Column:
    """Request parameter → sorted list: split on ``,``; a lone empty string
    (or a missing parameter) is the empty list; inner empties are kept."""
    parts = F.split(text, ",", -1)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")) \
        .otherwise(F.array_sort(parts))


def facet_filter(ranked: DataFrame, langs: DataFrame, tags: DataFrame, topics: DataFrame,
                 languages: Sequence[str] = (), tag_names: Sequence[str] = (),
                 topic_names: Sequence[str] = (), id_col: str = "repository_id") -> DataFrame:
    """Keep rows of ``ranked`` whose id has at least one requested value in
    every non-empty facet. All facets empty → input unchanged. Matching is
    case-sensitive."""
    out = ranked
    for bridge, col, names in ((langs, "language", languages), (tags, "tag", tag_names),
                               (topics, "topic", topic_names)):
        if names:
            members = bridge.where(F.col(col).isin(list(names))).select(
                F.col("repository_id").alias(id_col))
            out = out.join(members, id_col, "left_semi")
    return out


def top_unseen(ranked: DataFrame, seen: DataFrame, sessions: DataFrame,
               offset: int, n: int, rank_col: str = "rank") -> DataFrame:
    """Per session, positions ``offset+1 .. offset+n`` of a shared ranked
    list after removing what the session has seen.

    ``ranked`` holds (repository_id, rank) with ranks 1..N. A session that
    has seen k listed items needs at most ranks 1..offset+n+k, so those
    candidate ranks are generated per session and equi-joined to the list
    on the rank — work grows with the requested window and the seen set,
    never with sessions × list. → session_id, position, repository_id, rank
    """
    seen_d = seen.select("session_id", "repository_id").distinct()
    k = (seen_d.join(ranked.select("repository_id"), "repository_id")
         .groupBy("session_id").agg(F.count(F.lit(1)).alias("_k")))
    c = (window_ranks(sessions, k, offset, n, rank_col).join(ranked, rank_col)
         .join(seen_d, ["session_id", "repository_id"], "left_anti"))
    return page_of(c, offset, n, rank_col)


def window_ranks(sessions: DataFrame, k: DataFrame, offset: int, n: int, rank_col: str) -> DataFrame:
    """Every session's candidate ranks 1 .. offset + n + k, where ``k``
    (session_id, _k) counts the listed rows that it has seen."""
    s = sessions.select("session_id").distinct().join(k, "session_id", "left")
    upper = (F.lit(offset + n) + F.coalesce(F.col("_k"), F.lit(0))).cast("bigint")
    # Candidate ranks are generated in chunks spread over tasks, so a
    # session that has seen a huge part of the list is not expanded by one task.
    chunk = F.lit(CHUNK).cast("bigint")
    chunks = s.select("session_id", upper.alias("_u"),
                      F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((upper - 1) / chunk).cast("bigint")))
                      .alias("_c")).repartition("session_id", "_c")
    return chunks.select("session_id", F.explode(F.sequence(
        F.col("_c") * chunk + 1, F.least((F.col("_c") + 1) * chunk, F.col("_u")))).alias(rank_col))


def page_of(candidates: DataFrame, offset: int, n: int, rank_col: str) -> DataFrame:
    """Positions offset + 1 .. offset + n of each session's candidates by rank."""
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy(rank_col))
    c = candidates.withColumn("position", pos.cast("bigint"))
    return c.where((F.col("position") > offset) & (F.col("position") <= offset + n))


def recent_crawled_list(repos: DataFrame, langs: DataFrame, tags: DataFrame, topics: DataFrame,
                        seen: DataFrame, sessions: DataFrame, languages: Sequence[str] = (),
                        tag_names: Sequence[str] = (), topic_names: Sequence[str] = (),
                        limit: int = 100) -> DataFrame:
    """Per session: facet-filtered repositories not seen by the session,
    newest crawl first (ties: id), first ``limit``.
    → session_id, position, repository_id, last_crawled_at
    """
    base = repos.select(F.col("id").alias("repository_id"), "last_crawled_at")
    f = facet_filter(base, langs, tags, topics, languages, tag_names, topic_names)
    ranked = global_rank(f, [F.desc("last_crawled_at"), F.asc("repository_id")])
    return top_unseen(ranked, seen, sessions, 0, limit).select(
        "session_id", "position", "repository_id", "last_crawled_at")
