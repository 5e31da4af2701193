"""Composite jobs built from the operators (the reference's periodic runs)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reposcope.operators.publish import mark_posted, next_to_post, post_text
from reposcope.operators.snapshots import latest_stat, recently_pushed
from reposcope.sources.ingest import needs_crawl


def refresh_candidates(stats: DataFrame, repos: DataFrame, since) -> DataFrame:
    """Repositories to crawl again: latest snapshot pushed after ``since``,
    or latest discovery newer than the stored crawl (or never crawled).
    → repository_id"""
    latest = latest_stat(stats).select("repository_id", "event_time", "pushed_at")
    gate = needs_crawl(latest, repos).where("needs_crawl").select("repository_id")
    return recently_pushed(stats, since).unionByName(gate).distinct()


def posting_job(trending: DataFrame, enriched: DataFrame, posted: DataFrame, as_of, base_url: str,
                n: int = 1, limit_bytes: int = 270) -> tuple[DataFrame, DataFrame]:
    """One posting run: the first ``n`` unposted trending repositories with a
    record, their post texts, and the next version of the posted markers.
    → (posts: repository_id, rank, text; posted: repository_id, posted_at)"""
    picked = next_to_post(trending, enriched, posted, n)
    texts = post_text(enriched.join(picked.selectExpr("repository_id AS id"), "id", "left_semi"),
                      base_url, limit_bytes)
    return picked.join(texts, "repository_id"), mark_posted(posted, picked, as_of)
