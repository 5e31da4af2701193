"""Landed-record decoding and crawl-side rules.

The reference fetches search pages, tag lists, language maps and README
locators over HTTP; here those bodies are landed JSON text (one record per
row) decoded with ``from_json`` against fixed schemas — no schema
inference, no per-row Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.time import ts_lit

# README file names probed, in order; the first found wins.
README_NAMES = ("README.md", "README.txt")


def needs_crawl(discovered: DataFrame, repos: DataFrame) -> DataFrame:
    """Crawl gate: crawl unless ``pushed_at < last_crawled_at``; equal
    times crawl; a repository never crawled (no stored row) crawls.
    ``discovered`` has ``repository_id`` and ``pushed_at``.
    → discovered columns + last_crawled_at, needs_crawl"""
    stored = repos.select(F.col("id").alias("repository_id"), "last_crawled_at")
    x = discovered.join(stored, "repository_id", "left")
    return x.withColumn("needs_crawl",
                        F.coalesce(F.col("pushed_at") >= F.col("last_crawled_at"), F.lit(True)))


def readme_candidates(repos: DataFrame, probes: DataFrame, base: str,
                      names: Sequence[str] = README_NAMES) -> DataFrame:
    """README URL ``{base}/{full_name}/{branch}/{name}``: the first name in
    ``names`` whose landed probe says found; none found → null.
    ``probes`` holds (repository_id, name, found).
    → repository_id, readme_url"""
    order = F.array(*[F.lit(n) for n in names])
    idx = F.array_position(order, F.col("name"))
    best = (probes.where(F.col("found") & (idx > 0))
            .groupBy("repository_id").agg(F.min(idx).alias("_idx")))
    r = repos.select(F.col("id").alias("repository_id"), "full_name", "default_branch")
    url = F.when(F.col("_idx").isNotNull(), F.concat_ws(
        "/", F.lit(base.rstrip("/")), "full_name", "default_branch", F.element_at(order, F.col("_idx").cast("int"))))
    return r.join(best, "repository_id", "left").select("repository_id", url.alias("readme_url"))


def object_key(repository_id: Column) -> Column:
    """Object-store key of a README body."""
    return F.format_string("readmes/%d.md", repository_id)


def key_to_id(key: Column) -> Column:
    """Inverse of ``object_key`` (null when the key does not match)."""
    return F.regexp_extract(key, r"readmes/(\d+)\.md$", 1).try_cast("bigint")


# -- landed JSON bodies ---------------------------------------------------------------------

OWNER_T = ("struct<login:string,id:bigint,node_id:string,avatar_url:string,html_url:string,"
           "type:string,site_admin:boolean>")
LICENSE_T = "struct<key:string,name:string,spdx_id:string,url:string,node_id:string>"
REPO_T = (
    "struct<id:bigint,node_id:string,name:string,full_name:string,owner:" + OWNER_T + ","
    "private:boolean,html_url:string,description:string,fork:boolean,url:string,created_at:string,"
    "updated_at:string,pushed_at:string,homepage:string,size:bigint,stargazers_count:bigint,"
    "watchers_count:bigint,language:string,forks_count:bigint,open_issues_count:bigint,"
    "default_branch:string,score:double,topics:array<string>,archived:boolean,disabled:boolean,"
    "visibility:string,license:" + LICENSE_T + ",allow_forking:boolean,is_template:boolean,"
    "readme_url:string,tags:array<string>,languages:map<string,bigint>>"
)
SEARCH_PAGE_T = f"struct<total_count:bigint,incomplete_results:boolean,items:array<{REPO_T}>>"
TAGS_T = "array<struct<name:string>>"
LANGUAGES_T = "map<string,bigint>"


def nullable_text(c: Column) -> Column:
    """A nullable string given either plainly (string / null) or in the
    serialised wrapper form ``{"String": s, "Valid": b}`` (``from_json``
    hands an object in a string field back as its JSON text)."""
    valid = F.get_json_object(c, "$.Valid")
    wrapped = c.startswith("{") & valid.isNotNull()
    return F.when(wrapped, F.when(valid == "true", F.get_json_object(c, "$.String"))).otherwise(c)


def parse_time(c: Column) -> Column:
    """RFC 3339 text → UTC wall-clock ``timestamp_ntz`` (null if invalid)."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def flatten_repository(r: Column) -> list[Column]:
    """One select over a decoded repository record; optional fields are
    unwrapped, times parsed."""
    return [
        r["id"].alias("id"),
        nullable_text(r["node_id"]).alias("node_id"),
        r["name"].alias("name"),
        r["full_name"].alias("full_name"),
        r["owner"]["id"].alias("owner_id"),
        r["owner"]["login"].alias("owner_login"),
        nullable_text(r["description"]).alias("description"),
        r["html_url"].alias("html_url"),
        nullable_text(r["homepage"]).alias("homepage"),
        r["default_branch"].alias("default_branch"),
        nullable_text(r["language"]).alias("language"),
        nullable_text(r["license"]["key"]).alias("license_key"),
        nullable_text(r["license"]["name"]).alias("license_name"),
        r["stargazers_count"].alias("stargazers_count"),
        r["watchers_count"].alias("watchers_count"),
        r["forks_count"].alias("forks_count"),
        r["open_issues_count"].alias("open_issues_count"),
        parse_time(r["created_at"]).alias("created_at"),
        parse_time(r["pushed_at"]).alias("pushed_at"),
        r["score"].alias("score"),
        F.coalesce(r["topics"], F.array().cast("array<string>")).alias("topics"),
        F.coalesce(r["archived"], F.lit(False)).alias("is_archived"),
        F.coalesce(r["disabled"], F.lit(False)).alias("is_disabled"),
        nullable_text(r["readme_url"]).alias("readme_url"),
    ]


def ingest_search_pages(pages: DataFrame, body_col: str = "body") -> DataFrame:
    """Landed search pages ``{total_count, incomplete_results, items[]}`` →
    one flat row per repository item (+ total_count). Unparseable bodies
    give no rows."""
    p = pages.select(F.from_json(F.col(body_col), SEARCH_PAGE_T).alias("p"))
    items = p.where(F.col("p.items").isNotNull()).select(
        F.col("p.total_count").alias("total_count"), F.explode("p.items").alias("r"))
    return items.select(*flatten_repository(F.col("r")), "total_count")


def latest_landed(landed: DataFrame, body_col: str = "body") -> DataFrame:
    """One landed body per repository: the one of highest ``seq`` (crawl
    order), ties by the body itself; without a ``seq`` column the highest
    body. → repository_id, body column"""
    order = F.struct(*[F.col(c) for c in ("seq", body_col) if c in landed.columns])
    return landed.groupBy("repository_id").agg(F.max_by(body_col, order).alias(body_col))


def ingest_tags(landed: DataFrame, body_col: str = "body") -> DataFrame:
    """``[{"name": …}, …]`` → repository_id, tags (array, order kept)."""
    arr = F.from_json(F.col(body_col), TAGS_T)
    return (landed.select("repository_id", arr.alias("_a")).where(F.col("_a").isNotNull())
            .select("repository_id", F.transform("_a", lambda x: x["name"]).alias("tags")))


def ingest_language_maps(landed: DataFrame, body_col: str = "body") -> DataFrame:
    """``{"Go": bytes, …}`` → repository_id, languages (map; ``{}`` is a
    repository without languages, not a missing body)."""
    m = F.from_json(F.col(body_col), LANGUAGES_T)
    return landed.select("repository_id", m.alias("languages")).where(F.col("languages").isNotNull())


def ingest_languages(landed: DataFrame, body_col: str = "body") -> DataFrame:
    """``{"Go": bytes, …}`` → repository_id, language, size (one row each)."""
    m = F.from_json(F.col(body_col), LANGUAGES_T)
    return (landed.select("repository_id", F.explode(m).alias("language", "size")))


def ingest_readme_url(landed: DataFrame, body_col: str = "body") -> DataFrame:
    """README locator ``{"download_url": …}`` → repository_id, download_url."""
    return landed.select("repository_id",
                         F.get_json_object(F.col(body_col), "$.download_url").alias("download_url"))


def crawl_results(discovered: DataFrame, tags: DataFrame, languages: DataFrame,
                  readme_urls: DataFrame, crawled_at) -> DataFrame:
    """Crawl envelope: discovery rows (``repository_id`` …) plus README URL,
    tags and language sizes, stamped with ``crawled_at``.

    Tags and languages are required — the crawler requeues a message whose
    tag or language fetch failed, so a repository without landed bodies is
    not emitted yet (inner joins); an empty tag list or language map is a
    body like any other. The README URL is optional (left join). ``tags``:
    (repository_id, tags array); ``languages``: (repository_id, languages
    map); one row per repository each (``latest_landed`` picks the newest of
    several crawls); ``readme_urls``: (repository_id, readme_url).
    → discovered columns + readme_url, tags, languages, crawled_at"""
    return (discovered.join(tags.select("repository_id", "tags"), "repository_id")
            .join(languages.select("repository_id", "languages"), "repository_id")
            .join(readme_urls.select("repository_id", "readme_url"), "repository_id", "left")
            .withColumn("crawled_at", ts_lit(crawled_at)))
