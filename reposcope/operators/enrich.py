"""Enriched repository records: repository ⋈ owner ⟕ licence ⟕ children.

The three child bridges (tags, topics, languages) are folded in ONE
aggregate over their union, so the plan has one exchange on the repository
id for all children instead of three aggregates and three joins. Owners and
licences are dimension joins; Spark broadcasts them only when their
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE
re-checks at run time), otherwise it shuffles, with AQE splitting a skewed
owner key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.languages import primary_of_map
from reposcope.functions.time import col_type, ts_lit


def _empty_str_array() -> Column:
    return F.array().cast("array<string>")


_LANG_STRUCT = "array<struct<language:string,size:bigint>>"


def child_lists(tags: DataFrame, topics: DataFrame, langs: DataFrame,
                ids: DataFrame | None = None) -> DataFrame:
    """Per repository: sorted tags, sorted topics, languages (sorted list
    and map). Bridges are keyed by (repository_id, name), so map keys are
    unique. ``ids`` (column ``id``) semi-joins the bridges BEFORE the
    aggregate, which Catalyst does not infer for ids held in a DataFrame.
    → repository_id, tags, topics, language_list, languages
    """
    def part(df: DataFrame, kind: str, name: str, size: Column | None) -> DataFrame:
        return df.select("repository_id", F.lit(kind).alias("_kind"), F.col(name).alias("_name"),
                         (size if size is not None else F.lit(None)).cast("bigint").alias("_size"))

    u = reduce(DataFrame.unionByName, [
        part(tags, "tag", "tag", None),
        part(topics, "topic", "topic", None),
        part(langs, "lang", "language", F.col("size")),
    ])
    if ids is not None:
        u = u.join(ids.select(F.col("id").alias("repository_id")).distinct(), "repository_id", "left_semi")
    kind = F.col("_kind")
    lang = F.struct(F.col("_name").alias("language"), F.col("_size").alias("size"))
    agg = u.groupBy("repository_id").agg(
        F.array_distinct(F.sort_array(F.collect_list(F.when(kind == "tag", F.col("_name"))))).alias("tags"),
        F.array_distinct(F.sort_array(F.collect_list(F.when(kind == "topic", F.col("_name"))))).alias("topics"),
        F.sort_array(F.collect_list(F.when(kind == "lang", lang))).alias("_langs"),
    )
    # A duplicated (repository, language) row would make map_from_entries
    # fail; the list is sorted by (language, size), so keep each language's
    # last (largest) entry.
    n = F.size("_langs")
    last_of_key = F.filter("_langs", lambda x, i: (i == n - 1) | (
        F.element_at("_langs", (i + 2).cast("int"))["language"] != x["language"]))
    return (agg.withColumn("language_list", last_of_key).drop("_langs")
            .withColumn("languages", F.map_from_entries("language_list")))


def enrich(repos: DataFrame, owners: DataFrame, licenses: DataFrame, tags: DataFrame,
           topics: DataFrame, langs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Enriched repositories. A repository whose owner is missing drops out
    (inner join); a missing licence leaves the licence columns null; no
    children → empty arrays / map. ``ids`` restricts to requested ids.
    """
    r = repos
    if ids is not None:
        r = r.join(ids.select("id").distinct(), "id", "left_semi")
    o = owners.select(F.col("id").alias("owner_id"), F.col("login").alias("owner_login"),
                      F.col("avatar_url").alias("owner_avatar_url"),
                      F.col("html_url").alias("owner_html_url"), F.col("type").alias("owner_type"))
    lic = licenses.select(F.col("key").alias("license_key"), F.col("name").alias("license_name"),
                          F.col("spdx_id").alias("license_spdx_id"), F.col("url").alias("license_url"))
    kids = child_lists(tags, topics, langs, ids).withColumnRenamed("repository_id", "id")
    out = (r.join(o, "owner_id", "inner")
           .join(lic, "license_key", "left")
           .join(kids, "id", "left"))
    return (out.withColumn("tags", F.coalesce("tags", _empty_str_array()))
            .withColumn("topics", F.coalesce("topics", _empty_str_array()))
            .withColumn("language_list", F.coalesce("language_list", F.array().cast(_LANG_STRUCT)))
            .withColumn("languages", F.coalesce("languages", F.map_from_entries(F.array().cast(_LANG_STRUCT))))
            .withColumn("language", primary_of_map(F.col("languages"))))


def languages_text(language_list: Column) -> Column:
    """``lang:size`` pairs joined by commas (sorted by language)."""
    return F.concat_ws(",", F.transform(language_list, lambda x: F.concat(
        x["language"], F.lit(":"), x["size"].cast("string"))))


def flat(enriched: DataFrame) -> DataFrame:
    """Flat projection for reports: arrays joined to sorted text."""
    return enriched.select(
        "id", "name", "full_name", "owner_login", "license_name",
        F.concat_ws(",", "tags").alias("tags"),
        F.concat_ws(",", "topics").alias("topics"),
        languages_text(F.col("language_list")).alias("languages"),
        "created_at", "last_crawled_at",
    )


def repositories_by_ids(enriched: DataFrame, ids: DataFrame) -> DataFrame:
    """Multi-get: requested ids with their ``rank`` kept; ids without a
    record are absent. → enriched columns + rank, ordered by rank."""
    return (ids.select(F.col("repository_id").alias("id"), "rank")
            .join(enriched, "id", "inner"))


def repository_ids_page(repos: DataFrame, limit: int, offset: int) -> DataFrame:
    """``ORDER BY id LIMIT n OFFSET o``: a top-(o+n) per task, then offset."""
    return repos.select("id").orderBy("id").offset(offset).limit(limit)


def crawled_since(repos: DataFrame, since) -> DataFrame:
    return repos.where(F.col("last_crawled_at") >= ts_lit(since, col_type(repos, "last_crawled_at"))).select("id")
