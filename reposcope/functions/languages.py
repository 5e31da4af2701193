"""Language rules of the feed cards: primary language, shares, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The card colour per language name; anything else is grey.
LANGUAGE_COLORS = {
    "TypeScript": "#3178c6",
    "JavaScript": "#f1e05a",
    "Python": "#3572A5",
    "Java": "#b07219",
    "Ruby": "#701516",
    "Go": "#00ADD8",
    "Rust": "#dea584",
    "C": "#555555",
    "C++": "#f34b7d",
    "C#": "#178600",
    "PHP": "#4F5D95",
    "Swift": "#ffac45",
    "Kotlin": "#A97BFF",
    "Dart": "#00B4AB",
    "Shell": "#89e051",
    "HTML": "#e34c26",
    "CSS": "#563d7c",
    "Vue": "#41b883",
    "Svelte": "#ff3e00",
    "React": "#61dafb",
}
DEFAULT_COLOR = "#808080"


def palette_frame(spark: SparkSession, palette: dict[str, str] | None = None) -> DataFrame:
    """The colour table as a tiny dimension (fixed size → safe to broadcast)."""
    items = sorted((palette or LANGUAGE_COLORS).items())
    return spark.createDataFrame(items, "language string, color string")


def color_of(language: Column, palette: dict[str, str] | None = None) -> Column:
    """Inline lookup for a single column (a literal map, no join)."""
    pal = palette or LANGUAGE_COLORS
    m = F.create_map(*[F.lit(x) for kv in sorted(pal.items()) for x in kv])
    return F.coalesce(F.element_at(m, language), F.lit(DEFAULT_COLOR))


def primary_language(langs: DataFrame) -> DataFrame:
    """Largest language per repository; ties go to the greatest name.

    → repository_id, language. Repositories without languages are absent
    here; callers left-join and default to ``'Unknown'``.
    """
    return langs.groupBy("repository_id").agg(
        F.max_by("language", F.struct("size", "language")).alias("language"))


def primary_of_map(languages: Column, stored: Column | None = None) -> Column:
    """Same rule on a map column: stored value, else argmax, else Unknown."""
    entries = F.map_entries(languages)
    best = F.aggregate(
        entries, F.lit(None).cast("struct<key:string,value:bigint>"),
        lambda acc, x: F.when(acc.isNull() | (x["value"] > acc["value"])
                              | ((x["value"] == acc["value"]) & (x["key"] > acc["key"])), x)
        .otherwise(acc))
    out = F.coalesce(best["key"], F.lit("Unknown"))
    return F.coalesce(stored, out) if stored is not None else out


def language_share(langs: DataFrame) -> DataFrame:
    """Percentage of each language in its repository (only when the sum > 0).

    The per-repository total is a partial aggregate joined back, not a
    window, so a repository with very many rows is never sorted in one task.
    → repository_id, language, size, share
    """
    total = langs.groupBy("repository_id").agg(F.sum("size").alias("_total"))
    return (langs.join(total.where(F.col("_total") > 0), "repository_id")
            .withColumn("share", F.col("size") / F.col("_total") * 100)
            .drop("_total"))


def language_color(langs: DataFrame, palette: dict[str, str] | None = None) -> DataFrame:
    """Colour per (repository, language); unknown languages are grey.
    The palette is a literal map (fixed size), so no join is needed.
    → repository_id, language, color"""
    return langs.select("repository_id", "language", color_of(F.col("language"), palette).alias("color"))
