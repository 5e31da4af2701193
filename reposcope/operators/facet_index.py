"""Facet filters over a stored index: the ids of every facet value as bitmaps.

The index holds (facet, value, word, bits), see ``functions.bitmaps``. A
request reads the words of its values only, unites the values of a facet and
meets the facets in one aggregate by word, before the list is looked at; the
bridges are not read. The table is kept by batches of bridge rows: a
``DeltaTable`` in buckets by (facet, value), so that a request opens the
buckets of its values and a batch writes those it changes. A value that a
third of all repositories have is a row per 64 of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions.bitmaps import as_words, has, united, word_of
from reposcope.sources.delta_table import DeltaTable

KEYS = ("facet", "value")


def facet_postings(langs: DataFrame, tags: DataFrame, topics: DataFrame) -> DataFrame:
    """facet (language, tag, topic), value, word, bits. Null values and ids match no request and are left out."""
    rows = [bridge.select(F.lit(name).alias("facet"), F.col(name).alias("value"), "repository_id")
            for bridge, name in ((langs, "language"), (tags, "tag"), (topics, "topic"))]
    return as_words(reduce(DataFrame.unionByName, rows).where(F.col("value").isNotNull()), KEYS, "repository_id")


def index_table(spark: SparkSession, root: str, buckets: int = 32) -> DeltaTable:
    return DeltaTable(spark, root, [*KEYS, "word"], by=KEYS, buckets=buckets)


def add_to_index(table: DeltaTable, seq: int, langs: DataFrame, tags: DataFrame, topics: DataFrame) -> None:
    """Fold batch ``seq`` of bridge rows into the stored index, or start it. A batch that runs again changes nothing."""
    new = facet_postings(langs, tags, topics)
    if table.newest(before=seq) is None:
        table.create(new, seq)
    else:
        table.apply(seq, new, lambda now, more: united(now, more, KEYS))


def remove_from_index(table: DeltaTable, seq: int, langs: DataFrame, tags: DataFrame, topics: DataFrame) -> None:
    """Take batch ``seq`` of bridge rows out of the stored index. Rows that it does not hold change nothing."""
    def rule(now: DataFrame, gone: DataFrame) -> DataFrame:
        gone = gone.withColumnRenamed("bits", "_gone")
        return now.join(gone, [*KEYS, "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not("_gone"))).drop("_gone")
    table.apply(seq, facet_postings(langs, tags, topics), rule)


def _asked(languages: Sequence[str], tag_names: Sequence[str], topic_names: Sequence[str]) -> dict[str, list[str]]:
    return {f: list(names) for f, names in (("language", languages), ("tag", tag_names), ("topic", topic_names)) if names}


def postings_of(table: DeltaTable, languages: Sequence[str] = (), tag_names: Sequence[str] = (), topic_names: Sequence[str] = ()) -> DataFrame:
    """The stored index, of it only the buckets that the requested values fall into."""
    asked = [(f, v) for f, names in _asked(languages, tag_names, topic_names).items() for v in names if v is not None]
    return table.read(buckets=table.buckets_of(table.spark.createDataFrame(asked, "facet string, value string")))


def matching_words(index: DataFrame, languages: Sequence[str] = (), tag_names: Sequence[str] = (), topic_names: Sequence[str] = ()) -> DataFrame:
    """word, bits of the ids that have a requested value in every facet asked for (one at least)."""
    asked = _asked(languages, tag_names, topic_names)
    if not asked:
        raise ValueError("no facet is asked for: every id matches")
    wanted = reduce(lambda a, b: a | b, [(F.col("facet") == f) & F.col("value").isin(names) for f, names in asked.items()])
    none = F.lit(0).cast("bigint")
    united_facets = [F.bit_or(F.when(F.col("facet") == f, F.col("bits")).otherwise(none)).alias(f"_{f}") for f in asked]
    met = reduce(lambda a, b: a.bitwiseAND(b), [F.col(f"_{f}") for f in asked])
    return index.where(wanted).groupBy("word").agg(*united_facets).select("word", met.alias("bits")).where("bits <> 0")


def facet_filter_indexed(ranked: DataFrame, index: DataFrame | DeltaTable, languages: Sequence[str] = (), tag_names: Sequence[str] = (),
                         topic_names: Sequence[str] = (), id_col: str = "repository_id") -> DataFrame:
    """``facets.facet_filter`` read from the index; the same rows, repeated ones included.

    All facets empty → input unchanged. Rows with a null id match nothing else.
    """
    request = (languages, tag_names, topic_names)
    if not any(request):
        return ranked
    words = matching_words(postings_of(index, *request) if isinstance(index, DeltaTable) else index, *request)
    words = words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    return (ranked.withColumn("_word", word_of(F.col(id_col))).join(words, "_word")
            .where(has(F.col("_bits"), F.col(id_col))).select(*ranked.columns))
