"""What each session has seen, as stored bitmaps merged by batches of views.

(session_id, word, bits), see ``functions.bitmaps``: views of 64 neighbouring
repositories are one row, however often they are viewed. The table is a
``DeltaTable`` in buckets by session and word, so that a session with a third
of all views is spread over buckets and tasks by stretches of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions.bitmaps import as_words, has, ids_of, united, word_of
from reposcope.operators.facets import page_of, window_ranks
from reposcope.sources.delta_table import DeltaTable


def seen_words(views: DataFrame) -> DataFrame:
    """session_id, word, bits of a log of views; views without a repository are left out."""
    return as_words(views, ["session_id"], "repository_id")


def seen_table(spark: SparkSession, root: str, buckets: int = 32) -> DeltaTable:
    return DeltaTable(spark, root, ["session_id", "word"], buckets=buckets)


def update_seen(table: DeltaTable, seq: int, views: DataFrame) -> None:
    """Fold batch ``seq`` of views into the stored set, or start it. Batches may come in any order and again."""
    new = seen_words(views)
    if table.newest(before=seq) is None:
        table.create(new, seq)
    else:
        table.apply(seq, new, lambda now, more: united(now, more, ["session_id"]))


def seen_rows(words: DataFrame) -> DataFrame:
    """The set as rows: session_id, repository_id, each pair once."""
    return ids_of(words, "repository_id")


def top_unseen_stored(ranked: DataFrame, seen: DataFrame, sessions: DataFrame, offset: int, n: int, rank_col: str = "rank") -> DataFrame:
    """``facets.top_unseen`` with the seen set as words (session_id, word, bits).

    ``ranked`` holds each repository once. How many listed repositories a
    session has seen is counted on words met with the list's words; a
    candidate is looked up in the one word of its session that may hold it.
    → session_id, position, repository_id, rank
    """
    listed = as_words(ranked, [], "repository_id").withColumnRenamed("bits", "_listed")
    met = F.col("bits").bitwiseAND(F.col("_listed"))
    k = seen.join(listed, "word").where(met != 0).groupBy("session_id").agg(F.sum(F.bit_count(met)).alias("_k"))
    cand = window_ranks(sessions, k, offset, n, rank_col).join(ranked, rank_col).withColumn("_word", word_of(F.col("repository_id")))
    words = seen.select("session_id", F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    left = cand.join(words, ["session_id", "_word"], "left")
    left = left.where(F.col("_bits").isNull() | ~has(F.col("_bits"), F.col("repository_id"))).drop("_word", "_bits")
    return page_of(left, offset, n, rank_col)
