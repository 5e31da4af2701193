"""A training corpus from raw documents, as five stages.

Each stage takes the documents that its predecessor kept. All but the last
return the columns of documents, whatever further columns they have and
however these are named; the last returns the packed sequences. An empty table
gives no rows in any stage. The stages are written as Parquet to the shared
scratch folder and read again.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reposcope.llm.common import WORD, saved, table, word_count
from reposcope.llm.jaccard_join import jaccard_join
from reposcope.llm.mixing import mix
from reposcope.llm.packing import LENGTHS, pack
from reposcope.llm.quality import CUT, learn_ranking, quality_udf
from reposcope.llm.suffix_dedup import remove_repeats


def _whole(docs: DataFrame) -> Column:
    """All columns of the caller as one, so that no name of theirs meets a name used here."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Rows are kept or go as they are, null and empty texts by the score of no features."""
    model = learn_ranking(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_udf(model)(F.col("text")) >= CUT)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, a likeness of 0.8): the one of least id.

    Rows that repeat an id with another text are documents of their own; of
    equal rows one stays. Documents without words, and rows with a null id,
    are groups of their own. A document is known by a 64-bit hash of its id
    and text.
    """
    rows = docs.select(_whole(docs))
    some = rows.filter("_doc.doc_id IS NOT NULL").withColumn("_key", F.xxhash64("_doc.doc_id", "_doc.text"))
    groups = (jaccard_join(some.select("_key", F.col("_doc.text").alias("text")), size=5, threshold=(80, 100), id_col="_key")
              .select(F.col("doc_id").alias("_key"), "component_id").distinct())
    least = (some.select("_key", F.col("_doc.doc_id").alias("doc_id")).distinct().join(groups, "_key")
             .groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("_least")).select(F.col("_least._key").alias("_stays")))
    kept = some.join(least, some["_key"] == least["_stays"], "left_semi")
    own = Window.partitionBy("_key").orderBy("_doc.doc_id")
    kept = kept.withColumn("_nth", F.row_number().over(own)).filter("_nth = 1")
    return kept.select("_doc.*").unionByName(rows.filter("_doc.doc_id IS NULL").select("_doc.*"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that a smaller document has already.

    Characters that a cut splits go with it, and n_chars follows the text. A
    null text stays null; a text of which nothing remains becomes empty.
    """
    cut = remove_repeats(docs, as_text=True)
    # Equal rows have equal results: one of them is enough for the join.
    cut = (cut.groupBy("doc_id", "text_hash").agg(F.first("kept").alias("_kept"), F.max(F.size("span_begin")).alias("_spans"))
           .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_kept", "_spans"))
    rest = docs.select(_whole(docs.drop("text")), F.col("text").isNull().alias("_null"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    joined = rest.join(cut, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    text = F.when(~F.col("_null"), F.col("_kept"))
    out = {c: F.col("_doc").getField(c) for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return joined.select(*[out[c].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Of rows that repeat an id within a source and have as many words, each is
    taken as often as one of the places that the mix gives them, in order of
    their texts' hashes.
    """
    copies = mix(docs).withColumn("_place", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("copies")))
    copies = copies.filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
                                                "_place", F.col("copies").alias("_copies"))
    sized = docs.select(_whole(docs), word_count(F.col("text")).alias("_words"))
    own = Window.partitionBy("_doc.doc_id", "_doc.source", "_words").orderBy(F.xxhash64("_doc.text"))
    joined = sized.withColumn("_nth", F.row_number().over(own)).join(
        copies, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & F.col("_doc.source").eqNullSafe(F.col("_source"))
        & (F.col("_words") == F.col("_size")) & (F.col("_nth") == F.col("_place")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_doc.*")


def _words_from(longest: int):
    """The text from word piece * longest on to the next piece's first word; white space before the first word is the first piece's."""
    word = re.compile(WORD)

    @F.pandas_udf("string")
    def cut(text: pd.Series, piece: pd.Series) -> pd.Series:
        def one(t, k):
            if t is None:
                return None
            starts = [m.start() for m in word.finditer(t)]
            at = lambda i: 0 if i == 0 else starts[i] if i < len(starts) else len(t)
            return t[at(k * longest):at((k + 1) * longest)]
        return pd.Series([one(t, int(k)) for t, k in zip(text, piece)], dtype=object)
    return cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents packed into sequences of 512 to 8192 places, a place a word or the end mark of a document.

    One row per piece: doc_id, piece (from 0), length, bin_id, bin_offset,
    bin_capacity and text. The texts of a document's pieces, end to end, are
    its text. Documents without words (null and empty texts) give no row;
    rows that repeat an id, or have none, are packed each for itself; other
    columns go; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    # Copies of a document have equal texts: one row of them is joined to the pieces of all.
    texts = keyed.groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("_text"))
    longest = max(LENGTHS)
    pieces = pack(keyed, id_col="_key").withColumnRenamed("doc_id", "_key").join(texts, "_key")
    cut = F.when((F.col("piece") > 0) | (F.col("length") >= longest), F.col("_text"))
    return pieces.select("doc_id", "piece", "length", "bin_id", "bin_offset", "bin_capacity",
                         F.coalesce(_words_from(longest)(cut, "piece"), "_text").alias("text"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages are learnt, iterative or sequential: their results are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
