"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled rows.

    ``learn`` is a condition on doc_id. Rows are taken in order of a hash of
    the id; a document labelled twice takes its highest label; null ids,
    labels and texts are left out. The labels taken are broadcast: ``bound``
    pairs of an id and a label at most.
    """
    rows = (labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
            .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).filter(learn)
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(rows), "doc_id")
