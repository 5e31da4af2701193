"""Sets of ids as 64-bit words.

A set is a table of (word, bits): bit ``id mod 64`` of ``bits`` in word
``floor(id / 64)`` says that the id is in the set. A word is two longs, so
words are made, merged and met by hash aggregates and joins in generated code
with partial aggregation; sparse sets take a row per id at most, dense ones
one per 64 ids. Sets are united by ``bit_or`` of equal words, which is
idempotent and free of order, met by ``&`` and counted by ``bit_count``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_of(ids: Column) -> Column:
    return F.shiftright(ids.cast("bigint"), 6)


def place_of(ids: Column) -> Column:
    return ids.cast("bigint").bitwiseAND(63).cast("int")


def has(bits: Column, ids: Column) -> Column:
    """Whether the word of an id holds it."""
    return F.getbit(bits, place_of(ids)) == 1


def as_words(rows: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The sets of ids of each key: keys, word, bits. Null ids are in no set; repeated rows count once."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place_of(F.col(id_col)))
    return (rows.where(F.col(id_col).isNotNull()).groupBy(*keys, word_of(F.col(id_col)).alias("word")).agg(F.bit_or(bit).alias("bits")))


def united(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    return one.unionByName(two).groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def ids_of(words: DataFrame, name: str) -> DataFrame:
    """A row per id; the other columns stay."""
    others = [c for c in words.columns if c not in ("word", "bits")]
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return words.select(*others, "word", F.explode(places).alias("_place")).select(
        *others, (F.shiftleft("word", 6) + F.col("_place")).alias(name))
