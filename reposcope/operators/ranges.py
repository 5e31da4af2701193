"""Adaptive range splitting and paging by a frontier of ranges.

The reference halves a value range recursively (``mid = lo + (hi-lo)/2``,
right half from ``mid+1``) until a range holds at most ``cap`` rows or is a
single value, then pages each leaf. Every value's chain of enclosing
intervals is fixed by the midpoint rule, so the recursion becomes:

1. a histogram of distinct values (map-side partial counts) is the frontier,
   all of it in the one range ``[lo, hi]``;
2. each value of the frontier goes ``LEVELS`` halvings down; counts per
   sub-range (partial aggregates again) give, added up along the halvings,
   the count of every range in between;
3. a leaf is the first range on a path with ``n ≤ cap`` or ``lo = hi``: the
   values below it are done and leave the frontier, the others go on from
   their sub-range. Rounds depend on the domain and the cap only;
4. values meet their sub-range, rows their value, by equi-joins, not by a
   range join. No step gathers a level, a range or the histogram in one
   group;
5. pages are positions in (value, id) order inside a leaf, numbered per
   (value, id range) sub-bucket plus the counts of earlier sub-buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.ordinal import rank_within
from reposcope.session import materialized

#: Halvings per round: the first round has at most 2 ** LEVELS sub-ranges.
LEVELS = 8
#: Rows of a single value that are numbered together, about.
BUCKET_ROWS = 1 << 18


def _halved(v: Column, lo: Column, hi: Column, steps: Column) -> Column:
    """The range around ``v`` after so many halvings of ``[lo, hi]``; a single value stays."""
    def half(r: Column, _: Column) -> Column:
        mid = r["lo"] + F.shiftright(r["hi"] - r["lo"], 1)
        left = v <= mid
        return F.struct(F.when(left, r["lo"]).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(r["hi"]).alias("hi"))
    return F.aggregate(F.array_repeat(F.lit(0), steps), F.struct(lo.alias("lo"), hi.alias("hi")), half)


def _leaves_below(subs: DataFrame, cap: int) -> DataFrame:
    """Sub-ranges (lo, hi, below, n) with the leaf each lies in; null where the sub-range itself still holds too much."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("d")
    above = subs.select("lo", "hi", "below", "n", steps)
    above = above.select("lo", "hi", "below", "n", "d", _halved(F.col("below.lo"), F.col("lo"), F.col("hi"), F.col("d")).alias("r"))
    counts = above.groupBy("d", "r").agg(F.sum("n").alias("total"))
    fits = above.join(counts, ["d", "r"]).where((F.col("total") <= cap) | (F.col("r.lo") == F.col("r.hi")))
    first = fits.groupBy("lo", "hi", "below").agg(F.min_by("r", "d").alias("leaf"))
    return subs.select("lo", "hi", "below").join(first, ["lo", "hi", "below"], "left").select("below", "leaf")


def value_leaves(df: DataFrame, col: str = "v", lo: int = 50, hi: int = 1_000_000, cap: int = 1000) -> DataFrame:
    """Distinct values of ``[lo, hi]`` with their counts and leaf ranges. → v, n, lo, hi"""
    a, b = F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint")
    hist = (df.where(F.col(col).between(lo, hi)).groupBy(F.col(col).cast("bigint").alias("v"))
            .agg(F.count(F.lit(1)).alias("n")))
    open_, done = hist.select("v", "n", a.alias("lo"), b.alias("hi")), []
    for round_ in range(math.ceil(max(1, (hi - lo).bit_length()) / LEVELS)):
        x = materialized(open_.withColumn("below", _halved(F.col("v"), F.col("lo"), F.col("hi"), F.lit(LEVELS))), "frontier")
        leaves = _leaves_below(x.groupBy("lo", "hi", "below").agg(F.sum("n").alias("n")), cap)
        # The first round's sub-ranges are 2 ** LEVELS at most, each with a great part of the values.
        placed = x.join(F.broadcast(leaves) if round_ == 0 else leaves, "below")
        placed = materialized(placed.select("v", "n", "below", "leaf"), "placed")
        done.append(placed.where(F.col("leaf").isNotNull()).select("v", "n", "leaf.lo", "leaf.hi"))
        open_ = placed.where(F.col("leaf").isNull()).select("v", "n", "below.lo", "below.hi")
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def adaptive_ranges(df: DataFrame, col: str = "v", lo: int = 50, hi: int = 1_000_000,
                    cap: int = 1000, values: DataFrame | None = None) -> DataFrame:
    """Leaf ranges of the recursive split, non-empty only (``values``: the
    result of ``value_leaves``, if it is there already). → lo, hi, n"""
    values = value_leaves(df, col, lo, hi, cap) if values is None else values
    return values.groupBy("lo", "hi").agg(F.sum("n").cast("bigint").alias("n"))


def range_pages(df: DataFrame, values: DataFrame, col: str = "v", id_col: str = "id",
                page_size: int = 100) -> DataFrame:
    """Rows of every leaf in pages of ``page_size``, ordered by (value, id).
    ``values`` comes from ``value_leaves``. Page numbers start at 1.
    → lo, hi, page, id"""
    base = df.select(F.col(id_col).alias("id"), F.col(col).cast("bigint").alias("v"))
    rows = base.join(values.select("v", "lo", "hi"), "v")
    # Position inside a leaf in (value, id) order. Sub-buckets of (value, id
    # stretch) follow that order; the stretches are cut from the ids' own
    # range into as many as the rows need, so even a single-valued leaf with
    # a third of all rows is numbered in parallel.
    low, high, n = base.agg(F.min("id"), F.max("id"), F.count("id")).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, (n or 0) // BUCKET_ROWS) + 1)
    bucket = F.struct(F.col("v"), F.floor((F.col("id") - F.lit(low or 0)) / F.lit(width)))
    ranked = rank_within(rows, ["lo", "hi"], [F.asc("v"), F.asc("id")], bucket, name="_pos")
    return ranked.select("lo", "hi", (F.floor((F.col("_pos") - 1) / page_size) + 1).cast("bigint").alias("page"),
                         "id")
