"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies,
``target / source_size``. Within a source the documents are put in order of
(size, md5 of the id, id), expected copies are prefix-summed in that order,
one offset in [0, 1) is added, and a document is emitted once for each
integer that its stretch of the prefix sum crosses. Ordering by size makes
the sample stratified, so the words taken stay within about one document of
the target. Offsets come from a hash of the source and the seed: reruns
agree.

A document's place is found without sorting a source in one task: counts
per (source, size) and per (source, size, md5 bucket) are prefix-summed and
only the rows of one such bucket are numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, word_count

#: Source weights by order of the source names, repeating.
WEIGHTS = (3, 1, 2)


def _unit(text: Column) -> Column:
    """48 bits of md5 as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(2 ** 48))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=(3, 2), cap: int = 2) -> DataFrame:
    """Targets of every source: (source, source_size, weight, target).

    ``sizes`` has source and size. The targets sum to ``share`` (a fraction)
    of all sizes, in proportion to the weights; a target stops at ``cap``
    times its source's size and the excess goes to the others by weight until
    none is above. That fixed point is found in one pass: in order of
    cap / weight the capped sources come first, so each source compares its
    share of what the sources before it leave. Sources sort by code point,
    null last. One row per source is all that meets in one task.
    """
    num, den = share
    one = Window.orderBy(F.col("source").asc_nulls_last())
    per = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("_k", F.row_number().over(one))
           .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_k") - 1) % len(weights) + 1).cast("int")).cast("long"))
           .withColumn("_cap", F.col("source_size") * cap))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("_cap") / F.col("weight"), "_k").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * num
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0)) * den
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_capped", left * F.col("weight") >= F.col("_cap") * den * weight_left).withColumn("_total", total)
    cap_sum = F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("weight"))).over(everything)
    share_of = ((F.col("_total") - cap_sum * den) * F.col("weight")).cast("double") / (free * den).cast("double")
    return per.select("source", "source_size", "weight",
                      F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share_of).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share=(3, 2), cap: int = 2, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of every document in a mix of the sources.

    Returns (doc_id, source, size, source_size, target, copies, taken), one
    row per input row. ``size`` is the number of words (null or empty text:
    0, such rows may be taken but add no words), ``taken`` is size * copies,
    copies never exceeds ``cap``. A null source is a source of its own, the
    last in order. Null and repeated ids are kept: equal rows are
    interchangeable. An empty table gives no rows. Other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = source_targets(sized, weights, share, cap)
    rows = sized.withColumn("_h", F.md5(key)).withColumn("_sub", F.substring("_h", 1, 2))
    counts = rows.groupBy("source", "size", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    by_size = counts.groupBy("source", "size").agg(F.sum("_n").alias("_n"))
    size_start = by_size.select("source", "size", F.coalesce(F.sum("_n").over(
        Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_size_start"))
    sub_start = counts.select("source", "size", "_sub", F.coalesce(F.sum("_n").over(
        Window.partitionBy("source", "size").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sub_start"))
    s = size_start.alias("s")
    starts = (sub_start.alias("b").join(s, F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.size") == F.col("s.size")))
              .select(F.col("b.source").alias("_source"), F.col("b.size").alias("_size"), F.col("b._sub").alias("_b"),
                      (F.col("_size_start") + F.col("_sub_start")).alias("_start"))
              .join(targets, F.col("_source").eqNullSafe(F.col("source")))
              .select("_source", "_size", "_b", "_start", "source_size", "target"))
    own = Window.partitionBy("source", "size", "_sub").orderBy("_h", "doc_id")
    placed = (rows.withColumn("_rn", F.row_number().over(own))
              .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_sub") == F.col("_b")))
              .withColumn("_place", F.col("_start") + F.col("_rn"))
              .withColumn("_each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0))
              .withColumn("_offset", _unit(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))))))
    upto = lambda place: F.floor(place.cast("double") * F.col("_each") + F.col("_offset"))
    copies = (upto(F.col("_place")) - upto(F.col("_place") - 1)).cast("long")
    return (placed.withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[((k - 1) % 3 + 1)::INTEGER]::BIGINT AS weight, 2 * source_size AS cap FROM per),
b AS (SELECT *, 3 * sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
             coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
c AS (SELECT *, (total - 2 * cap_before) * weight >= 2 * cap * (all_weight - weight_before) AS capped FROM b),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        ((total - 2 * sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight)::DOUBLE
        / (2 * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS place,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS each,
             ('0x' || substr(md5('mix|' || coalesce('s' || d.source, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(place::DOUBLE * each + off) - floor((place - 1)::DOUBLE * each + off))::BIGINT)::BIGINT AS taken
FROM r
"""
