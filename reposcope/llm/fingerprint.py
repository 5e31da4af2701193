"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's word
shingles, ascending. Sketches of parts merge by union and cut, and estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

K = 64
WORDS = 5
#: Stretches of documents up to which their heads are broadcast (16 bytes each).
HEADS = 100_000


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Bottom-k sketch of a text (array of longs, ascending).

    Words are runs of non-white-space of the lower-cased text. A text with
    fewer than ``words`` words has one shingle, the whole sequence; a text
    without words (null, empty, white space) has an empty sketch.
    """
    hashes = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def shingles(box: Column) -> Column:
        # `box` holds the word hashes once, so that they are not recomputed per shingle.
        def of(h: Column) -> Column:
            n = F.size(h)
            wide = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
            return F.when(n >= words, wide).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(box, of)

    return F.slice(F.sort_array(F.array_distinct(F.element_at(shingles(F.array(hashes)), 1))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles (or of two parts of one)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(s, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / top)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1: share of the union's sketch that both have.

    Two empty sketches are alike (1), an empty and a non-empty one are not (0).
    """
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(union).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1 (an empty a is contained)."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_parts(df: DataFrame, key: str, col: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Hashes are exploded and pre-aggregated, and a ranked window keeps k per
    key in each task before the shuffle, so a key with many parts is safe.
    """
    each = df.select(F.col(key).alias("_key"), F.explode(col).alias("_h")).distinct()
    own = Window.partitionBy("_key").orderBy("_h")
    small = each.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k)
    got = small.groupBy("_key").agg(F.sort_array(F.collect_list("_h")).alias("_s"))
    return (df.select(F.col(key).alias("_key")).distinct().join(got, "_key", "left")
            .select(F.col("_key").alias(key), F.coalesce("_s", F.array().cast("array<bigint>")).alias(col)))


def as_text(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits per hash, in order."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _buckets(ids: DataFrame, rows: int) -> tuple[list[int], int]:
    """Cut points of doc_id (at most 1000) and the parts that each stretch between them is cut into."""
    n = ids.count()
    cuts = min(1000, max(1, n // rows))
    if cuts < 2:
        return [], 1
    got = ids.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 100 * cuts)).first()[0] or []
    return sorted(set(got)), max(1, n // (cuts * rows))


def next_texts(docs: DataFrame, rows: int = 2000) -> DataFrame:
    """Each document beside the next one in descending doc_id (after the last: the first).

    ``docs`` has doc_id and text, and what else it has is carried as
    ``next_<name>`` as well. Ids are cut into stretches of about ``rows``
    documents (cut points are quantiles, at most 1000, and further equal
    parts), so no task orders more than a stretch. The highest document of
    every stretch is sent to the stretch above it as well. Equal ids are
    ordered by the hash of their text. A null id has no place in the order:
    its row is its own next.
    """
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
    cuts, parts = _buckets(ids, rows)
    cut_col = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    stretch = F.size(F.filter(cut_col, lambda c: c < F.col("doc_id")))
    if parts > 1:
        low = F.coalesce(F.get(cut_col, stretch - 1), F.lit(cuts[0]))
        high = F.coalesce(F.get(cut_col, stretch), F.lit(cuts[-1]))
        within = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - low).cast("double") * parts / (high - low + 1).cast("double"))))
        bucket = stretch.cast("long") * parts + within
    else:
        bucket = stretch.cast("long")
    heads = ids.select(bucket.alias("_b"), "doc_id").groupBy("_b").agg(F.max("doc_id").alias("_head"))
    up = Window.orderBy("_b")  # one row per stretch
    heads = heads.select("_head", F.lead("_b").over(up).alias("_up"), F.min("_b").over(up).alias("_low"), "_b")
    # The stretch above takes this head after its own rows; the top stretch's head goes to the lowest.
    heads = heads.select("_head", F.coalesce("_up", "_low").alias("_to"))
    if (len(cuts) + 1) * parts <= HEADS:  # two longs per stretch; beyond, the join shuffles
        heads = F.broadcast(heads)
    names = docs.columns
    lone = -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    rows_ = (docs.join(heads, F.col("doc_id") == F.col("_head"), "left")
             .withColumn("_own", F.when(F.col("doc_id").isNull(), lone).otherwise(bucket))
             .withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("g"))))
                                          .otherwise(F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("g")),
                                                             F.struct(F.col("_to").alias("b"), F.lit(1).alias("g")))))))
    order = Window.partitionBy("_at.b").orderBy("_at.g", F.col("doc_id").desc(), F.xxhash64("text"))
    lead = [F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(F.lead(c).over(order)).alias(f"next_{c}") for c in names if c != "doc_id"]
    return rows_.select(*names, *lead, F.col("_at.g").alias("_g")).filter("_g = 0").drop("_g")


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document's. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and n_shingles (estimated), one row per input row. A null text
    counts as empty: its fingerprint is empty and it is alike (1) only to
    another empty one. Equal texts have equal fingerprints. Other columns
    are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("sketch", sketch(F.col("text"), k, words))
    half = F.floor(F.length("text") / 2).cast("int")
    both = next_texts(base).withColumn("_half", half)
    both = both.withColumn("_edited", F.concat(F.expr("substring(text, 1, length(text) - _half)"), F.expr("substring(next_text, 1, _half)")))
    both = both.withColumn("_es", sketch(F.col("_edited"), k, words))
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
                       as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("_es")).alias("edited_fingerprint"),
                       resemblance(F.col("sketch"), F.col("_es"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
                       distinct_shingles(F.col("sketch"), k).alias("n_shingles"))
