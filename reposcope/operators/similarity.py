"""Repository similarity: cosine top-k, hybrid re-scoring, list forms.

Exact top-k (``similar_topk``) is an all-pairs problem; it is planned so
that no task ever holds more than two blocks of vectors and no step emits
all pairs:

1. norms are taken once (JVM-side array expressions), and vectors travel as
   given with their norm; the query
   side is hashed into ``Bq`` blocks and the candidate side into ``Bc``
   blocks of up to ``block_rows`` vectors each;
2. every query block meets every candidate block under the key
   ``(qb, cb)`` — query rows are copied ``Bc`` times and candidate rows
   ``Bq`` times by a generator, and the two sides are co-grouped on that
   key (an equi-grouping, not a cartesian product of rows);
3. numpy matrix products per block pair in single precision, a slice of
   queries by a slice of candidates at a time; what may be among a query's
   best so far is scored in double precision, and exactly each query's local
   top-k by (cosine, id) is emitted;
4. a per-source ``row_number`` merges the ``B`` local lists.

Shuffle volume is ``|Q|·Bc + N·Bq`` vectors (``2·N·B`` for all sources;
small for the periodic job whose sources are the recently pushed ones),
per-task memory two blocks. Exact all-pairs work grows with N²; for very
large collections ``method="lsh"`` gives the approximate form: random
hyperplane buckets per hash table, the same blocked kernel inside each
bucket, so work grows with the bucket sizes and never emits bucket pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.functions.sets import jaccard
from reposcope.operators.snapshots import recently_pushed
from reposcope.session import materialized
from reposcope.sources.ingest import object_key

#: Components of a block's vectors at most, and blocks of a side while these are smaller.
BLOCK_VALUES = 1 << 23
SHARED_BLOCKS = 8
#: Pairs that a task ranks, about.
RANKED_PAIRS = 1 << 19
TOPK_SCHEMA = "source_id long, candidate_id long, cosine double"

# Blend weights of cosine, topic Jaccard and language Jaccard.
HYBRID_WEIGHTS = (0.6, 0.3, 0.1)


def normed_vectors(vectors: DataFrame, id_col: str = "repository_id",
                   vec_col: str = "embedding") -> DataFrame:
    """(repository_id, vec, norm DOUBLE); null or zero vectors dropped (their
    cosine is undefined). ``vec`` is as given, if of single precision: that
    halves what travels, and ``vec / norm`` is the same unit vector anywhere."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    return (vectors.select(F.col(id_col).alias("repository_id"), (F.col(vec_col) if single else v).alias("vec"), norm.alias("norm"))
            .where(F.col("vec").isNotNull() & (F.col("norm") > 0)))


def unit_column(vec: str = "vec", norm: str = "norm") -> Column:
    return F.transform(vec, lambda x: x.cast("double") / F.col(norm))


def unit_vectors(vectors: DataFrame, id_col: str = "repository_id",
                 vec_col: str = "embedding") -> DataFrame:
    """(repository_id, unit ARRAY<DOUBLE>); null or zero vectors dropped
    (their cosine is undefined)."""
    return normed_vectors(vectors, id_col, vec_col).select("repository_id", unit_column().alias("unit"))


def unit_rows(vec: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of ``normed_vectors``, as ``unit_column`` has them."""
    rows = vec.astype(np.float64)
    rows /= norm[:, None]
    return rows


def vector_rows(column) -> np.ndarray:
    """Vectors of one length, as rows."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _single(unit: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(unit, dtype=np.float32)


def _best_of(k: int, q: np.ndarray, cid: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Places of each query's best ``k``, by query; ties at the k-th score go to the smaller id, as in the final order."""
    order = np.lexsort((cid, -cosine, q))
    q = q[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells of a mask whose rows are whole words of eight."""
    cells = mask.reshape(-1, 8)
    words = np.flatnonzero(cells.view(np.uint64))
    i, j = np.nonzero(cells[words])
    return np.divmod(words[i] * 8 + j, mask.shape[1])


def _few_copies(ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Rows but those of equal vectors beyond the least ``k + 1`` ids: a list holds ``k`` of them, none the source's own."""
    odd = np.random.default_rng(11).integers(1 << 62, size=m.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    # Zeros of either sign are equal; that they hash apart leaves a copy more.
    hashed = np.concatenate([(m[i:i + 8192].view(np.uint64) * odd).sum(axis=1) for i in range(0, len(m), 8192)])
    order = np.lexsort((ids, hashed))
    same = np.append(False, hashed[order[1:]] == hashed[order[:-1]])
    at = np.flatnonzero(same)
    for i in range(0, len(at), 8192):
        some = at[i:i + 8192]
        same[some] = (m[order[some]] == m[order[some - 1]]).all(axis=1)
    other = np.append(True, ids[order[1:]] != ids[order[:-1]])
    number = np.cumsum(other)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return np.sort(order[number - number[first] <= k])


def _top_pairs(qid: np.ndarray, qm: np.ndarray, cid: np.ndarray, cm: np.ndarray, k: int, rows: int, columns: int = 2048, qn: np.ndarray | None = None):
    """Each query's best ``k`` candidates of another id: query ids, candidate ids, cosines.

    ``qm`` has unit vectors, or vectors whose norms are ``qn``.
    Products in single precision leave out what is below a query's k-th cosine
    so far by more than their error; the rest is scored in double precision.
    One ``rows`` x ``columns`` matrix of products is held at a time.
    """
    some = np.isfinite(cm).all(axis=1)  # no cosine without finite components
    if not some.all():
        cid, cm = cid[some], cm[some]
    if not len(cid):
        return
    few = _few_copies(cid, cm, k)
    if len(few) < len(cid):
        cid, cm = cid[few], cm[few]
    c32 = _single(cm)
    slack = (cm.shape[1] + 16) * 2.0 ** -22  # twice the error of two products of unit vectors
    columns = min(columns, -(-len(cid) // 8) * 8)
    held = np.empty((min(rows, len(qid)), columns), dtype=np.float32)
    for lo in range(0, len(qid), rows):
        ids, unit = qid[lo:lo + rows], qm[lo:lo + rows] if qn is None else unit_rows(qm[lo:lo + rows], qn[lo:lo + rows])
        q32 = _single(unit)
        bound = np.full(len(ids), -np.inf, dtype=np.float32)
        at, found, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        waiting: list[tuple] = []
        for left in range(0, len(cid), columns):
            some = c32[left:left + columns]
            s = held[:len(ids)]
            np.matmul(q32, some.T, out=s[:, :len(some)])
            s[:, len(some):] = np.nan  # compares false
            if not left:
                s[:, :len(some)][ids[:, None] == cid[None, :columns]] = -np.inf
                if len(some) > k:
                    bound = np.partition(s[:, :len(some)], len(some) - k, axis=1)[:, len(some) - k] - np.float32(slack)
            row, near = _places(s >= bound[:, None])
            near += left
            other = ids[row] != cid[near]
            row, near = row[other], near[other]
            exact = np.empty(len(row))
            for i in range(0, len(row), 1 << 16):
                exact[i:i + (1 << 16)] = np.einsum("ij,ij->i", unit[row[i:i + (1 << 16)]], cm[near[i:i + (1 << 16)]])
            waiting.append((row, near, exact))
            if sum(len(w[0]) for w in waiting) >= min(len(ids) * k, 1 << 16) or left + columns >= len(cid):
                at, found, cosine = (np.concatenate(x) for x in zip((at, found, cosine), *waiting))
                keep = np.isfinite(cosine)
                at, found, cosine = at[keep], found[keep], cosine[keep]
                best = _best_of(k, at, cid[found], cosine)
                at, found, cosine, waiting = at[best], found[best], cosine[best], []
                last = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == k - 1)
                bound[at[last]] = np.maximum(bound[at[last]], (cosine[last] - slack).astype(np.float32))
        yield ids[at], cid[found], cosine


def _block_topk(k: int, rows_per_slice: int = 256):
    def run(q, c):
        """Two blocks (Arrow tables or pandas frames: id, and unit vector or vector and norm) → source_id, candidate_id, cosine in the same form."""
        frames = isinstance(q, pd.DataFrame)
        if frames:
            q, c = pa.Table.from_pandas(q, preserve_index=False), pa.Table.from_pandas(c, preserve_index=False)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(c):
            if "c_norm" in c.column_names:
                qm, qn = vector_rows(q.column("q_vec")), q.column("q_norm").to_numpy()
                cm = unit_rows(vector_rows(c.column("c_vec")), c.column("c_norm").to_numpy())
            else:
                qm, qn, cm = vector_rows(q.column("q_unit")), None, vector_rows(c.column("c_unit"))
            out += _top_pairs(q.column("q_id").to_numpy(), qm, c.column("c_id").to_numpy(), cm, k, rows_per_slice, qn=qn)
        found = pa.table(dict(zip(("source_id", "candidate_id", "cosine"), (np.concatenate(x) for x in zip(*out)))))
        return found.to_pandas() if frames else found
    return run


def _sizes(vectors: DataFrame, block_rows: int) -> tuple[int, int]:
    """Number of vectors, and rows of a block: ``block_rows`` at most, and no more than ``BLOCK_VALUES`` components."""
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return n, max(1, min(block_rows, BLOCK_VALUES // max(1, dim or 1)))


def _block_count(rows: int, block_rows: int) -> int:
    """Blocks for so many rows: as few as their size allows, but some for the tasks to share."""
    return max(1, math.ceil(rows / block_rows), min(SHARED_BLOCKS, math.ceil(rows / 1024)))


def _spread(vectors: DataFrame, n: int) -> DataFrame:
    """Vectors over several tasks, however few files hold them."""
    return vectors if n <= 1024 else vectors.select("repository_id", "embedding").repartition(4 * SHARED_BLOCKS)


def similar_topk(vectors: DataFrame, k: int = 10, sources: DataFrame | None = None,
                 method: str = "block", block_rows: int = 1 << 17, blocks: int | None = None,
                 lsh_bits: int = 6, lsh_tables: int = 4, seed: int = 7) -> DataFrame:
    """Top ``k`` candidates by cosine for every source vector, against ALL
    vectors, self excluded; order cosine desc, candidate id asc.
    ``sources`` (column ``repository_id``) restricts the query side.
    → source_id, candidate_id, cosine, rank
    """
    n, block_rows = _sizes(vectors, block_rows)
    known = F.col("repository_id").isNotNull()
    some = None if sources is None else sources.select("repository_id").distinct()
    if method == "lsh":
        pairs = _lsh_pairs(unit_vectors(_spread(vectors, n)).where(known), some, k, lsh_bits, lsh_tables, block_rows, seed)
    elif method == "block":
        u = normed_vectors(_spread(vectors, n)).where(known)
        if n > 1024:  # both sides read them, and copy them
            u = materialized(u, "unit-vectors")
        q = u if some is None else u.join(some, "repository_id", "left_semi")
        if blocks is None:
            # Block counts from row counts: the vector table's is an upper
            # bound (zero vectors are dropped later); the query side is
            # counted only when sources are given.
            c_blocks = _block_count(n, block_rows)
            # Sources are a subset of the vectors, so one candidate block
            # means one query block without counting them.
            q_blocks = _block_count(q.count(), block_rows) if some is not None and c_blocks > 1 else c_blocks
        else:
            q_blocks = c_blocks = int(blocks)
        qblk = F.pmod(F.xxhash64("repository_id"), F.lit(q_blocks)).cast("int")
        cblk = F.pmod(F.xxhash64("repository_id"), F.lit(c_blocks)).cast("int")
        # Each query block meets every candidate block: the query side is
        # copied once per candidate block and vice versa. With few sources
        # (the periodic job) the candidate side is copied only a few times.
        # Distinct names per side: both sides descend from the same scan.
        qs = q.select(qblk.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"),
                      F.col("repository_id").alias("q_id"), F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm"))
        cs = u.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), cblk.alias("cb"),
                      F.col("repository_id").alias("c_id"), F.col("vec").alias("c_vec"), F.col("norm").alias("c_norm"))
        pairs = _cogrouped(qs, cs, ["qb", "cb"], k, q_blocks * c_blocks)
        pairs = by_source(pairs, min(n, q_blocks * block_rows) * c_blocks * k)
    else:
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy("source_id").orderBy(F.desc("cosine"), F.asc("candidate_id"))
    return (pairs.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= k))


def by_source(pairs: DataFrame, most: int) -> DataFrame:
    """So many pairs at most, dealt by source for their ranks: to more tasks than the session's if these would sort too much."""
    n = min(-(-most // RANKED_PAIRS), 4096)
    return pairs if n <= int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else pairs.repartition(n, "source_id")


def _cogrouped(qs: DataFrame, cs: DataFrame, keys: list[str], k: int, groups: int) -> DataFrame:
    """The kernel for every pair of blocks. A pair is long work on little data, so tasks are counted by pairs, not sized by bytes."""
    n = 1 if groups == 1 else min(2 * groups, 4096)
    qs, cs = qs.repartition(n, *keys), cs.repartition(n, *keys)
    return qs.groupBy(*keys).cogroup(cs.groupBy(*keys)).applyInArrow(_block_topk(k), TOPK_SCHEMA)


def _signatures(dim: int, bits: int, tables: int, seed: int):
    """Random-hyperplane buckets: one ``bits``-bit signature per table."""
    planes = np.random.default_rng(seed).normal(size=(dim, bits * tables))
    weights = 1 << np.arange(bits)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = (vector_rows(batch.column("unit")) @ planes > 0).reshape(batch.num_rows, tables, bits)
            codes = (sign * weights).sum(axis=2).astype(np.int32)
            at = pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(codes.ravel()))],
                                             names=["repository_id", "unit", "codes"])
    return run


def _lsh_pairs(u: DataFrame, sources: DataFrame | None, k: int, bits: int, tables: int, block_rows: int,
               seed: int) -> DataFrame:
    """Approximate candidates: vectors sharing a bucket in any table. Each
    bucket is split into blocks sized from its count (a table of at most
    ``tables · 2^bits`` rows, so it is broadcast), and the exact kernel
    runs per (table, bucket, query block, candidate block), emitting only
    each query's local top-k — a crowded bucket is split, never expanded
    into all its pairs. Signatures are computed once for both sides."""
    some = u.select(F.size("unit").alias("d")).first()  # one scalar
    if some is None:
        return u.sparkSession.createDataFrame([], TOPK_SCHEMA)
    signed = materialized(u.mapInArrow(_signatures(some["d"], bits, tables, seed),
                                       "repository_id long, unit array<double>, codes array<int>"), "signatures")
    keys = ["lsh_table", "bucket"]

    def bucketed(x: DataFrame) -> DataFrame:
        return x.select("repository_id", "unit", F.posexplode("codes").alias(*keys))

    us, qs_ = bucketed(signed), bucketed(signed if sources is None else signed.join(sources, "repository_id", "left_semi"))
    counts = us.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("_nb"))
    if tables * 2 ** bits <= 1 << 20:  # rows at most; beyond, an ordinary join
        counts = F.broadcast(counts)
    blk = F.pmod(F.xxhash64("repository_id"), F.col("_nb")).cast("int")
    seq = F.sequence(F.lit(0), F.col("_nb") - 1)
    qs = qs_.join(counts, keys).select(*keys, blk.alias("qb"), F.explode(seq).alias("cb"),
                                        F.col("repository_id").alias("q_id"), F.col("unit").alias("q_unit"))
    cs = us.join(counts, keys).select(*keys, F.explode(seq).alias("qb"), blk.alias("cb"),
                                       F.col("repository_id").alias("c_id"), F.col("unit").alias("c_unit"))
    pairs = _cogrouped(qs, cs, [*keys, "qb", "cb"], k, tables * 2 ** min(bits, 12))
    # A pair found in several tables counts once; the ranks need the same distribution.
    return pairs.repartition("source_id").groupBy("source_id", "candidate_id").agg(F.max("cosine").alias("cosine"))


def _meta(enriched: DataFrame, prefix: str) -> DataFrame:
    return enriched.select(F.col("id").alias(f"{prefix}_id"),
                           F.col("topics").alias(f"{prefix}_topics"),
                           F.map_keys("languages").alias(f"{prefix}_langs"))


def narrow_metadata(repos: DataFrame, topics: DataFrame, langs: DataFrame) -> DataFrame:
    """Topics and languages of repositories, all that re-scoring needs of a
    record. → id, topics (sorted array), languages (map)"""
    kids = (topics.select("repository_id", F.col("topic"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("bigint").alias("size"))
            .unionByName(langs.select("repository_id", F.lit(None).cast("string").alias("topic"), "language", F.col("size").cast("bigint"))))
    agg = kids.groupBy(F.col("repository_id").alias("id")).agg(
        F.array_sort(F.collect_set("topic")).alias("_topics"),
        F.collect_set(F.when(F.col("language").isNotNull(), F.col("language"))).alias("_langs"))
    one = F.lit(1).cast("bigint")
    return (repos.select("id").join(agg, "id", "left")
            .select("id", F.coalesce("_topics", F.array().cast("array<string>")).alias("topics"),
                    F.map_from_entries(F.transform(F.coalesce("_langs", F.array().cast("array<string>")), lambda x: F.struct(x, one))).alias("languages")))


def similarity_hybrid(topk: DataFrame, enriched: DataFrame,
                      weights: Sequence[float] = HYBRID_WEIGHTS) -> DataFrame:
    """Blend ``w0·cosine + w1·jaccard(topics) + w2·jaccard(languages)``.

    A source without a record gets no list at all; a candidate without a
    record is skipped. The list stays in cosine order (not re-sorted by the
    blended score): ``rank`` is the position among the kept candidates.
    → source_id, candidate_id, cosine, topic_score, language_score, score, rank
    """
    w0, w1, w2 = weights
    x = (topk.join(_meta(enriched, "source"), "source_id", "inner")
         .join(_meta(enriched, "candidate"), "candidate_id", "inner"))
    t = jaccard(F.col("source_topics"), F.col("candidate_topics"))
    lg = jaccard(F.col("source_langs"), F.col("candidate_langs"))
    x = x.select("source_id", "candidate_id", "cosine", F.col("rank").alias("_crank"),
                 t.alias("topic_score"), lg.alias("language_score"))
    x = x.withColumn("score", F.lit(w0) * F.col("cosine") + F.lit(w1) * F.col("topic_score")
                     + F.lit(w2) * F.col("language_score"))
    w = Window.partitionBy("source_id").orderBy("_crank")
    return x.withColumn("rank", F.row_number().over(w).cast("bigint")).drop("_crank")


def jaccard_pairs(pairs: DataFrame, enriched: DataFrame) -> DataFrame:
    """Topic and language Jaccard for given (source_id, candidate_id) pairs;
    a side without a record counts as empty sets."""
    x = (pairs.select("source_id", "candidate_id")
         .join(_meta(enriched, "source"), "source_id", "left")
         .join(_meta(enriched, "candidate"), "candidate_id", "left"))
    return x.select("source_id", "candidate_id",
                    jaccard(F.col("source_topics"), F.col("candidate_topics")).alias("topic_jaccard"),
                    jaccard(F.col("source_langs"), F.col("candidate_langs")).alias("language_jaccard"))


def similarity_json(lists: DataFrame) -> DataFrame:
    """Long form → one JSON list per source, ``[{"Score":s,"Member":id},…]``
    in rank order (the stored form), scores in full. Each list has at most k
    entries. → id, data"""
    items = F.sort_array(F.collect_list(F.struct("rank", "candidate_id", "score")))
    agg = lists.groupBy("source_id").agg(items.alias("_items"))
    data = F.to_json(F.transform("_items", lambda z: F.struct(z["score"].alias("Score"), z["candidate_id"].alias("Member"))))
    return agg.select(F.col("source_id").alias("id"), data.alias("data"))


ZLIST = "array<struct<Score:double,Member:double>>"


def similarity_from_json(stored: DataFrame) -> DataFrame:
    """Stored JSON lists → long form (source_id, candidate_id, score, rank).
    Members parse as float64 in the reference; casting to bigint here is
    exact for ids below 2^53."""
    z = F.from_json(F.col("data"), ZLIST)
    return (stored.select(F.col("id").alias("source_id"), F.posexplode(z).alias("_pos", "_z"))
            .select("source_id", F.col("_z.Member").cast("bigint").alias("candidate_id"),
                    F.col("_z.Score").alias("score"), (F.col("_pos") + 1).cast("bigint").alias("rank")))


def embed_requests(recent: DataFrame, vectors: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Recent repositories without a vector → embedding requests.
    → repository_id, object_key, download_url ('' when unknown)"""
    need = recent.select("repository_id").distinct().join(
        vectors.select("repository_id"), "repository_id", "left_anti")
    if repos is not None:
        need = need.join(repos.select(F.col("id").alias("repository_id"), "readme_url"),
                         "repository_id", "left")
    else:
        need = need.withColumn("readme_url", F.lit(None).cast("string"))
    return need.select("repository_id", object_key(F.col("repository_id")).alias("object_key"),
                       F.coalesce("readme_url", F.lit("")).alias("download_url"))


def upsert_similarity(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next similarity table (id, data, updated): an incoming list replaces
    the stored one; ``updated`` marks rows actually written (new id or
    different data — an equal list is a no-op)."""
    cur = current.select("id", F.col("data").alias("_old"))
    inc = incoming.select("id", F.col("data").alias("_new"))
    x = cur.join(inc, "id", "full")
    return x.select("id", F.coalesce("_new", "_old").alias("data"),
                    (F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))).alias("updated"))


def similarity_job(vectors: DataFrame, enriched: DataFrame, stats: DataFrame, since, k: int = 200,
                   weights: Sequence[float] = HYBRID_WEIGHTS, **topk_options) -> tuple[DataFrame, DataFrame]:
    """The periodic similarity job: sources are the repositories whose
    latest snapshot was pushed after ``since``; each gets its top ``k``
    neighbours among ALL vectors, re-scored. Sources without a vector are
    returned as embedding requests instead.
    → (lists: source_id, candidate_id, cosine, topic_score, language_score,
       score, rank; requests: repository_id, object_key, download_url)"""
    sources = recently_pushed(stats, since)
    topk = similar_topk(vectors, k, sources=sources, **topk_options)
    return similarity_hybrid(topk, enriched, weights), embed_requests(sources, vectors)
