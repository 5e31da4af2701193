"""A stored neighbour index: inverted lists of coded residuals.

``fit_index`` learns, on a bounded sample of the vectors (the rows of least
hash), centroids for the inverted lists, code books for the residuals (one
byte for every ``code_dims`` dimensions) and the number of lists to probe: the
least that holds ``target_recall`` of the sample's own neighbours. Everything
it learns has a size bounded by its parameters.

``build_index`` assigns every vector to its nearest centroid and stores it
once, as its list, its code and its unit vector, in files ordered by list.
``search_index`` sends each query to the lists it probes, scores their decoded
codes in single precision, and re-ranks the best ``rerank`` codes by exact cosine.
A task scores a block of queries against a group of entries. Entries travel as
codes of dim / code_dims bytes, once for every block of queries; a query is
copied for every group that holds lists it probes, with a bit for each list.
Short lists share a group, and a list of any size is split into groups of
``BLOCK_ROWS`` entries, so what a task holds depends neither on the number of
vectors or queries nor on how many lists are probed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reposcope.operators.similarity import TOPK_SCHEMA, _best_of, _block_count, by_source, normed_vectors, unit_column, unit_rows, unit_vectors, vector_rows
from reposcope.session import materialized, scratch_path

#: Entries of a group at most, about, and bytes of their codes and ids.
BLOCK_ROWS = 1 << 20
BLOCK_BYTES = 1 << 25
#: Components of a block of queries, and of the entries that are decoded at a time.
_QUERY_VALUES = 1 << 20
_DECODED_VALUES = 1 << 22
#: Components of a block of vectors, or of queries, that are compared exactly.
_RERANKED_VALUES = 1 << 22
#: Scores of queries and entries that a task holds at a time, about, and entries among them.
_SCORES = 1 << 19
_COLUMNS = 2048
CODES = 256


@dataclass(frozen=True)
class IndexModel:
    centroids: np.ndarray  # (lists, dim)
    books: np.ndarray  # (parts, 256, code_dims)
    probes: int
    rows: int  # vectors when it was fitted

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Parts of equal width; the last one is filled up with zeros."""
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.padded(x - self.centroids[lists])
        return np.stack([_nearest(rest[:, j], self.books[j]) for j in range(len(self.books))], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        rest = np.concatenate([self.books[j][codes[:, j]] for j in range(len(self.books))], axis=1)
        return np.ascontiguousarray(rest[:, :self.dim])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (c * c).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        out[lo:lo + 4096] = np.argmax(x[lo:lo + 4096] @ c.T - half, axis=1)
    return out


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from a random start; an empty cluster takes a random row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def _books(parts: int, width: int, rounds: int, seed: int):
    """A task learns the code book of one part of the residuals."""
    def run(table: pa.Table) -> pa.Table:
        j = table.column("part")[0].as_py()
        x = vector_rows(table.column("x")).astype(np.float64)
        book = _means(x, CODES, rounds, seed + j)
        book = np.concatenate([book, np.repeat(book[:1], CODES - len(book), axis=0)])
        return pa.table({"part": pa.array([j], pa.int32()), "book": pa.array([book.ravel().tolist()], pa.list_(pa.float64()))})
    return run


def fit_index(vectors: DataFrame, k: int = 10, lists: int | None = None, sample_rows: int = 1 << 14, code_dims: int = 4,
              target_recall: float = 0.97, rounds: int = 10, seed: int = 7) -> IndexModel | None:
    """Learn an index on at most ``sample_rows`` vectors; None if there is no vector.

    ``lists`` is the square root of the number of vectors by default, a 32nd of
    the sample at most. The number of probes is the least with which the lists
    of the sample's own rows hold ``target_recall`` of their nearest ``k`` in the
    sample, averaged over 512 of them; neighbours in all the vectors are
    nearer, so fewer probes would do for them. The cost of a fit does not grow
    with the table but for one scan.
    """
    u = unit_vectors(vectors)
    sample = u.orderBy(F.xxhash64("repository_id"), "repository_id").limit(sample_rows).select(F.col("unit").cast("array<float>").alias("unit")).toArrow()
    if not sample.num_rows:
        return None
    x = vector_rows(sample.column("unit")).astype(np.float64)
    n = vectors.count()
    most = max(1, min(sample_rows // 32, len(x) // 2))
    centroids = _means(x, min(most, lists or max(1, round(math.sqrt(n)))), rounds, seed)
    at = _nearest(x, centroids)

    parts = math.ceil(x.shape[1] / code_dims)
    rest = np.pad(x - centroids[at], ((0, 0), (0, parts * code_dims - x.shape[1])))
    spark = vectors.sparkSession
    rows = pa.table({"part": pa.array(np.tile(np.arange(parts, dtype=np.int32), len(x))),
                     "x": pa.FixedSizeListArray.from_arrays(pa.array(rest.astype(np.float32).ravel()), code_dims).cast(pa.list_(pa.float32()))})
    learnt = (spark.createDataFrame(rows).groupBy("part").applyInArrow(_books(parts, code_dims, rounds, seed), "part int, book array<double>").collect())
    books = np.stack([np.array(r["book"]).reshape(CODES, code_dims) for r in sorted(learnt, key=lambda r: r["part"])])

    # Lists that the neighbours of some of the sample's rows lie in, by the order in which they are probed.
    some = np.random.default_rng(seed).choice(len(x), min(512, len(x)), replace=False)
    scores = x[some] @ x.T
    scores[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[some] @ centroids.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(np.take_along_axis(place, at[near], axis=1).ravel()) + 1
    probes = int(depth[max(0, math.ceil(target_recall * len(depth)) - 1)]) if len(depth) else 1
    return IndexModel(centroids.astype(np.float32), books.astype(np.float32), probes, n)


@dataclass(frozen=True)
class StoredIndex:
    model: IndexModel
    path: str
    sizes: np.ndarray  # entries of each list

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("list int, repository_id long, code binary, unit array<float>").parquet(self.path)


def _coded(model: IndexModel):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vector_rows(batch.column("unit")).astype(np.float32)
            at = model.assign(x)
            codes = model.encode(x, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), batch.column("repository_id"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("unit")],
                names=["list", "repository_id", "code", "unit"])
    return run


def build_index(vectors: DataFrame, model: IndexModel, path: str | None = None) -> StoredIndex:
    """Store every vector under its list (null and zero vectors have none), in files ordered by list.

    Files cover stretches of lists, so a search that probes few lists skips
    row groups; a list of any size is spread over files by a hash of the id.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "neighbours")
    u = unit_vectors(vectors).select("repository_id", F.col("unit").cast("array<float>").alias("unit"))
    coded = u.mapInArrow(_coded(model), "list int, repository_id long, code binary, unit array<float>")
    salt = F.xxhash64("repository_id")
    coded.repartitionByRange(F.col("list"), salt).sortWithinPartitions("list", salt).write.parquet(path)
    sizes = np.zeros(len(model.centroids), dtype=np.int64)
    for r in spark.read.parquet(path).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per list
        sizes[r["list"]] = r["n"]
    return StoredIndex(model, path, sizes)


def _groups(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each list's first group of entries and the number of its groups: short lists share one of about ``rows``, long ones are split."""
    copies = np.maximum(1, np.ceil(sizes / rows)).astype(np.int64)
    shared = np.where(copies == 1, sizes, 0)
    small = (np.cumsum(shared) - shared) // rows
    long = copies > 1
    first = np.where(long, small.max(initial=0) + 1 + np.cumsum(np.where(long, copies, 0)) - copies, small)
    return first, copies


def _probes(index: StoredIndex, coarse: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists by nearness, entries up to each, and how many of them a query probes.

    That is ``probes`` lists, more while they hold fewer than ``need`` entries.
    """
    order = np.argsort(-coarse, axis=1, kind="stable")
    held = np.cumsum(index.sizes[order], axis=1)
    return order, held, np.minimum(np.maximum(index.model.probes, 1 + (held < need).sum(axis=1)), order.shape[1])


def _probed(index: StoredIndex, need: int, first: np.ndarray, copies: np.ndarray):
    """Every query, once for each group that holds entries of lists it probes, with a bit for every list it probes."""
    model = index.model
    full = index.sizes > 0

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            coarse = vector_rows(batch.column("unit")).astype(np.float32) @ model.centroids.T
            size = max(1, (1 << 18) // len(full))
            for lo in range(0, len(coarse), size):
                order, _, n = _probes(index, coarse[lo:lo + size], need)
                wanted = np.zeros(order.shape, dtype=bool)
                np.put_along_axis(wanted, order, np.arange(order.shape[1])[None, :] < n[:, None], axis=1)
                wanted &= full
                bits = np.packbits(wanted, axis=1, bitorder="little")
                row, lists = np.nonzero(wanted)
                # Groups of the first entries of lists, and of the further ones of those that are split.
                key = [row * (1 << 32) + first[lists]]
                for one in np.flatnonzero(full & (copies > 1)):
                    key.append((np.flatnonzero(wanted[:, one])[:, None] * (1 << 32) + np.arange(first[one] + 1, first[one] + copies[one])).ravel())
                row, group = np.divmod(np.unique(np.concatenate(key)), 1 << 32)
                at = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.astype(np.int32)), batch.column("q_id").take(at), batch.column("unit").take(at),
                     _packed(bits[row])], names=["grp", "q_id", "unit", "lists"])
    return run


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _byte_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length, as rows of bytes."""
    each = [chunk for chunk in column.chunks if len(chunk)]
    rows = []
    for chunk in each:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        rows.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(chunk), -1))
    return np.concatenate(rows)


def _lists_probed(width: int):
    """The lists that some query probes, a task at a time."""
    def run(batches):
        seen = np.zeros(width, dtype=np.uint8)
        for batch in batches:
            if batch.num_rows:
                seen |= np.bitwise_or.reduce(_byte_rows(pa.chunked_array([batch.column("lists")])), axis=0)
        lists = np.flatnonzero(np.unpackbits(seen, bitorder="little"))
        yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32))], names=["l"])
    return run


class _Best:
    """The best ``many`` entries so far of each of a few queries: by score, ties by the smaller id."""

    def __init__(self, q_ids: np.ndarray, many: int):
        self.q_ids, self.many = q_ids, many
        self.bound = np.full(len(q_ids), -np.inf, dtype=np.float32)  # of the scores that may be among them
        self.row, self.at, self.score = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, row: np.ndarray, left: int, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores ``s`` of queries ``row`` and the entries from place ``left`` on; ``ids`` has all entries' ids."""
        bound, here = self.bound[row], ids[left:left + s.shape[1]]
        fresh = np.flatnonzero(np.isneginf(bound))
        if len(fresh) and len(here) > self.many:
            some = s[fresh]
            some[(self.q_ids[row[fresh], None] == here[None, :]) | ~np.isfinite(some)] = -np.inf
            bound[fresh] = np.partition(some, len(here) - self.many, axis=1)[:, len(here) - self.many]
        i, j = np.divmod(np.flatnonzero(s >= bound[:, None]), s.shape[1])
        score = s[i, j]
        keep = (self.q_ids[row[i]] != here[j]) & np.isfinite(score)
        self.waiting.append((row[i[keep]].astype(np.int32), (left + j[keep]).astype(np.int32), score[keep]))
        self.held += len(self.waiting[-1][0])
        if self.held >= len(self.q_ids) * self.many:
            self.merge(ids)

    def merge(self, ids: np.ndarray) -> None:
        row, at, score = (np.concatenate(x) for x in zip((self.row, self.at, self.score), *self.waiting))
        best = _best_of(self.many, row, ids[at], score)
        self.row, self.at, self.score = row[best], at[best], score[best]
        self.waiting, self.held = [], 0
        last = np.flatnonzero(np.arange(len(best)) - np.searchsorted(self.row, self.row) == self.many - 1)
        self.bound[self.row[last]] = np.maximum(self.bound[self.row[last]], self.score[last])


def _few_codes(lists: np.ndarray, codes: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Order by list, without equal codes of a list beyond the least ``k + 1`` ids: a query takes ``k`` of them at most, none of its own id."""
    odd = np.random.default_rng(11).integers(1 << 62, size=codes.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashed = np.concatenate([(codes[i:i + (1 << 16)] * odd).sum(axis=1) for i in range(0, len(codes), 1 << 16)])
    order = np.lexsort((ids, hashed, lists))
    before, after = order[:-1], order[1:]
    same = np.append(False, (lists[after] == lists[before]) & (hashed[after] == hashed[before]))
    at = np.flatnonzero(same)
    same[at] = (codes[order[at]] == codes[order[at - 1]]).all(axis=1)
    number = np.cumsum(np.append(True, ids[after] != ids[before]))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return order[number - number[first] <= k]


def _scored(model: IndexModel, rerank: int):
    """Scores of a group's codes for a block of queries, where these probe their lists; each query's best ``rerank`` of the group.

    A stretch of codes is decoded once, and scored for a slice of the queries at a time.
    """
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        found: list[_Best] = []
        ids = np.zeros(0, np.int64)
        if len(queries) and len(entries):
            held, ids, codes = entries.column("list").to_numpy(), entries.column("repository_id").to_numpy(), _byte_rows(entries.column("code"))
            turn = _few_codes(held, codes, ids, rerank)
            held, ids, codes = held[turn], ids[turn], codes[turn]
            q_ids, q = queries.column("q_id").to_numpy(), vector_rows(queries.column("unit")).astype(np.float32, copy=False)
            wanted = _byte_rows(queries.column("lists"))
            starts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            size = max(256, _SCORES // min(_COLUMNS, int(np.diff(np.append(starts, len(held))).max())))
            found = [_Best(q_ids[lo:lo + size], rerank) for lo in range(0, len(q), size)]
            stretch = max(1, _DECODED_VALUES // model.dim)
            for left in range(0, len(ids), stretch):
                lists = held[left:left + stretch]
                x = model.decode(codes[left:left + stretch])
                x += model.centroids[lists]
                cuts = np.append(np.flatnonzero(np.append(True, lists[1:] != lists[:-1])), len(lists))
                pieces = [(i, min(i + _COLUMNS, b)) for a, b in zip(cuts[:-1], cuts[1:]) for i in range(a, b, _COLUMNS)]
                for one, best in enumerate(found):
                    some, mine = q[one * size:(one + 1) * size], wanted[one * size:(one + 1) * size]
                    for i, j in pieces:
                        row = np.flatnonzero(mine[:, lists[i] >> 3] & (1 << (lists[i] & 7)))
                        if len(row):
                            best.add(row, left + i, (some if len(row) == len(some) else some[row]) @ x[i:j].T, ids)
                    best.merge(ids)
        each = [(b.q_ids, np.bincount(b.row, minlength=len(b.q_ids)), ids[b.at], b.score) for b in found] or [(np.zeros(0, np.int64),) * 4]
        q_ids, n, near, score = (np.concatenate(c) for c in zip(*each))
        ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        return pa.table({"q_id": pa.array(q_ids), "near": pa.ListArray.from_arrays(ends, pa.array(near)),
                         "approx": pa.ListArray.from_arrays(ends, pa.array(score.astype(np.float32)))})
    return run


def _dealt(blocks: int):
    """Queries with their candidates, once for every block of vectors that holds some of these."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                near, cb = some.column("near"), some.column("cbs").flatten().to_numpy()
                key = np.repeat(np.arange(len(near)), near.value_lengths().to_numpy()) * blocks + cb
                turn = np.argsort(key, kind="stable")
                key = key[turn]
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                row, block = np.divmod(key[start], blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.astype(np.int32)), *(some.column(c).take(pa.array(row)) for c in ("q_id", "vec", "norm")),
                     pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), near.flatten().take(pa.array(turn)))],
                    names=["cb", "q_id", "vec", "norm", "near"])
    return run


def _reranked(k: int):
    """Cosines of a block's queries with those of their candidates that lie in a block of vectors; each query's best ``k`` of them."""
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(queries) and len(vectors):
            ids = vectors.column("repository_id").to_numpy()
            turn = np.argsort(ids, kind="stable")
            q_ids, q, x = queries.column("q_id").to_numpy(), vector_rows(queries.column("vec")), vector_rows(vectors.column("c_unit"))
            q_norm, x_norm = queries.column("norm").to_numpy(), vectors.column("c_norm").to_numpy()
            near = queries.column("near").combine_chunks()
            ends = np.cumsum(near.value_lengths().to_numpy())
            wanted = near.flatten().to_numpy()
            size, pairs = 1 << 12, max(1, _QUERY_VALUES // x.shape[1])
            for lo in range(0, len(q_ids), size):
                start, last = (ends[lo - 1] if lo else 0), ends[min(lo + size, len(ends)) - 1]
                some = wanted[start:last]
                row = lo + np.searchsorted(ends[lo:lo + size], np.arange(start, last), side="right")
                i, j = np.searchsorted(ids, some, sorter=turn), np.searchsorted(ids, some, side="right", sorter=turn)
                row, first = np.repeat(row, j - i), np.repeat(i - (np.cumsum(j - i) - (j - i)), j - i)
                at = turn[first + np.arange(len(row))]
                cosine = np.zeros(len(row))
                for n in range(0, len(row), pairs):
                    i, j = row[n:n + pairs], at[n:n + pairs]
                    cosine[n:n + pairs] = np.einsum("ij,ij->i", unit_rows(q[i], q_norm[i]), unit_rows(x[j], x_norm[j]))
                best = _best_of(k, row, ids[at], cosine)
                out.append((q_ids[row[best]], ids[at[best]], cosine[best]))
        return pa.table(dict(zip(("source_id", "candidate_id", "cosine"), (np.concatenate(c) for c in zip(*out)))))
    return run


def search_index(index: StoredIndex, queries: DataFrame, vectors: DataFrame, k: int = 10, rerank: int | None = None) -> DataFrame:
    """The ``k`` nearest stored vectors of every query by exact cosine among those the index finds, self excluded.

    ``queries`` and ``vectors`` have (repository_id, embedding); ``vectors`` is
    what the index was built from. Lists are never short: a query probes
    further lists until they hold enough entries. ``rerank`` codes (2 k + 50 by
    default) are scored exactly for each query.
    → source_id, candidate_id, cosine, rank
    """
    spark = queries.sparkSession
    rerank = rerank or 2 * k + 50
    dim, total = index.model.dim, int(index.sizes.sum())
    tasks = 2 * spark.sparkContext.defaultParallelism
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = F.col("repository_id").isNotNull()  # a neighbour, or a query with neighbours, has an id
    q = materialized(normed_vectors(queries).where(known).withColumnRenamed("repository_id", "q_id"), "queries")
    n_q = q.count()
    # Blocks as small as memory wants; more of them, then more groups, for the tasks to share.
    q_blocks = max(1, -(-n_q * dim // _QUERY_VALUES), min(-(-n_q // 1024), tasks))
    most = min(BLOCK_ROWS, BLOCK_BYTES // (len(index.model.books) + 16))
    first, copies = _groups(index.sizes, max(1, min(most, max(1024, -(-total // -(-tasks // q_blocks))))))
    groups = int((first + copies).max(initial=1))
    probed = materialized(q.select("q_id", unit_column().cast("array<float>").alias("unit")).mapInArrow(
        _probed(index, rerank + 1, first, copies), "grp int, q_id long, unit array<float>, lists binary"), "probed")
    seen = probed.select("lists").mapInArrow(_lists_probed(-(-len(index.sizes) // 8)), "l int").distinct()
    lists = [r["l"] for r in seen.collect()]  # so many at most as there are lists
    place = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, copies))], "list int, first int, copies int")
    # A filter on the column the files are ordered by: row groups of other lists are not read.
    entries = index.entries(spark).where(F.col("list").isin(lists) & known).join(F.broadcast(place), "list").select(
        (F.col("first") + block("repository_id", F.col("copies"))).cast("int").alias("grp"), every(q_blocks).alias("qb"), "list", "repository_id", "code")
    # A pair of blocks is long work on little data: tasks are counted by pairs, not sized by bytes.
    n = min(2 * groups * q_blocks, 4096)
    probed = probed.select("grp", block("q_id", q_blocks).alias("qb"), "q_id", "unit", "lists").repartition(n, "grp", "qb")
    found = (probed.groupBy("grp", "qb").cogroup(entries.repartition(n, "grp", "qb").groupBy("grp", "qb"))
             .applyInArrow(_scored(index.model, rerank), "q_id long, near array<long>, approx array<float>"))
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("approx", "near"), lambda x: F.struct((-x["approx"]).alias("far"), x["near"].alias("id")))))
    best = F.slice(F.sort_array(pairs), 1, rerank)
    found = found.groupBy("q_id").agg(F.transform(best, lambda x: x["id"]).alias("near"))
    # Vectors travel by blocks, a few times each, not once for every pair.
    rows = max(1, _RERANKED_VALUES // dim)
    r_blocks, c_blocks = _block_count(n_q, rows), max(1, -(-total // rows))
    near = found.join(q, "q_id").select("q_id", "vec", "norm", "near", F.transform("near", lambda x: block(x, c_blocks)).alias("cbs"))
    near = near.mapInArrow(_dealt(c_blocks), f"cb int, q_id long, vec {q.schema['vec'].dataType.simpleString()}, norm double, near array<long>")
    near = near.withColumn("qb", block("q_id", r_blocks))
    stored = normed_vectors(vectors).where(known).select(every(r_blocks).alias("qb"), block("repository_id", c_blocks).alias("cb"), "repository_id",
                                                         F.col("vec").alias("c_unit"), F.col("norm").alias("c_norm"))  # unit but for its norm
    n = min(2 * r_blocks * c_blocks, 4096)
    near, stored = near.repartition(n, "qb", "cb"), stored.repartition(n, "qb", "cb")
    ranked = near.groupBy("qb", "cb").cogroup(stored.groupBy("qb", "cb")).applyInArrow(_reranked(k), TOPK_SCHEMA)
    ranked = by_source(ranked, n_q * min(k * c_blocks, rerank))
    w = Window.partitionBy("source_id").orderBy(F.desc("cosine"), F.asc("candidate_id"))
    return ranked.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def search_work(index: StoredIndex, queries: DataFrame, k: int = 10, rerank: int | None = None) -> DataFrame:
    """What a search costs each query, as shares of the dot products of an exact search.

    exact_share: dot products with centroids and re-ranked vectors;
    scanned_share: codes scored, by products in single precision.
    → source_id, exact_share, scanned_share
    """
    rerank = rerank or 2 * k + 50
    model, total = index.model, max(1, int(index.sizes.sum()) - 1)

    @F.pandas_udf("long")
    def scanned(units: pd.Series) -> pd.Series:
        coarse = np.stack(units.to_numpy()).astype(np.float32) @ model.centroids.T
        seen = []
        for lo in range(0, len(coarse), 1024):
            _, held, n = _probes(index, coarse[lo:lo + 1024], rerank + 1)
            seen.append(held[np.arange(len(n)), n - 1])
        return pd.Series(np.concatenate(seen))

    u = unit_vectors(queries).select("repository_id", F.col("unit").cast("array<float>").alias("unit"))
    seen = scanned("unit")
    return u.select(F.col("repository_id").alias("source_id"), seen.alias("n")).select(
        "source_id", ((F.least(F.lit(rerank), F.col("n")) + F.lit(len(model.centroids))) / F.lit(float(total))).alias("exact_share"),
        (F.col("n") / F.lit(float(total + 1))).alias("scanned_share"))


def search_report(index: StoredIndex, queries: DataFrame, vectors: DataFrame, exact: DataFrame, k: int = 10, rerank: int | None = None) -> DataFrame:
    """Every query's recall of the exact top k and the work done for it.

    ``exact`` holds (source_id, candidate_id, cosine, rank). A neighbour counts
    as found if its cosine reaches the exact kth one, so ties do not matter.
    → source_id, n, recall, exact_share, scanned_share
    """
    got = search_index(index, queries, vectors, k, rerank)
    kth = exact.groupBy("source_id").agg(F.min("cosine").alias("_kth"), F.count(F.lit(1)).alias("_n"))
    met = got.join(kth, "source_id").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.when(F.col("cosine") >= F.col("_kth") - 1e-9, 1)) / F.max("_n")).alias("recall"))
    return search_work(index, queries, k, rerank).join(met, "source_id", "left").select(
        "source_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("recall", F.lit(0.0)).alias("recall"), "exact_share", "scanned_share")
