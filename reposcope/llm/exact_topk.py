"""Exact top-k inner products by dual-tree search over cover trees.

The top of the index is shared: a bounded sample of the rows gives pivots by
farthest-first traversal, and every row (queries and data together) goes to
the cell of its nearest pivot. Cells larger than a block are split by a hash
of the id. Blocks of queries meet blocks of data; cell pairs whose bound is
below every kth score that the queries already have against the sample are
never sent. Inside a pair both sides are cover trees: a node's children are
farthest-first centres, further apart than the radius that then covers its
points. Node pairs are pruned if the smaller of two bounds is below the worst
kth score under the query node: that of the centres,

    <cq, cx> + rq |cx| + rx |cq| + rq rx,

and that of the distance, since 2 <q, x> = |q|^2 + |x|^2 - |q - x|^2:

    (max |q|^2 + max |x|^2 - max(0, |cq - cx| - rq - rx)^2) / 2.

Pairs of a query and a leaf are pruned by the same bounds with rq = 0. More
vectors have more pivots, so that cells stay narrow. Scores are integers and exact; the sample only supplies first bounds, and
every row is searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import saved

SAMPLE = 2048  # rows that pivots and first bounds come from
PIVOTS, MOST_PIVOTS = 32, 512  # one for each data block, within these
QUERY_BLOCK = 4096
DATA_BLOCK = 8192
LEAF, QUERY_LEAF, FAN = 256, 32, 16  # data leaves are scored by matrix products: a node's cost is paid for by many points
BASE = 1.3  # a node's children cover its points with this much less radius, if FAN of them can


class CoverTree:
    """Nodes as arrays: centre, radius, children or (for leaves) points in order."""

    def __init__(self, points: np.ndarray, leaf: int | None = None):
        self.points, self.leaf = points, leaf or LEAF
        self.order: list[int] = []
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.span: dict[int, tuple[int, int]] = {}
        if len(points):
            self._build(np.arange(len(points)), 0)
        self.centers = np.array(self.center).reshape(len(self.center), points.shape[1])
        self.norms = np.sqrt((self.centers ** 2).sum(axis=1))
        self.radii = np.array(self.radius)
        norms = np.sqrt((points ** 2).sum(axis=1))
        self.longest = np.array([norms[self.order[lo:hi]].max() for _, (lo, hi) in sorted(self.span.items())])

    def _build(self, rows: np.ndarray, center: int) -> int:
        c = self.points[rows[center]]
        gap = np.sqrt(((self.points[rows] - c) ** 2).sum(axis=1))
        node = len(self.center)
        self.center.append(c)
        self.radius.append(float(gap.max()) * (1 + 1e-9))
        self.children.append([])
        start = len(self.order)
        if len(rows) <= self.leaf or gap.max() == 0:
            self.order.extend(rows.tolist())
        else:
            chosen, nearest, target = [center], np.zeros(len(rows), dtype=np.int64), gap.max() / BASE
            while gap.max() > target and len(chosen) < FAN:
                far = int(gap.argmax())
                d = np.sqrt(((self.points[rows] - self.points[rows[far]]) ** 2).sum(axis=1))
                closer = d < gap
                gap[closer], nearest[closer] = d[closer], len(chosen)
                chosen.append(far)
            for i, own in enumerate(chosen):
                mine = np.flatnonzero(nearest == i)
                self.children[node].append(self._build(rows[mine], int(np.flatnonzero(mine == own)[0])))
        self.span[node] = (start, len(self.order))
        return node


def score_bound(dots, cq, rq, qmax, cx, rx, xmax, dim: int):
    """Largest inner product of points within rq and rx of centres with norms cq and cx, of norms up to qmax and xmax.

    Rounding of a dot product is relative to the norms, not to its value: the
    slack is too. Arguments broadcast against each other.
    """
    slack = 1e-15 * (dim + 16) * (cq + rq + cx + rx) ** 2
    far = np.sqrt(np.maximum(0, cq * cq + cx * cx - 2 * dots - slack))
    by_distance = (qmax * qmax + xmax * xmax - np.maximum(0, far - rq - rx) ** 2) / 2
    return np.minimum(dots + rq * cx + rx * cq + rq * rx, by_distance) + slack + 0.5  # scores are integers


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; beyond 64 bits they stop at the ends of the range."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), dtype=np.int64)
    limit = float(np.abs(q).max()) * float(np.abs(x).max()) * max(1, q.shape[1])
    if limit < 2 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if limit < 2 ** 62:
        return q @ x.T
    wide = q.astype(object) @ x.astype(object).T
    return np.vectorize(lambda v: max(-(1 << 63), min((1 << 63) - 1, int(v))), otypes=[np.int64])(wide)


class _Best:
    """The k best (score, id) of each query so far, an id once with its best score, and its bound."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.bound = np.full(len(ids), -np.inf)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.bound[query]) & (ids != self.ids[query])
        scores, ids = scores[ok], ids[ok]
        if len(scores) > self.k:
            top = np.lexsort((ids, ~scores))
            _, once = np.unique(ids[top], return_index=True)
            top = top[np.sort(once)[:self.k]]
            scores, ids = scores[top], ids[top]
        if len(scores):
            once = {}
            for s, i in sorted(self.found[query] + [(-int(s), int(i)) for s, i in zip(scores, ids)]):
                once.setdefault(i, s)
            merged = [(s, i) for i, s in once.items()][:self.k]
            self.found[query] = merged
            if len(merged) == self.k:
                self.bound[query] = max(self.bound[query], -merged[-1][0])


def dual_tree(q_ids: np.ndarray, q: np.ndarray, x_ids: list[np.ndarray], x: np.ndarray, k: int, first_bound: np.ndarray) -> _Best:
    """k best data ids of each query. ``x`` has distinct vectors, ``x_ids`` the ids of each; ``scored`` of the result counts the pairs that no bound pruned."""
    best = _Best(q_ids, k)
    best.bound = first_bound.astype(float).copy()
    best.scored = 0
    queries, data = CoverTree(q.astype(np.float64), QUERY_LEAF), CoverTree(x.astype(np.float64))
    if not len(q) or not len(x):
        return best
    queries_norms = np.sqrt((queries.points ** 2).sum(axis=1))

    def bounds(node: int, others: np.ndarray) -> np.ndarray:
        return score_bound(data.centers[others] @ queries.centers[node], queries.norms[node], queries.radii[node], queries.longest[node],
                           data.norms[others], data.radii[others], data.longest[others], q.shape[1])

    def search(node: int, others: np.ndarray) -> None:
        lo, hi = queries.span[node]
        own = queries.order[lo:hi]
        others = others[bounds(node, others) >= best.bound[own].min()]
        # Data nodes are opened while they are wider than the query node.
        while True:
            wide = np.array([bool(data.children[o]) and (data.radii[o] >= queries.radii[node] or not queries.children[node]) for o in others], dtype=bool)
            if not wide.any():
                break
            opened = np.array([c for o in others[wide] for c in data.children[o]], dtype=np.int64)
            opened = opened[bounds(node, opened) >= best.bound[own].min()]
            others = np.concatenate([others[~wide], opened])
        if queries.children[node]:
            for child in queries.children[node]:
                search(child, others)
            return
        if not len(others):
            return
        order = others[np.argsort(-bounds(node, others), kind="stable")]
        step, norms = 8, queries_norms[own][:, None]
        for i in range(0, len(order), step):
            some = order[i:i + step]
            some = some[bounds(node, some) >= best.bound[own].min()]
            if not len(some):
                break
            single = score_bound(queries.points[own] @ data.centers[some].T, norms, 0.0, norms, data.norms[some], data.radii[some], data.longest[some],
                                 q.shape[1]) >= best.bound[own][:, None]
            some, asking = some[single.any(axis=0)], np.array(own)[single.any(axis=1)]
            if not len(some):
                continue
            points = np.concatenate([data.order[slice(*data.span[o])] for o in some]).astype(np.int64)
            scores = exact_scores(q[asking], x[points])
            best.scored += scores.size
            for row, query in enumerate(asking):
                near = np.flatnonzero(scores[row] >= best.bound[query])
                if len(near):
                    ids = [x_ids[p] for p in points[near]]
                    best.add(query, np.repeat(scores[row][near], [len(i) for i in ids]), np.concatenate(ids))

    search(0, np.zeros(1, dtype=np.int64))
    return best


def _matrix(column, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` integers; missing components are 0."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.stack([np.sqrt(((v - p) ** 2.0).sum(axis=1)) for p in pivots], axis=1)
    cell = d.argmin(axis=1)
    return cell, d[np.arange(len(v)), cell]


def _assign(pivots: np.ndarray, coarse: int, dim: int, sample: np.ndarray, sample_ids: np.ndarray, k: int, every: int):
    """A row's cell and distance; a query's kth score against the sample as well."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                v = _matrix(part.column(1), dim)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                cell, gap = _nearest(v, pivots)
                qcell, qgap = _nearest(v, pivots[:coarse])
                query = ids % every == 0
                bound = np.full(len(ids), -np.inf)
                at = np.flatnonzero(query)
                if len(at):
                    scores = exact_scores(v[at], sample).astype(float)
                    scores[ids[at][:, None] == sample_ids[None, :]] = -np.inf
                    if scores.shape[1] >= k:
                        bound[at] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0), "v": part.column(1), "cell": pa.array(cell, pa.int32()), "gap": pa.array(gap),
                    "query": pa.array(query), "qcell": pa.array(qcell, pa.int32()), "qgap": pa.array(qgap), "bound": pa.array(bound)})
    return run


def _search(dim: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            x_all = _matrix(right.column("xv"), dim)
            ids = right.column("xid").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, *x_all.T[::-1]))
            x_all, ids = x_all[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], (x_all[1:] != x_all[:-1]).any(axis=1)]))
            ends = np.concatenate([first[1:], [len(ids)]])
            # Of equal vectors only the least ids can be among the best: k, and one that may be the query's own.
            best = dual_tree(left.column("qid").to_numpy(zero_copy_only=False), _matrix(left.column("qv"), dim),
                             [_least(ids[a:b], k + 1) for a, b in zip(first, ends)], x_all[first], k, left.column("b").to_numpy(zero_copy_only=False))
            for own, found in zip(best.ids, best.found):
                out["query_id"] += [int(own)] * len(found)
                out["vec_id"] += [i for _, i in found]
                out["score"] += [-s for s, _ in found]
        return pa.table({c: pa.array(out[c], pa.int64()) for c in out})
    return run


def _least(ids: np.ndarray, n: int) -> np.ndarray:
    return np.unique(ids)[:n]


def exact_topk(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, sample: int = SAMPLE, pivots: int | None = None,
               id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of every query: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x). Queries are the rows whose id is
    divisible by ``every``; candidates are all rows of another id. Ties go to
    the smaller id; fewer candidates than k are all returned. Vectors that are
    null or hold null, NaN or infinite components, and rows with a null id,
    take no part. Vectors of different lengths are compared as if the shorter
    ended in zeros. Rows that repeat an id are all candidates (the id counts
    once, with its best score). Other columns are ignored; an empty table
    gives no rows.
    """
    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e")).filter("vec_id IS NOT NULL AND e IS NOT NULL")
    rows = rows.filter(F.forall("e", fine)).select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    spark = vectors.sparkSession
    n, queries, dim = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)), F.max(F.size("v"))).first()
    if not n or not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, n // DATA_BLOCK))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    points, ids = _matrix(some.column("v"), dim), some.column("vec_id").to_numpy()
    _, once = np.unique(ids, return_index=True)  # a first bound needs k different ids
    points, ids = points[once], ids[once]
    chosen, gap = [0], np.sqrt(((points - points[0]) ** 2.0).sum(axis=1))
    while len(chosen) < pivots and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.sqrt(((points - points[chosen[-1]]) ** 2.0).sum(axis=1)))
    top = points[chosen]
    coarse = min(len(top), -(-queries // QUERY_BLOCK))
    placed = saved(rows.mapInArrow(_assign(top, coarse, dim, points, ids, k, every),
                                   "vec_id long, v array<long>, cell int, gap double, query boolean, qcell int, qgap double, bound double"), "topk-cells")
    # At most `pivots` rows each: sizes, radii, largest norms and the worst bound of the cells.
    norm = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))).alias("m")
    data = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r"), norm).collect()
    asked = placed.filter("query").groupBy("qcell").agg(F.count(F.lit(1)).alias("n"), F.max("qgap").alias("r"), F.min("bound").alias("b"), norm).collect()
    norms = np.sqrt((top.astype(float) ** 2).sum(axis=1))
    cells, radii, longest = np.array([x["cell"] for x in data]), np.array([x["r"] for x in data]), np.array([x["m"] for x in data])
    pairs = []
    for q in asked:
        own = q["qcell"]
        bound = score_bound(top[cells].astype(float) @ top[own].astype(float), norms[own], q["r"], q["m"], norms[cells], radii, longest, dim)
        pairs += [(own, x["cell"], -(-q["n"] // QUERY_BLOCK), -(-x["n"] // DATA_BLOCK)) for x, b in zip(data, bound) if b >= q["b"]]
    table = F.broadcast(spark.createDataFrame(pairs, "qcell int, cell int, _nq int, _nx int"))  # pivots squared at most
    spread = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    left = (placed.filter("query").join(table, "qcell").withColumn("_xs", each("_nx"))
            .select(F.col("qcell").alias("q1"), spread("_nq").alias("q2"), table["cell"].alias("q3"),
                    F.col("_xs").alias("q4"), F.col("vec_id").alias("qid"), F.col("v").alias("qv"), F.col("bound").alias("b")))
    right = (placed.join(table, "cell").withColumn("_qs", each("_nq"))
             .select(table["qcell"].alias("x1"), F.col("_qs").alias("x2"), F.col("cell").alias("x3"), spread("_nx").alias("x4"),
                     F.col("vec_id").alias("xid"), F.col("v").alias("xv")))
    found = left.groupBy("q1", "q2", "q3", "q4").cogroup(right.groupBy("x1", "x2", "x3", "x4")).applyInArrow(
        _search(dim, k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
