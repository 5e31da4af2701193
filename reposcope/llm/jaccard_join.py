"""N-gram Jaccard join by a count-vector R-tree.

Documents are sets of word shingles; two link if their Jaccard likeness
reaches a threshold. The join loses no link:

1. Equal sets become one node, represented by its least document.
2. Nodes that can link meet. Shingles are put in order of how many documents
   hold them, rarest first (blocks of documents ask for the counts of their
   shingles, packed, and get back a class of count for each; ties go by
   hash). A set's prefix is its first n - ceil(t n) + 1 shingles in that
   order: two sets that link share one in both their prefixes. A shingle that
   no other document holds leads nowhere, so a set sends only the shared ones
   of its prefix, and one with enough shingles of its own sends none.
3. Nodes joined by keys form candidate families. A family's sets are indexed
   by count vectors (shingles dealt into groups, counted) in an R-tree. The
   sum of coordinate minima bounds the overlap of two sets, and of two nodes
   of the tree by their corners; pairs that pass are verified exactly.
   Families larger than a block are cut into blocks, and pairs of blocks are
   tasks of their own.
4. Links are counted per node and joined into components.

No pair of documents is ever a row: keys connect to the least node that has
them, and verified links leave a task as counts and one edge per node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import connected_components
from .packed import frugal, frugal_pair, pack, pack_sorted, text_buffer, unpack, unpack_sorted
from .words import shingles, words

SIZE = 3
THRESHOLD = (90, 100)
BLOCK = 512  # sets of a family that are indexed together
BLOCK_ROWS, PART_ROWS = 2048, 4096  # documents of a block, and those whose shingles a part counts, on average
LEAF = 16
#: Candidate ids up to which they are broadcast to the second reading of the texts (16 bytes each).
BROADCAST = 500_000


def needed(a, b, threshold=THRESHOLD):
    """Least overlap of linked sets of sizes a and b: 100 I >= 90 (a + b - I)."""
    num, den = threshold
    return -(-num * (a + b) // (num + den))


def smallest(threshold=THRESHOLD) -> int:
    """Size of the smallest set that another, different set can link to."""
    num, den = threshold
    return next(n for n in range(1, 1 << 20) if den * n >= num * (n + 1))


def _node(s: np.ndarray) -> int | None:
    """64-bit digest of a set, None for the empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _batch_sets(batches, size: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            raw, offsets = text_buffer(part.column(part.schema.get_field_index("text")))
            yield part, shingles(*words(raw, offsets), size)


def _block_sets(table: pa.Table, size: int, parts: int):
    """A block's sets and their nodes; its distinct shingles, ascending, with the nodes that hold each and the part that counts them."""
    raw, offsets = text_buffer(table.column("text"))
    sets = shingles(*words(raw, offsets), size)
    nodes = [_node(s) for s in sets]
    once = list({n: s for n, s in zip(nodes, sets) if n is not None}.values())
    known, count = np.unique(np.concatenate(once) if once else np.zeros(0, np.uint64), return_counts=True)
    return sets, nodes, known, count, ((known >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _ask(size: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, known, count, part = _block_sets(table, size, parts)
        asked = [(int(p), pack_sorted(known[part == p]), pack(count[part == p].astype(np.uint32))) for p in np.unique(part)]
        number = table.column("_block")[0].as_py()
        return pa.table({"_p": pa.array([a[0] for a in asked], pa.int64()), "_block": pa.array([number] * len(asked), pa.int64()),
                         "hashes": pa.array([a[1] for a in asked], pa.binary()), "counts": pa.array([a[2] for a in asked], pa.binary())})
    return run


def _count(table: pa.Table) -> pa.Table:
    """A class of count for every shingle that a block asked for: 0 for one holder, then eight classes to each doubling."""
    asked = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    counts = [unpack(x, np.uint32) for x in table.column("counts").to_pylist()]
    known, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts).astype(float), minlength=len(known))
    rank = np.minimum(255, np.rint(8 * np.log2(total))).astype(np.uint8)
    p = table.column("_p")[0].as_py()
    replies = [pack(rank[own]) for own in np.split(place, np.cumsum([len(a) for a in asked])[:-1])]
    return pa.table({"_block": table.column("_block"), "_p": pa.array([p] * len(replies), pa.int64()), "ranks": pa.array(replies, pa.binary())})


def prefix_keys(s: np.ndarray, rank: np.ndarray, threshold=THRESHOLD) -> np.ndarray:
    """The shared shingles of a set's prefix; rank is each shingle's class of count, 0 if no other set has it."""
    num, den = threshold
    n = len(s)
    if n < smallest(threshold):  # links with equal sets only
        return s[:0]
    length = n - -(-num * n // den) + 1
    if int((rank == 0).sum()) >= length:
        return s[:0]
    first = np.lexsort((s, rank))[:length]
    return s[first[rank[first] > 0]]


def _routed(size: int, threshold, parts: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets, nodes, known, _, part = _block_sets(table, size, parts)
        rank = np.zeros(len(known), dtype=np.uint8)
        for p, ranks in zip(answers.column("_p").to_pylist(), answers.column("ranks").to_pylist()):
            rank[part == p] = unpack(ranks, np.uint8)
        keys = [prefix_keys(s, rank[np.searchsorted(known, s)], threshold).view(np.int64) for s in sets]
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return pa.table({"doc_id": table.column("doc_id").combine_chunks(), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(nodes, pa.int64()),
                         "keys": pa.ListArray.from_arrays(pa.array(at), pa.array(flat))})
    return run


def _wanted_sets(size: int):
    """The sets of the nodes asked for; of rows that repeat an id with another text, the one that is meant."""
    def run(batches):
        for part, sets in _batch_sets(batches, size):
            get = lambda c: part.column(part.schema.get_field_index(c))
            keep = pa.array([_node(s) == x for s, x in zip(sets, get("node").to_pylist())], pa.bool_())
            cols = {"rep": get("doc_id"), "hashes": pa.array([s.tobytes() for s in sets], pa.binary()),
                    **{c: get(c) for c in ("node", "copies", "family", "blocks", "block")}}
            yield pa.RecordBatch.from_pydict(cols).filter(keep)
    return run


class CountTree:
    """R-tree over count vectors: packed by sorting on size and on the largest spread, LEAF points to a leaf."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.concatenate(self._tile(np.arange(len(sizes)), vectors, sizes)) if len(sizes) else np.zeros(0, np.int64)
        v, n = vectors[self.order], sizes[self.order]
        self.vectors, self.sizes = v, n
        at = np.arange(0, len(n), LEAF)
        levels = [(np.maximum.reduceat(v, at), np.minimum.reduceat(n, at), np.maximum.reduceat(n, at))] if len(n) else []
        while levels and len(levels[-1][1]) > 1:
            top, low, high = levels[-1]
            at = np.arange(0, len(low), LEAF)
            levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        self.levels = levels

    def _tile(self, rows: np.ndarray, vectors: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= LEAF:
            return [rows]
        v = np.concatenate([sizes[rows][:, None], vectors[rows].astype(np.int64)], axis=1)
        axis = int(np.argmax(v.max(axis=0) - v.min(axis=0)))
        rows = rows[np.argsort(v[:, axis], kind="stable")]
        cut = -(-len(rows) // (2 * LEAF)) * LEAF
        return self._tile(rows[:cut], vectors, sizes) + self._tile(rows[cut:], vectors, sizes)

    def near(self, top: np.ndarray, low: int, high: int, threshold) -> np.ndarray:
        """Points (in tree order) of the leaves that may link to a box with these largest coordinates and sizes."""
        num, den = threshold
        alive = np.arange(len(self.levels[-1][1])) if self.levels else np.zeros(0, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, lows, highs = (x[alive] for x in self.levels[depth])
            bound = np.minimum(tops, top[None, :]).sum(axis=1, dtype=np.int64)
            ok = (bound >= needed(lows + 0, low, threshold)) & (den * highs >= num * low) & (den * high >= num * lows)
            alive = alive[ok]
            alive = (alive[:, None] * LEAF + np.arange(LEAF)[None, :]).ravel()
            alive = alive[alive < (len(self.levels[depth - 1][1]) if depth else len(self.sizes))]
        return alive


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold):
    """Linked pairs (positions) between two lists of sets, or within one: yields (i, js)."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    groups = int(min(512, max(16, 2 ** int(np.ceil(np.log2(max(1.0, sizes.mean() / 12)))))))
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    vectors = np.bincount(owner * groups + ((flat >> np.uint64(20)) % np.uint64(groups)).astype(np.int64), minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.int32)
    vocabulary, ids = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(vocabulary), dtype=np.int32)
    tree = CountTree(vectors[right], sizes[right])
    for lo in range(0, len(left), LEAF):
        own = left[lo:lo + LEAF]
        found = tree.near(vectors[own].max(axis=0), int(sizes[own].min()), int(sizes[own].max()), threshold)
        if not len(found):
            continue
        others = right[tree.order[found]]
        for i in own:
            js = others[others > i] if same else others
            bound = np.minimum(vectors[js], vectors[i][None, :]).sum(axis=1)
            js = js[bound >= needed(sizes[js], sizes[i], threshold)]
            if not len(js):
                continue
            mark[ids[at[i]:at[i + 1]]] = 1
            n = sizes[js]
            ends = np.cumsum(n)
            places = np.arange(ends[-1]) + np.repeat(at[js] - (ends - n), n)
            overlap = np.add.reduceat(mark[ids[places]], ends - n)
            mark[ids[at[i]:at[i + 1]]] = 0
            js = js[overlap >= needed(n, sizes[i], threshold)]
            if len(js):
                yield int(i), js


def _verify(threshold):
    def run(table: pa.Table) -> pa.Table:
        _, once = np.unique(np.array([f"{n} {b}" for n, b in zip(table.column("node").to_pylist(), table.column("_block").to_pylist())]), return_index=True)
        table = table.take(pa.array(np.sort(once)))  # a repeated row is one node
        node = table.column("rep").to_numpy(zero_copy_only=False)
        copies = table.column("copies").to_numpy(zero_copy_only=False)
        family = table.column("family").to_numpy(zero_copy_only=False)
        block, one, two = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_block", "_one", "_two"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        links = np.zeros(len(node), dtype=np.int64)
        parent = np.arange(len(node))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        order = np.argsort(family, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], family[order][1:] != family[order][:-1]]))
        for rows in np.split(order, cuts[1:]):
            own = [sets[r] for r in rows]
            same = one[rows[0]] == two[rows[0]]
            a = np.arange(len(rows)) if same else np.flatnonzero(block[rows] == one[rows])
            b = a if same else np.flatnonzero(block[rows] == two[rows])
            for i, js in _links(own, a, b, same, threshold):
                links[rows[i]] += copies[rows[js]].sum()
                links[rows[js]] += copies[rows[i]]
                for j in js:
                    x, y = root(rows[i]), root(rows[j])
                    if x != y:
                        parent[max(x, y, key=lambda z: node[z])] = min(x, y, key=lambda z: node[z])
        tops = np.array([node[root(i)] for i in range(len(node))], dtype=np.int64)
        hit = links > 0
        return pa.table({"node": table.column("node").filter(pa.array(hit)), "rep": pa.array(node[hit], pa.int64()), "links": pa.array(links[hit], pa.int64()), "root": pa.array(tops[hit], pa.int64()),
                         "large": pa.array(table.column("_big").to_numpy(zero_copy_only=False)[hit], pa.bool_())})
    return run


def jaccard_join(docs: DataFrame, size: int = SIZE, threshold=THRESHOLD, block: int = BLOCK,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shingle sets linked at a Jaccard likeness of ``threshold`` (a fraction): one row per input row.

    Returns doc_id, n_shingles, component_id (least doc_id reachable by
    links) and n_links (rows that the row links to, itself not counted). A
    null or empty text, or one of white space only, has an empty set and
    links with nothing. Equal sets link, of rows that repeat an id too. A row
    with a null id takes no part; its component is null and its links 0.
    Other columns are ignored; an empty table gives no rows. Shingles are
    64-bit hashes.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = base.count()
    blocks, parts = max(1, total // BLOCK_ROWS), max(1, total // PART_ROWS)
    # One exchange, read by two steps: both need these columns as they are. Rows without an id are dealt by their text.
    dealt = base.withColumn("_block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)).cast("long"))
    counted = (dealt.groupBy("_block").applyInArrow(frugal(_ask(size, parts)), "_p long, _block long, hashes binary, counts binary")
               .groupBy("_p").applyInArrow(frugal(_count), "_block long, _p long, ranks binary"))
    rows = saved(dealt.groupBy("_block").cogroup(counted.groupBy("_block")).applyInArrow(
        frugal_pair(_routed(size, threshold, parts)), "doc_id long, n long, node long, keys array<long>"), "jaccard-sets")
    full = rows.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    # Equal sets have equal keys: they are taken once per node, however many copies it stands for.
    nodes = saved(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "jaccard-nodes")

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # A partial aggregate and a join back, so that a key of very many nodes is no single task.
    least = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    near = keyed.join(least, "key").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    nodes = nodes.drop("keys")
    families = connected_components(near)
    members = saved(families.select("node", F.col("component").alias("family")).join(nodes, "node"), "jaccard-families")
    count = members.count()

    per = members.groupBy("family").agg(F.count(F.lit(1)).alias("_n"))
    bins = max(1, count // block)
    listed = members.join(per, "family").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    wanted = listed.select(F.col("rep").alias("doc_id"), "node", "copies", "family", F.col("_blocks").cast("long").alias("blocks"),
                           F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("long").alias("block"))
    if count <= BROADCAST:
        wanted = F.broadcast(wanted)
    sets = base.join(wanted, "doc_id").mapInArrow(
        _wanted_sets(size), "rep long, hashes binary, node long, copies long, family long, blocks long, block long")
    spread = (sets.withColumnRenamed("blocks", "_blocks").withColumnRenamed("block", "_block")
              .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
              .withColumn("_one", F.least("_block", "_other")).withColumn("_two", F.greatest("_block", "_other"))
              # Families of one block share tasks; a larger family has one for each pair of its blocks.
              .withColumn("_task", F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.xxhash64("family", "_one", "_two")))
              .withColumn("_big", F.col("_blocks") > 1)
              .select("_task", "_big", "_one", "_two", "_block", "node", "rep", "copies", "family", "hashes"))
    found = saved(spread.groupBy("_task", "_big", "_one", "_two").applyInArrow(frugal(_verify(threshold)), "node long, rep long, links long, root long, large boolean"), "jaccard-links")
    # A family of one block was joined by its task; larger ones are joined over their tasks. An id that stands for
    # several sets (rows that repeat it with other texts) may join families: then all are.
    per_id = found.groupBy("rep").agg(F.min("root").alias("_a"), F.max("root").alias("_b"),
                                      F.min("large").alias("_all_large"), F.max("large").alias("_any_large"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"), "large")
    if per_id.filter("NOT _all_large AND (_a <> _b OR _any_large)").isEmpty():
        joined = (edges.filter("NOT large").select(F.col("a").alias("node"), F.col("b").alias("component"))
                  .unionByName(connected_components(edges.filter("large").drop("large"))).distinct())
    else:
        joined = connected_components(edges.drop("large"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = (nodes.join(links, "node", "left").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
              .select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    return (full.select("doc_id", "n", "node").join(result, "node")
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
            .unionByName(rows.filter("node IS NULL OR doc_id IS NULL")
                         .select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(a) < 3 THEN array_to_string(a, ' ') ELSE a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] END AS g
      FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 1, 2))) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
