"""Prefix trie of conversations by the Euler-tour technique.

1. Every conversation's prefixes are keyed by depth and a running 128-bit
   exclusive-or of hashes of (place, role, text): prefixes of all lengths in
   one pass, without their texts. Equal keys are one trie node, named by its
   smallest member and its depth.
2. A node has an enter and an exit arc. Children follow one another by
   smallest member, so the child that shares its parent's smallest member
   comes first, and the nodes of one smallest member form a path whose enter
   arcs are consecutive in the tour, as are its exit arcs between branches.
   Such runs of arcs are the elements of a linked list.
3. The list is ranked distributedly: elements whose hash is less than both
   neighbours' are spliced out (a third of them each round) until a few are
   left, and put back in reverse order.
4. Positions of runs give positions of arcs; prefix sums over arc positions
   of leaves and savings give every subtree's as a difference.

Windows span bounded stretches of positions only: a conversation, a first
turn or a parent that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.functions.ordinal import global_rank

from .common import saved

#: Rows of one window.
STRETCH = 4096
#: Elements of the list that one task ranks, after all others are spliced out.
BASE = 4096

NODE = ["depth", "x1", "x2"]


def _hash(seed: int, *cols) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """Turns in order, without their texts: conv_id, place (from 1), h1, h2 (hashes of role and text), n_bytes.

    Order: turn number, null first; ties by the hashes. Null roles and texts
    are empty. Rows without a conversation id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        _hash(1, role, text).alias("h1"), _hash(2, text, role).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"))
    ranked = global_rank(rows, [F.asc("conv_id"), F.asc("turn"), F.asc("h1"), F.asc("h2")], "_r")
    first = ranked.groupBy("conv_id").agg((F.min("_r") - 1).alias("_before"))
    return ranked.join(first, "conv_id").select("conv_id", (F.col("_r") - F.col("_before")).alias("place"), "h1", "h2", "n_bytes")


def rebuilt(turns: DataFrame, group: int = 5, lengths: int = 9) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % group in place of its own.

    h is the crc32 of the id written in decimal, modulo ``lengths``; the donor
    gives all its turns if it has fewer, none if it is absent. Columns as
    ``turns_of``, and length (of the rebuilt conversation). A conversation
    left without a turn has one row with place 0.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % lengths).alias("h")
    own_n = turns.groupBy("conv_id").agg(F.max("place").alias("own")).select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % group).alias("donor"), "own")
    donors = own_n.select(F.col("conv_id").alias("donor"), F.col("own").alias("given"))
    shape = own_n.join(donors, "donor", "left").select(
        "conv_id", "donor", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("taken"), "own")
    shape = shape.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    shape = saved(shape, "shape")
    lent = turns.where(F.col("place") < lengths).withColumnRenamed("conv_id", "donor")
    head = shape.join(lent, "donor").where("place <= taken").select("conv_id", "place", "h1", "h2", "n_bytes", "length")
    tail = turns.join(shape.select("conv_id", "h", "taken", "length"), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "h1", "h2", "n_bytes", "length")
    none = shape.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("h1"),
                                            F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("n_bytes"), "length")
    return head.unionByName(tail).unionByName(none)


def prefixes(talks: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2 (the prefix), p1, p2 (the prefix without its last turn), n_bytes, length."""
    talks = talks.where("place > 0").select("*", _hash(3, "place", "h1", "h2").alias("k1"), _hash(4, "place", "h2", "h1").alias("k2"),
                                            F.floor((F.col("place") - 1) / STRETCH).alias("_s"))
    inside = Window.partitionBy("conv_id", "_s").orderBy("place")
    local = talks.select("*", F.bit_xor("k1").over(inside).alias("y1"), F.bit_xor("k2").over(inside).alias("y2"))
    # What the stretches before hold; only conversations of more than one stretch have any.
    whole = talks.where(F.col("length") > STRETCH).groupBy("conv_id", "_s").agg(F.bit_xor("k1").alias("t1"), F.bit_xor("k2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv_id", "_s", F.bit_xor("t1").over(before).alias("b1"), F.bit_xor("t2").over(before).alias("b2"))
    x = local.join(whole, ["conv_id", "_s"], "left")
    zero = F.lit(0).cast("long")
    x = x.select("conv_id", F.col("place").alias("depth"), F.col("y1").bitwiseXOR(F.coalesce("b1", zero)).alias("x1"),
                 F.col("y2").bitwiseXOR(F.coalesce("b2", zero)).alias("x2"), "k1", "k2", "n_bytes", "length")
    return x.select("conv_id", "depth", "x1", "x2", F.when(F.col("depth") == 1, zero).otherwise(F.col("x1").bitwiseXOR(F.col("k1"))).alias("p1"),
                    F.when(F.col("depth") == 1, zero).otherwise(F.col("x2").bitwiseXOR(F.col("k2"))).alias("p2"), "n_bytes", "length")


def list_rank(links: DataFrame, base: int = BASE, rounds: int = 400) -> DataFrame:
    """Positions in a linked list: id, pos (weights before it).

    ``links`` has id (any type that can be joined on), nxt (null at the end)
    and w (the places that the element takes). In each round every element
    whose hash is below both neighbours' leaves the list, and its predecessor
    takes over its weight; no two neighbours leave together. What is left of
    ``base`` elements or fewer is ranked by one task; then the rounds are undone
    from the last, an element standing its weight before its successor. Every
    round is one exchange over the elements left, written to shared storage.
    """
    none = F.lit(None)
    kind = links.schema["id"].dataType
    fresh = links.select("id", "nxt", "w", none.cast(kind).alias("prd")).unionByName(
        links.where("nxt IS NOT NULL").select(F.col("nxt").alias("id"), none.cast(kind).alias("nxt"), none.cast("long").alias("w"), F.col("id").alias("prd")))
    left = saved(fresh.groupBy("id").agg(F.max("nxt").alias("nxt"), F.max("w").alias("w"), F.max("prd").alias("prd")), "list")
    gone: list[DataFrame] = []
    size = left.count()
    for r in range(rounds):
        if size <= base:
            break
        own = F.xxhash64("id", F.lit(r))
        out = F.col("prd").isNotNull() & F.col("nxt").isNotNull() & (own < F.xxhash64("prd", F.lit(r))) & (own < F.xxhash64("nxt", F.lit(r)))
        marked = left.withColumn("out", out)
        leaving, staying = marked.where("out"), marked.where(~F.col("out"))
        gone.append(leaving.select("id", "nxt", "w"))
        new = {"n": none.cast(kind), "p": none.cast(kind)}
        rows = (staying.select("id", "nxt", "w", "prd", new["n"].alias("nxt2"), new["p"].alias("prd2"))
                .unionByName(leaving.select(F.col("prd").alias("id"), none.cast(kind).alias("nxt"), "w", none.cast(kind).alias("prd"),
                                            F.col("nxt").alias("nxt2"), new["p"].alias("prd2")))
                .unionByName(leaving.select(F.col("nxt").alias("id"), none.cast(kind).alias("nxt"), F.lit(0).cast("long").alias("w"),
                                            none.cast(kind).alias("prd"), new["n"].alias("nxt2"), F.col("prd").alias("prd2"))))
        left = saved(rows.groupBy("id").agg(
            F.coalesce(F.max("nxt2"), F.max("nxt")).alias("nxt"), F.sum("w").alias("w"),
            F.coalesce(F.max("prd2"), F.max("prd")).alias("prd")), "list")
        size = left.count()
    if size > base:
        raise RuntimeError("the list did not shrink")

    def walk(table: pa.Table) -> pa.Table:
        ids = [str(x) for x in table.column("id").to_pylist()]
        after = dict(zip(ids, zip((None if x is None else str(x) for x in table.column("nxt").to_pylist()), table.column("w").to_pylist(), range(len(ids)))))
        at = next((i for i, p in zip(ids, table.column("prd").to_pylist()) if p is None), None)
        pos, total = [0] * len(ids), 0
        while at is not None:
            at, w, row = after[at]
            pos[row], total = total, total + w
        return pa.table({"id": table.column("id"), "pos": pa.array(pos, pa.int64())})

    ranked = saved(left.groupBy(F.lit("rest").alias("_rest")).applyInArrow(walk, links.select("id").schema.add("pos", "long")), "ranks")
    for leaving in reversed(gone):
        back = leaving.join(ranked.select(F.col("id").alias("nxt"), F.col("pos").alias("_after")), "nxt").select("id", (F.col("_after") - F.col("w")).alias("pos"))
        ranked = saved(ranked.unionByName(back), "ranks")
    return ranked


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, whose stretches come one after another."""
    at, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for d, x1, x2, ids in zip(*(batch.column(k).to_pylist() for k in (*NODE, "ids"))):
            if (d, x1, x2) != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (d, x1, x2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield _digest_rows(out)
    if at is not None:
        yield _digest_rows([(*at, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    d, x1, x2, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(sha, pa.string())],
                                      names=[*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of the conversations that end at each node.

    A stretch of ids becomes one sorted string (so many distinct ids at most),
    and a node's stretches are hashed as they stream by in order: the digest
    of many ids takes time, as SHA-256 is sequential, but no memory.
    """
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy(*NODE, F.floor(F.col("conv_id") / STRETCH).alias("_s")).agg(joined.alias("ids"))
    return (parts.repartition(*NODE).sortWithinPartitions(*NODE, "_s")
            .select(*NODE, "ids").mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string"))


def prefix_trie(talks: DataFrame) -> DataFrame:
    """The trie of the conversations of ``rebuilt`` (or any table of its shape), a row per node.

    conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes in the subtree),
    saved_tokens (over the subtree, (n_convs - 1) times the bytes of the last
    text), ends_sha256 (of the members that end here). No conversations, no rows.
    """
    zero = F.lit(0).cast("long")
    talks = saved(talks, "talks")
    members = saved(prefixes(talks), "prefixes")
    convs = talks.groupBy("conv_id").agg(F.max("length").alias("length"))
    rows = members.select("conv_id", *NODE, "p1", "p2", "n_bytes", (F.col("depth") == F.col("length")).alias("last")).unionByName(
        convs.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"), zero.alias("n_bytes"),
                     (F.col("length") == 0).alias("last")))
    nodes = saved(rows.groupBy(*NODE).agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
                                          F.max("p1").alias("p1"), F.max("p2").alias("p2")), "nodes")
    digests = ends_digests(rows.where("last").select("conv_id", *NODE))

    # Children and parents.
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    kids = nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("c").alias("pc"))
    nodes = (nodes.join(kids, NODE, "left").join(digests, NODE, "left").join(above, ["depth", "p1", "p2"], "left")
             .select("c", "depth", "pc", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                     ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("save"),
                     F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    nodes = saved(nodes, "trie")

    runs = saved(_runs(nodes), "runs")
    ranked = list_rank(runs.select("id", "nxt", "w"))
    placed = runs.join(ranked, "id")
    arcs = placed.select(F.col("id.c").alias("c"), F.posexplode(F.sequence("high", "low")).alias("_i", "depth"),
                         "pos", (F.col("id.s") < 0).alias("enter"))
    arcs = arcs.select("c", "depth", (F.col("pos") + F.col("_i")).alias("pos"), "enter").join(nodes.select("c", "depth", "n_children", "save"), ["c", "depth"])
    arcs = arcs.select("c", "depth", "pos", F.when(F.col("enter") & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"),
                       F.when(F.col("enter"), F.col("save")).otherwise(0).cast("long").alias("save"))
    sums = _prefix_sums(saved(arcs, "arcs"))
    subtree = sums.groupBy("c", "depth").agg(
        (F.max("leaf_sum") - F.min("leaf_sum") + F.max("leaf")).alias("n_leaves"), (F.max("save_sum") - F.min("save_sum") + F.max("save")).alias("saved_tokens"))
    return nodes.join(subtree, ["c", "depth"]).select(
        F.col("c").alias("conv_id"), "depth", F.col("pc").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _runs(nodes: DataFrame) -> DataFrame:
    """The tour as a list of runs of arcs: id (c, s), nxt, w, high, low.

    s = -1: the enter arcs of path c, from depth ``high``, its top, to ``low``,
    its bottom. Else: its exit arcs from depth s = ``high`` up to ``low``; a new
    one starts at the path's bottom and at every node with a side child (a
    child with another smallest member), after whose subtree it is entered.
    """
    def key(c, s) -> Column:
        return F.struct(F.col(c).alias("c") if isinstance(c, str) else c.alias("c"), (F.col(s) if isinstance(s, str) else s).cast("long").alias("s"))

    minus = F.lit(-1)
    paths = nodes.groupBy("c").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"))
    # Heads of paths below a node, in order; a head's next sibling has the next rank if its parent is the same.
    heads = nodes.where((F.col("depth") > 0) & (F.col("pc") != F.col("c"))).select("c", "pc", (F.col("depth") - 1).alias("at"))
    heads = saved(global_rank(heads, [F.asc("pc"), F.asc("at"), F.asc("c")], "r"), "heads")
    follow = heads.select((F.col("r") - 1).alias("r"), F.col("pc").alias("npc"), F.col("at").alias("nat"), F.col("c").alias("nc"))
    heads = heads.join(follow, "r", "left").select("c", "pc", "at", F.when((F.col("npc") == F.col("pc")) & (F.col("nat") == F.col("at")), F.col("nc")).alias("sibling"))
    heads = saved(heads, "siblings")
    after = heads.select("c", F.when(F.col("sibling").isNotNull(), key("sibling", minus)).otherwise(key("pc", "at")).alias("after"))
    paths = saved(paths.join(after, "c", "left"), "paths")  # the root's path has nothing after it
    first = heads.groupBy(F.col("pc").alias("c"), F.col("at").alias("s")).agg(F.min("c").alias("side"))
    starts = paths.select("c", F.col("bottom").alias("s"), F.lit(None).cast("long").alias("side")).unionByName(first).groupBy("c", "s").agg(F.max("side").alias("side"))
    below = Window.partitionBy("c").orderBy(F.desc("s"))  # the branching nodes of one path
    starts = starts.select("c", "s", "side", F.lead("s").over(below).alias("branch"), F.lead("side").over(below).alias("turn")).join(paths, "c")
    out = starts.select(
        key("c", "s").alias("id"), F.when(F.col("branch").isNotNull(), key("turn", minus)).otherwise(F.col("after")).alias("nxt"),
        F.col("s").alias("high"), F.coalesce(F.col("branch") + 1, F.col("top")).alias("low"))
    down = starts.where("s = bottom").select(
        key("c", minus).alias("id"), F.when(F.col("side").isNotNull(), key("side", minus)).otherwise(key("c", "s")).alias("nxt"),
        F.col("top").alias("high"), F.col("bottom").alias("low"))
    return out.unionByName(down).withColumn("w", F.abs(F.col("high") - F.col("low")) + 1)


def _prefix_sums(arcs: DataFrame) -> DataFrame:
    """Sums of leaf and save up to and with each arc, over dense positions: stretch by stretch, then over the stretches."""
    arcs = arcs.withColumn("_s", F.floor(F.col("pos") / STRETCH))
    inside = Window.partitionBy("_s").orderBy("pos")
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    whole = arcs.groupBy("_s").agg(F.sum("leaf").alias("l"), F.sum("save").alias("v"))
    whole = whole.select("_s", F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v"))
    local = arcs.select("*", F.sum("leaf").over(inside).alias("_l"), F.sum("save").over(inside).alias("_v"))
    return local.join(whole, "_s").select("c", "depth", "leaf", "save", (F.col("l") + F.col("_l")).alias("leaf_sum"), (F.col("v") + F.col("_v")).alias("save_sum"))


#: crc32 of the id's digits, bit by bit; nodes are lists of turns, subtrees all pairs of a node and a prefix of it.
ORACLE = """
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
           md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS n_bytes
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS donor, xor(4294967295::UBIGINT, list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
        lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT)))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
    SELECT c.conv_id, o.place, 0 AS part, said, n_bytes FROM convs c JOIN own o ON o.conv_id = c.donor AND o.place <= c.h
    UNION ALL SELECT c.conv_id, o.place, 1, said, n_bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h),
talks AS (
    SELECT c.conv_id, coalesce(list(said ORDER BY part, place) FILTER (said IS NOT NULL), []) AS path,
           coalesce(list(n_bytes ORDER BY part, place) FILTER (said IS NOT NULL), []) AS sizes
    FROM convs c LEFT JOIN turns t ON t.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, d, path[1:d] AS node, len(path) = d AS last, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS n_bytes
             FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM talks)),
nodes AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS save,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM prefixes GROUP BY node, d),
linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children
    FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.node = n.node[1:n.d - 1] AND p.d = n.d - 1
    LEFT JOIN (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2) k ON k.node = n.node AND k.d = n.d),
subtree AS (
    SELECT node[1:up] AS node, up AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(save) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM linked) GROUP BY 1, 2)
SELECT l.conv_id, l.d AS depth, l.parent_conv_id, l.n_convs, l.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l JOIN subtree s ON s.node = l.node AND s.d = l.d
"""
