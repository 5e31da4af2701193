"""The conversation trie against plain Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposcope.llm import prefix_trie as PT

TALKS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType()),
                      *(T.StructField(n, T.StringType()) for n in ("place", "depth", "h", "c", "pc", "id", "_s", "rank"))])
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def talks(seed=4):
    rng = random.Random(seed)
    said = ["hi", "hello", "", None, "what é", "漢字", "ok"]
    out = []
    for c in [*range(-12, 70), 1000, 10**12, -10**12 - 3, 2**62]:
        first = rng.choice([None, 0, 1])
        for t in range(rng.choice([0, 1, 2, 3, 6, 14])):
            out.append((c, first if t == 0 else t + 1, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else ["user", "assistant"][t % 2],
                        rng.choice(said) if t > 1 or rng.random() < 0.2 else "hi"))
    out += [(3, None, "user", "a"), (77, 0, "user", "x" * 20_000)]
    out += [(c, t, "user", "same") for c in range(500, 540) for t in range(4)]
    out += [(901, t, "user", str(t % 3)) for t in range(120)]  # a long one, and one that follows it for a while
    out += [(906, t, "user", str(t % 3) if t < 90 else "off") for t in range(120)]
    out += [(None, 0, "user", "no id"), (None, 1, "user", "no id")]
    seen, rows = set(), []
    for r in out:  # turns of a conversation differ, but for repeated rows
        if (r[0], r[1]) not in seen:
            rows.append((*r, *"abcdefgh"))
        seen.add((r[0], r[1]))
    return [*rows, (88, 5, "user", "twice", *"abcdefgh"), (88, 5, "user", "twice", *"abcdefgh")]


def reference(data):
    by = {}
    for c, turn, role, text, *_ in data:
        if c is not None:
            by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(rows)] for c, rows in by.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    nodes = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in nodes:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    for node in sorted(nodes, key=len, reverse=True):
        own_save = (len(nodes[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) if node in kids else 1
        saved[node] = own_save + sum(saved[k] for k in kids.get(node, []))
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(made[c]) == len(n)))).encode()).hexdigest())
                  for n, m in nodes.items()) if nodes else []


def trie(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in PT.prefix_trie(PT.rebuilt(PT.turns_of(df))).collect())


def key(rows):
    return [tuple(-1e30 if x is None else x for x in r) for r in rows]


def test_trie_against_brute_force(spark, monkeypatch):
    data = talks()
    df = spark.createDataFrame(data, TALKS).repartition(5)
    want = reference(data)
    assert key(trie(df)) == key(want)
    # Short stretches, and a list that is spliced in many rounds.
    monkeypatch.setattr(PT, "STRETCH", 7)
    ranks = PT.list_rank
    monkeypatch.setattr(PT, "list_rank", lambda links: ranks(links, base=8))
    assert key(trie(df)) == key(want)


def test_trie_without_conversations(spark):
    assert trie(spark.createDataFrame([], TALKS)) == []
    assert trie(spark.createDataFrame([(None, 0, "user", "x", *"abcdefgh")], TALKS)) == []
    alone = trie(spark.createDataFrame([(1, 0, None, None, *"abcdefgh")], TALKS))  # h(1) turns give way to an absent donor's
    assert key(alone) == key(reference([(1, 0, None, None)]))


def test_list_rank(spark):
    rng = random.Random(6)
    order = rng.sample(range(10_000), 700)
    weight = {x: rng.randint(0, 4) for x in order}
    links = spark.createDataFrame([(x, y, weight[x]) for x, y in zip(order, [*order[1:], None])], "id long, nxt long, w long")
    want, at = {}, 0
    for x in order:
        want[x] = at
        at += weight[x]
    for base in (1000, 20):
        assert {r["id"]: r["pos"] for r in PT.list_rank(links, base=base).collect()} == want
    assert PT.list_rank(links.limit(0)).collect() == []


def test_ends_stream_in_order(spark, monkeypatch):
    monkeypatch.setattr(PT, "STRETCH", 3)
    ends = spark.range(-40, 60).select(F.col("id").alias("conv_id"), (F.col("id") % 2).alias("depth"), F.lit(7).cast("long").alias("x1"), F.lit(8).cast("long").alias("x2"))
    got = {r["depth"]: r["ends_sha256"] for r in PT.ends_digests(ends.repartition(6)).collect()}
    want = {}
    for c in range(-40, 60):
        want.setdefault(c % 2 if c >= 0 else -(-c % 2), []).append(str(c))
    assert got == {d: hashlib.sha256(",".join(ids).encode()).hexdigest() for d, ids in want.items()}
