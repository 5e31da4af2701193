import random
import re

import numpy as np

from cases import empty, frame, prose, rows
from test_llm_texts import key, words


def brute_components(data, size, num, den):
    sets = []
    for i, t in data:
        w = words(t)
        s = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.append((i, s))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(sets)
    for a, (i, s) in enumerate(sets):
        for b in range(a + 1, len(sets)):
            j, t = sets[b]
            if i is None or j is None or not s or not t:
                continue
            k = len(s & t)
            if den * k >= num * (len(s) + len(t) - k):
                links[a] += 1
                links[b] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i), n) for (i, s), n in zip(sets, links)]


def near_copies(n=70):
    rng = random.Random(3)
    out = []
    for family in range(6):
        base = prose(rng, 30 + 45 * family).split(" ")
        for _ in range(n // 6):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"new{rng.random():.3f}"
            if rng.random() < 0.3:
                w = w[:-rng.randint(1, 3)]
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def test_jaccard_join_against_brute_force(spark):
    from reposcope.llm.jaccard_join import jaccard_join

    data = rows() + [(5000 + i, t, None, None, None, "", "", "") for i, t in enumerate(near_copies())]
    for size, threshold, block in ((3, (90, 100), 512), (5, (80, 100), 4), (2, (70, 100), 16)):
        got = jaccard_join(frame(spark, data), size, threshold, block).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute_components([(r[0], r[1]) for r in data], size, *threshold), key=key)
    assert jaccard_join(empty(spark)).count() == 0


def test_jaccard_join_of_ids_with_several_texts(spark):
    """An id that stands for two texts joins the groups of both."""
    from reposcope.llm.jaccard_join import jaccard_join

    rng = random.Random(12)
    a, b = prose(rng, 60).split(" "), prose(rng, 60).split(" ")
    edit = lambda w, k: " ".join(w[:k] + [f"e{k}"] + w[k + 1:])
    data = [(3, edit(a, 5)), (5, edit(a, 50)), (5, edit(b, 7)), (9, edit(b, 40)), (11, edit(b, 58)), (20, prose(rng, 40))]
    rows_ = [(i, t, None, None, None, "", "", "") for i, t in data]
    for block in (512, 2):
        got = jaccard_join(frame(spark, rows_), 2, (80, 100), block).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute_components(data, 2, 80, 100), key=key)
        assert {r["component_id"] for r in got} == {3, 20}


def test_prefixes_lose_no_pair():
    from reposcope.llm.jaccard_join import needed, prefix_keys

    rng = np.random.default_rng(0)
    for num in (80, 90):
        for _ in range(600):
            a = int(rng.integers(4, 400))
            b = int(rng.integers(a, a * 100 // num + 1))
            need = int(needed(a, b, (num, 100)))
            if need > a or a == b == need:
                continue
            x = rng.permutation(rng.integers(0, 2 ** 63, size=a + b - need, dtype=np.uint64))
            one, two = np.sort(x[:a]), np.sort(np.concatenate([x[:need], x[a:]]))
            # What both hold has two holders at least; other shingles have any number.
            rank = dict(zip(x.tolist(), rng.integers(0, 40, size=len(x)).tolist()))
            rank.update({h: max(8, rank[h]) for h in x[:need].tolist()})
            keys = [prefix_keys(s, np.array([rank[h] for h in s.tolist()], dtype=np.uint8), (num, 100)) for s in (one, two)]
            assert len(np.intersect1d(*keys)), (a, b, need)


def test_components_of_long_paths(spark):
    from reposcope.llm.components import connected_components

    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 400), (400, 450), (7, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    random.Random(2).shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 161))
    assert got[500] == got[450] == got[400] == 400 and got[1049] == 1000 and 7 not in got


def test_exact_topk_against_brute_force(spark):
    from reposcope.llm.exact_topk import exact_topk

    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 8))
    vectors = [centers[i % 5] + 0.2 * rng.normal(size=8) for i in range(700)]
    data = [(i - 100, [float(np.float32(x)) for x in v], "extra") for i, v in enumerate(vectors)]
    data += [(10_000 + 100 * i, list(data[7][1]), "") for i in range(30)]  # one vector, many times
    data += [(20_000, None, ""), (20_100, [1.0] * 7 + [None], ""), (20_200, [float("nan")] + [0.0] * 7, ""), (20_300, [float("inf")] * 8, ""),
             (None, [1.0] * 8, ""), (20_400, [0.5] * 3, ""), (20_500, [], "")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string").repartition(3)

    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in data
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, v in fine:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in fine if c != q)[:10]
            expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    for sample, pivots in ((2048, 32), (5, 3)):
        got = exact_topk(df, sample=sample, pivots=pivots).collect()
        assert sorted(map(tuple, got)) == sorted(expected)
    assert exact_topk(df.filter("vec_id = 0")).count() == 0
    assert exact_topk(df.filter("vec_id IN (0, 1, 2)")).count() == 2
    assert exact_topk(spark.createDataFrame([], df.schema)).count() == 0


def test_exact_topk_counts_an_id_once(spark):
    """One id on twelve vectors that are all nearer than the others fills one place of ten."""
    from reposcope.llm.exact_topk import exact_topk

    data = [(0, [1.0, 0.0])] + [(7, [20.0 + i, 1.0]) for i in range(12)] + [(10 + i, [5.0 + i / 4, 2.0]) for i in range(15)]
    expected = [(0, 1, 7, 31 * 1024 * 1024)] + [(0, r + 2, 24 - r, int(1024 * (8.5 - r / 4)) * 1024) for r in range(9)]
    for sample, pivots in ((2048, 1), (2, 1)):
        got = exact_topk(spark.createDataFrame(data, "vec_id long, embedding array<double>"), sample=sample, pivots=pivots).collect()
        assert sorted(map(tuple, got)) == expected


def test_cover_tree_covers_and_prunes():
    from reposcope.llm.exact_topk import CoverTree, exact_scores

    rng = np.random.default_rng(1)
    points = rng.normal(size=(900, 5))
    tree = CoverTree(points)
    assert sorted(tree.order) == list(range(900))
    for node, (lo, hi) in tree.span.items():
        gaps = np.sqrt(((points[tree.order[lo:hi]] - tree.centers[node]) ** 2).sum(axis=1))
        assert gaps.max() <= tree.radii[node] * (1 + 1e-6) + 1e-12
        kids = tree.children[node]
        assert not kids or sum(tree.span[c][1] - tree.span[c][0] for c in kids) == hi - lo
    big = np.array([[2 ** 40, -3], [5, 2 ** 45]], dtype=np.int64)
    assert (exact_scores(big, big) == np.array([[min(2 ** 63 - 1, 2 ** 80 + 9), 5 * 2 ** 40 - 3 * 2 ** 45],
                                                [5 * 2 ** 40 - 3 * 2 ** 45, min(2 ** 63 - 1, 25 + 2 ** 90)]], dtype=object).astype(np.int64)).all()


def test_score_bounds_hold_and_prune():
    """No pair is above its bound; on clustered vectors most pairs are never scored, and the answers stay exact."""
    from reposcope.llm.exact_topk import CoverTree, dual_tree, exact_scores, score_bound

    rng = np.random.default_rng(7)
    centers = rng.normal(size=(60, 16))
    points = centers[rng.integers(0, 60, size=4000)] + 0.05 * rng.normal(size=(4000, 16))
    points = np.unique(np.floor(1024 * points / np.sqrt((points ** 2).sum(axis=1))[:, None]).astype(np.int64), axis=0)
    ids = np.arange(len(points))
    asked = ids[::20]
    scores = exact_scores(points[asked], points)
    scores[np.arange(len(asked)), asked] = -2 ** 62
    top = np.stack([np.lexsort((ids, -row))[:10] for row in scores])
    kth = scores[np.arange(len(asked)), top[:, -1]].astype(float)
    best = dual_tree(asked, points[asked], [np.array([i]) for i in ids], points, 10, np.full(len(asked), -np.inf))
    assert [[i for _, i in f] for f in best.found] == top.tolist()
    assert best.scored < 0.3 * len(asked) * len(points)
    known = dual_tree(asked, points[asked], [np.array([i]) for i in ids], points, 10, kth)
    assert [[i for _, i in f] for f in known.found] == top.tolist() and known.scored <= best.scored

    for scale in (1.0, 1e6, 1e9):
        rows_ = np.floor(points[:300] * scale)
        tree = CoverTree(rows_)
        for node in range(0, len(tree.radii), 3):
            own = tree.order[slice(*tree.span[node])]
            for other in range(0, len(tree.radii), 5):
                theirs = tree.order[slice(*tree.span[other])]
                bound = score_bound(tree.centers[node] @ tree.centers[other], tree.norms[node], tree.radii[node], tree.longest[node],
                                    tree.norms[other], tree.radii[other], tree.longest[other], 16)
                exact = max(sum(int(a) * int(b) for a, b in zip(rows_[i], rows_[j])) for i in own[:3] for j in theirs[:3])
                assert exact <= bound


def test_words_of_batches():
    from reposcope.llm.words import shingles, words as hashes

    rng = random.Random(9)
    texts = [t or "" for _, t, *_ in rows()] + ["A b", "a B", "a\x0bb", "w" * 9000 + " " + prose(rng, 50)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, at = hashes(raw, offsets)
    seen = {}
    for i, t in enumerate(texts):
        own = words(t)
        assert at[i + 1] - at[i] == len(own)
        for w, x in zip(own, h[at[i]:at[i + 1]]):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for t, s in zip(texts, shingles(h, at, 3)):
        w = words(t)
        assert len(s) == (len({tuple(w[k:k + 3]) for k in range(len(w) - 2)}) if len(w) >= 3 else int(bool(w)))
    import reposcope.llm.words as module
    keep, module._PIECE = module._PIECE, 100
    try:
        h2, at2 = hashes(raw, offsets)
    finally:
        module._PIECE = keep
    assert (h2 == h).all() and (at2 == at).all()
    assert re.search("漢", texts[0] + "".join(texts))
