import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from cases import empty, frame, rows
from test_llm_pairs import brute_components, near_copies
from test_llm_texts import key, removed, words


# --- mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    """Shares by weight, and again whatever is above twice a source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mix(spark):
    from reposcope.llm.mixing import mix

    rng = random.Random(8)
    data = rows() + [(6000 + i, "w " * rng.randint(1, 60), None, s, None, "", "", "") for i in range(400) for s in [rng.choice(["a", "b", "é", "Z", None, "a"])]]
    got = mix(frame(spark, data)).collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    targets = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-12) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in data)
    longest = defaultdict(int)
    for r in got:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= 2 * longest[s] for s in sizes)
    again = mix(frame(spark, data, 2)).collect()
    assert sorted(map(tuple, got), key=key_text) == sorted(map(tuple, again), key=key_text)
    assert mix(empty(spark)).count() == 0
    nothing = mix(frame(spark, [(1, None, None, "a", None, "", "", ""), (2, " ", None, None, None, "", "", "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2


def key_text(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1}, {"a": 5}, {"a": 1, "b": 1, "c": 1, "d": 100, None: 3}, {"a": 0, "b": 7}])
def test_targets(spark, sizes):
    from reposcope.llm.mixing import source_targets

    got = source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()
    expected = brute_targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == expected


# --- packing


def test_pack_lengths():
    from reposcope.llm.packing import pack_lengths

    rng = random.Random(0)
    lengths = sorted([min(64, int(rng.paretovariate(0.9))) for _ in range(3000)], reverse=True)
    where, offset, size = pack_lengths(lengths, (16, 32, 64))
    at = defaultdict(int)
    for n, b, o in zip(lengths, where, offset):
        assert o == at[b]
        at[b] += n
    assert all(at[b] <= size[b] for b in at) and set(size) <= {16, 32, 64}
    assert all(size[b] == min(c for c in (16, 32, 64) if c >= at[b]) for b in at)  # downsized
    assert sum(lengths) / sum(size) > 0.98
    assert pack_lengths([], (16, 32)) == ([], [], [])


def test_pack_lengths_against_brute_force():
    """Every piece goes to the tightest open bin, else opens the length that costs least for each place filled."""
    from reposcope.llm.packing import cost, pack_lengths

    for seed, capacities in enumerate([(16, 32, 64), (64,), (10, 64, 65, 130), (512, 1024, 2048, 4096, 8192)]):
        rng = random.Random(seed)
        lengths = sorted([min(capacities[-1], max(1, int(rng.lognormvariate(0.4, 1.1) * capacities[-1] / 8))) for _ in range(400)], reverse=True)
        where, offset, size = pack_lengths(lengths, capacities)
        opened, used = [], []
        for i, (n, b, o) in enumerate(zip(lengths, where, offset)):
            room = [c - u for c, u in zip(opened, used)]
            fits = [r for r in room if r >= n]
            if fits:
                assert b < len(opened) and room[b] == min(fits)
            else:
                rest = sum(lengths[i:])
                assert b == len(opened)
                opened.append(min((c for c in capacities if c >= n), key=lambda c: (cost(c) / min(c, rest), c)))
                used.append(0)
            assert o == used[b]
            used[b] += n
        assert size == [min(c for c in capacities if c >= u) for u in used]


def test_pack(spark):
    from reposcope.llm.packing import pack, sequences

    data = rows()
    packed = pack(frame(spark, data), capacities=(64, 256, 1024), shard_rows=20)
    got = packed.collect()
    total = Counter()
    for r in data:
        n = len(words(r[1]))
        if n:
            total[r[0]] += n + 1
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == total
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append((r["bin_offset"], r["length"], r["bin_capacity"]))
    for own in bins.values():
        end = 0
        for o, n, c in sorted(own):
            assert o == end
            end += n
        assert end <= c and len({x[2] for x in own}) == 1
    assert sequences(packed).count() == len(bins)
    assert pack(empty(spark)).count() == 0


# --- classifiers


def junk(rng, kind):
    w = [rng.choice(["the", "river", "stone", "of", "house", "and", "wind"]) + rng.choice(["", "s", "er", "ly"]) for _ in range(rng.randint(20, 90))]
    if kind == 0:
        return " ".join(w) + "."
    if kind == 1:
        return " ".join(x.upper() + "!!" for x in w)
    if kind == 2:
        return " ".join(x + "$$$" for x in w)
    return " | ".join(w)


def test_quality(spark):
    from reposcope.llm.quality import learn_ranking, quality_scores

    rng = random.Random(6)
    kinds = [0 if rng.random() < 0.8 else rng.choice([1, 2, 3]) for _ in range(600)]
    docs = spark.createDataFrame([(i, junk(rng, k), "junk") for i, k in enumerate(kinds)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(k == 0), 0) for i, k in enumerate(kinds) if i % 2] + [(None, 1, 0), (5, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    model = learn_ranking(docs, labels)
    got = {r["doc_id"]: r for r in quality_scores(docs, model).collect()}
    unseen = [i for i in range(600) if not i % 2 or zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (kinds[i] == 0) for i in unseen) >= 0.99 * len(unseen)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    odd = quality_scores(frame(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 for r in odd)
    one_label = learn_ranking(docs, labels.filter("quality = 1"))
    assert {r["predicted"] for r in quality_scores(docs, one_label).collect()} == {1}
    assert quality_scores(empty(spark), learn_ranking(empty(spark), labels)).count() == 0


def test_toxicity(spark):
    from reposcope.llm.toxicity import learn_noisy_or, offending_sentences, toxicity_scores

    rng = random.Random(2)

    def text(bad):
        s = [" ".join(rng.choice(["the", "river", "stone", "of", "house", "wind"]) + rng.choice(["", "s", "er", str(rng.randint(0, 50))]) for _ in range(8)) + "." for _ in range(rng.randint(2, 12))]
        if bad:
            k = rng.randrange(len(s))
            s[k] = s[k].replace(" ", f" {rng.choice(['grunk', 'Blorf', 'zarbheit', 'zarbung'])} ", 1)
        return " ".join(s)

    bad = [rng.random() < 0.2 for _ in range(800)]
    docs = spark.createDataFrame([(i, text(b), "x") for i, b in enumerate(bad)], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad) if i % 2] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = learn_noisy_or(docs, labels)
    got = {r["doc_id"]: r for r in toxicity_scores(docs, model).collect()}
    unseen = [i for i in range(800) if not i % 2 or zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == bad[i] for i in unseen) >= 0.98 * len(unseen)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    found = offending_sentences(docs, model).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]][r["begin"]:r["end"]] == r["text"] for r in found)
    named = [r for r in found if any(w in r["text"].lower() for w in ("grunk", "blorf", "zarb"))]
    assert len(named) >= 0.95 * len(found) and len({r["doc_id"] for r in named}) >= 0.95 * sum(bad)
    odd = {r["doc_id"]: r["score"] for r in toxicity_scores(frame(spark), model).collect()}
    assert odd[1001] == odd[1002] == 0.0
    assert {r["predicted"] for r in toxicity_scores(docs, learn_noisy_or(docs, labels.filter("toxic = 0"))).collect()} == {0}
    assert toxicity_scores(empty(spark), learn_noisy_or(empty(spark), labels)).count() == 0


# --- pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(4)
    data = rows() + [(7000 + i, t, "en", f"src{i % 4}", len(t), "", "", "") for i, t in enumerate(near_copies())]
    data += [(8000 + i, junk(rng, i % 4), "en", "src1", 1, "", "", "") for i in range(200)]
    labels = spark.createDataFrame([(8000 + i, int(i % 4 == 0), 0) for i in range(200)] + [(7000 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    docs = frame(spark, data)
    docs.write.parquet(f"{sf}/documents.parquet")
    key_of = lambda rs: sorted(map(tuple, rs), key=key_text)

    kept = P.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert all((8000 + i in ids) == (i % 4 == 0) for i in range(200)) and all(7000 + i in ids for i in range(66))

    near = P.near_duplicates_stage(spark, kept, sf)
    rows_in = [tuple(r) for r in kept.collect()]
    expected = {c for _, _, c, _ in brute_components([(r[0], r[1]) for r in rows_in], 5, 80, 100) if c is not None}
    got = near.collect()
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(expected)
    assert sum(r["doc_id"] is None for r in got) == sum(r[0] is None for r in rows_in)

    cut = P.repeats_stage(spark, kept, sf)
    by_text = Counter((i, t) for i, t, *_ in rows_in)
    sizes = Counter()
    for (i, n, gone, _, _), (_, t) in zip(removed([(r[0], r[1]) for r in rows_in]), [(r[0], r[1]) for r in rows_in]):
        sizes[(i, n - gone)] += 1
    out = cut.collect()
    assert cut.columns == docs.columns and len(out) == sum(by_text.values())
    close = Counter((r["doc_id"], len((r["text"] or "").encode())) for r in out)
    assert sum((close & sizes).values()) >= 0.9 * len(out)  # characters that a cut splits go as well

    mixed = P.mixing_stage(spark, near, sf)
    assert mixed.columns == docs.columns
    have = Counter(r["doc_id"] for r in mixed.collect())
    assert set(have) <= {r["doc_id"] for r in got} and max(have.values()) <= 2 * 2  # null ids share their count
    packed = P.packing_stage(spark, mixed, sf).collect()
    assert sum(r["length"] for r in packed) == sum(len(words(r["text"])) + 1 for r in mixed.collect() if words(r["text"]))

    assert P.run(spark, sf).count() > 0 and [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    nothing = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, nothing, sf).count() == 0
    assert key_of(docs.limit(0).collect()) == []


def test_stages_decide_per_row(spark):
    """Rows that repeat an id, or have none, are kept, dropped and taken each by itself."""
    import corpus_pipeline as P
    from reposcope.llm.mixing import mix

    text = lambda name, n=20: " ".join(f"{name}{i}" for i in range(n))
    row = lambda i, t, source="s": (i, t, "en", source, len(t), "", "", "")
    docs = frame(spark, [row(1, text("common")), row(5, text("common")), row(5, text("only")), row(5, text("other")), row(5, text("other")), row(9, text("only"))])
    assert sorted((r["doc_id"], r["text"][:4]) for r in P.near_duplicates_stage(spark, docs, "").collect()) == [(1, "comm"), (5, "only"), (5, "othe")]

    docs = frame(spark, [row(None, text(f"n{i}")) for i in range(40)] + [row(3, text(f"i{i}")) for i in range(40)]
                 + [row(100 + i, text(f"t{i}"), "t") for i in range(20)] + [row(200 + i, text(f"u{i}"), "u") for i in range(400)])
    want = Counter((r["doc_id"], r["source"]) for r in mix(docs).collect() for _ in range(r["copies"]))
    mixed = P.mixing_stage(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["source"]) for r in mixed) == want
    assert 400 < sum(n for (_, source), n in want.items() if source == "u") < 800  # rows have different counts
    docs = frame(spark, [row(None, text(f"u{i}"), "u") for i in range(400)] + [row(100 + i, text(f"t{i}"), "s") for i in range(60)])
    took = Counter(r["text"] for r in P.mixing_stage(spark, docs, "").collect() if r["doc_id"] is None)
    assert sum(took.values()) == sum(r["copies"] for r in mix(docs).collect() if r["doc_id"] is None) > 0 and max(took.values()) <= 2


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use themselves are the caller's here, with values of their own."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    names = ["_doc", "_key", "_row", "_nth", "_id", "_kept", "_hash", "_spans", "_h", "_null", "_copies", "_copy", "_source", "_words", "_place", "_size",
             "_stays", "_least", "_text", "size", "copies", "component_id", "text_hash", "kept", "piece", "length", "label", "quality", "a.b"]
    passage = "the very same words stand here in two of the documents, and they are over fifty bytes long"
    texts = {1: "alpha beta gamma delta", 2: f"river {passage} stone", 3: f"cloud {passage} wind", 4: None, 5: " ".join(f"w{i}" for i in range(30))}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts.items()] + [(None, "no id here", "en", None, 10)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    tag = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    docs = docs.select("*", *[F.concat(F.lit(n + " of "), tag).alias(n) for n in names])
    for stage in (P.near_duplicates_stage, P.repeats_stage, P.mixing_stage):
        out = stage(spark, docs, "")
        assert out.schema.names == docs.columns
        got = out.collect()
        assert got
        for r in got:
            own = "none" if r["doc_id"] is None else r["doc_id"]
            assert all(r[n] == f"{n} of {own}" for n in names) and r["lang"] == "en"
    cut = {r["doc_id"]: r for r in P.repeats_stage(spark, docs, "").collect()}
    assert cut[2]["text"] == texts[2] and cut[4]["text"] is None and cut[3]["text"] == "cloudwind" and cut[3]["n_chars"] == 9
    assert len(P.near_duplicates_stage(spark, docs, "").collect()) == 6
    packed = P.packing_stage(spark, docs, "").collect()
    assert {r["doc_id"]: r["text"] for r in packed} == {i: t for i, t in texts.items() if t} | {None: "no id here"}


def test_packed_pieces_hold_the_texts(spark):
    import corpus_pipeline as P

    top = 8192
    texts = {n: "  " + " \n".join(f"w{i}" for i in range(n)) + "\t" for n in (1, top - 2, top - 1, top, top + 1, 2 * top, 20000)}
    docs = spark.createDataFrame([(n, t) for n, t in texts.items()] * 2 + [(7, None), (8, "  ")], "doc_id long, text string")
    got = P.packing_stage(spark, docs, "").collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["text"], r["length"]))
    assert set(pieces) == set(texts)
    for n, t in texts.items():
        own = sorted(pieces[n])
        assert len(own) == 2 * -(-(n + 1) // top) and own[0::2] == own[1::2]  # both copies alike
        assert "".join(x for _, x, _ in own[0::2]) == t and sum(k for _, _, k in own[0::2]) == n + 1
        assert all(len(words(x)) == k - (i == len(own[0::2]) - 1) for i, (_, x, k) in enumerate(own[0::2]))
