import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cases import empty, frame, rows

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


# --- token counts


def test_token_counts_match_the_library(spark):
    import public_tokenizers
    import sentencepiece

    from reposcope.llm.token_counts import token_counts

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    data = rows() + [(2000 + i, t, None, None, None, "", "", "") for i, t in enumerate(
        ["<s> </s> <unk>", "▁▁a ▁b", " lead", "trail ", "a  b   c", "\n", " \n", "\n\n x", "tab\there", "x" * 200 + " y", "é é ﬁ"])]
    got = token_counts(frame(spark, data), limit=100).collect()
    assert len(got) == len(data)
    expected = [(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 100) for r in data]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert token_counts(empty(spark)).count() == 0


def test_token_shortcut_is_proved_and_used():
    from reposcope.llm.token_counts import counter

    c = counter("piece_bpe_32k.model")
    assert c.proved and len(c.alone) > 25_000 and c.alone["the"] == 1
    c.proved = False
    try:
        assert c.count("the river") == 2
    finally:
        c.proved = True


# --- fingerprints


def test_fingerprints(spark):
    from reposcope.llm.fingerprint import fingerprints

    data = rows()
    got = fingerprints(frame(spark, data)).collect()
    assert len(got) == len(data)
    with_id = [(r[0], r[1] or "") for r in data if r[0] is not None]
    order = sorted(with_id, key=lambda x: -x[0])
    # Rows of one id (equal texts here) follow each other.
    expected = Counter()
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        expected[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    for i, t in [(r[0], r[1] or "") for r in data if r[0] is None]:
        half = len(t) // 2
        expected[(i, len(t), hashlib.sha256((t[:len(t) - half] + t[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    by_text = defaultdict(set)
    texts = {r[0]: r[1] or "" for r in data}
    for r in got:
        by_text[texts[r["doc_id"]] if r["doc_id"] is not None else None].add(r["fingerprint"])
    assert all(len(v) == 1 for k, v in by_text.items() if k is not None)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1001, 1002, 1003)} == {""}
    assert fingerprints(empty(spark)).count() == 0


def test_next_texts_over_many_stretches(spark):
    from reposcope.llm.fingerprint import next_texts

    ids = [i * i * (-1) ** i for i in range(300)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    order = sorted(ids, reverse=True)
    expected = {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    for rows_ in (3, 40, 1000):
        assert {r["doc_id"]: r["next_text"] for r in next_texts(docs, rows=rows_).collect()} == expected
    one = spark.createDataFrame([(7, "only")], "doc_id long, text string")
    assert next_texts(one).first()["next_text"] == "only"


def test_sketch_estimates_and_merge(spark):
    from pyspark.sql import functions as F

    from reposcope.llm.fingerprint import containment, distinct_shingles, merge, merge_parts, resemblance, sketch

    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"w{i}" for i in range(600, 3600))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(sketch(F.col("a"), 512).alias("a"), sketch(F.col("b"), 512).alias("b"))
    r = df.select(resemblance(F.col("a"), F.col("b"), 512).alias("r"), containment(F.col("a"), F.col("b"), 512).alias("c"),
                  distinct_shingles(F.col("a"), 512).alias("n"), distinct_shingles(merge(F.col("a"), F.col("b"), 512), 512).alias("u")).first()
    assert abs(r["r"] - 2396 / 3596) < 0.08 and abs(r["c"] - 0.8) < 0.12
    assert abs(r["n"] / 2996 - 1) < 0.15 and abs(r["u"] / 3596 - 1) < 0.15
    parts = spark.createDataFrame([(1, "a b c d e f g"), (1, "d e f g h i"), (2, "")], "k long, t string").select("k", sketch(F.col("t"), 4).alias("s"))
    got = {r["k"]: r["s"] for r in merge_parts(parts, "k", "s", 4).collect()}
    whole = spark.createDataFrame([("a b c d e f g h i",)], "t string").select(sketch(F.col("t"), 4).alias("s")).first()["s"]
    assert got[1] == whole and got[2] == []


# --- removal of repeated strings


def removed(data, length=50):
    docs = [(i, (t or "").encode()) for i, t in data]
    first = {}
    for i, t in docs:
        if i is not None:
            for p in range(len(t) - length + 1):
                s = t[p:p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - length + 1):
                if first[t[p:p + length]] < i:
                    gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,block_rows,part_rows", [(50, 2048, 8192), (50, 7, 5), (20, 10, 6)])
def test_repeats_against_brute_force(spark, length, block_rows, part_rows):
    from reposcope.llm.suffix_dedup import digest, remove_repeats

    data = rows() + [(3000, "ab" * 200, *[None] * 3, "", "", ""), (3001, "ba" * 90, *[None] * 3, "", "", ""), (2999, "x" + "ab" * 40, *[None] * 3, "", "", "")]
    got = digest(remove_repeats(frame(spark, data), length, block_rows, part_rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(removed([(r[0], r[1]) for r in data], length), key=key)


def test_repeats_rows_of_one_id_and_empty(spark):
    from reposcope.llm.suffix_dedup import digest, remove_repeats

    data = [(1, "q" * 60, *[None] * 3, "", "", ""), (1, "q" * 70, *[None] * 3, "", "", ""), (2, "q" * 55 + "é", *[None] * 3, "", "", "")]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in digest(remove_repeats(frame(spark, data))).collect())
    assert got == [(1, 60, 0, 0), (1, 70, 0, 0), (2, 57, 55, 1)]
    assert remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("length", [8, 127, 170, 255, 256, 300, 700])
def test_repeats_of_any_length(spark, length):
    import random

    from reposcope.llm.suffix_dedup import digest, remove_repeats

    rng = random.Random(length)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(900))
    own = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    texts = [own(90) + passage, passage[:640] + own(40), own(300) + passage[100:] + own(300), passage[30:750], own(10) + passage + passage, own(2000), passage[:length]]
    data = [(i * 7, t, *[None] * 3, "", "", "") for i, t in enumerate(texts)]
    got = digest(remove_repeats(frame(spark, data), length, 3, 2)).collect()
    want = removed([(r[0], r[1]) for r in data], length)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and sum(w[2] for w in want) >= length


@pytest.mark.parametrize("length", [-1, 0, 6, 7, 16385])
def test_repeats_of_unsupported_length(spark, length):
    from reposcope.llm.suffix_dedup import remove_repeats

    with pytest.raises(ValueError):
        remove_repeats(frame(spark), length)


def test_merge_runs_is_a_merge_with_shared_prefixes():
    import random

    import numpy as np

    from reposcope.llm.suffix_dedup import _front_code, _front_decode, _sortable, merge_runs

    rng = random.Random(1)
    for k in (1, 2, 3, 8, 13):
        runs, plain = [], []
        for _ in range(k):
            m = np.array([[rng.choice([0, 0, 1, 255]) for _ in range(6)] for _ in range(rng.randint(0, 40))], dtype=np.uint8).reshape(-1, 6)
            m = np.unique(m, axis=0) if len(m) else m
            if len(m):
                assert (np.argsort(_sortable(m), kind="stable") == np.arange(len(m))).all()
                common, rest = _front_code(m)
                assert (_front_decode(common, np.frombuffer(rest, np.uint8), 6) == m).all()
            else:
                common = np.zeros(0, np.uint8)
            runs.append((m.tobytes(), common))
            plain += [bytes(r) for r in m]
        order, shared = merge_runs(runs, 6)
        at = [0] * k
        merged = []
        for r in order:
            merged.append(runs[r][0][at[r] * 6:at[r] * 6 + 6])
            at[r] += 1
        assert merged == sorted(plain)
        for a, b, s in zip(merged, merged[1:], shared[1:]):
            assert s == next((i for i in range(6) if a[i] != b[i]), 6)


# --- language model


def test_language_scores(spark):
    from reposcope.llm.pitman_yor import language_scores

    data = rows()
    got = language_scores(frame(spark, data), block_rows=9, part_rows=10).collect()
    tokens = {r[0]: words(r[1]) + [b"\0end"] for r in data if r[0] is not None}
    counts = Counter()
    for i, t, *_ in data:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            counts.update(words(t) + [b"\0end"])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(data)
    for r in got:
        assert r["train_tokens"] == n and r["score"] < 0
        if r["doc_id"] is not None:
            own = tokens[r["doc_id"]]
            assert r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
            assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
    again = language_scores(frame(spark, data, 2)).collect()
    scores = lambda rs: sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in rs)
    assert scores(got) == scores(again)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert language_scores(empty(spark)).count() == 0


def test_model_is_a_distribution(spark):
    """After one context, the probabilities of all known words and the unknown one add up to 1."""
    from reposcope.llm.pitman_yor import language_scores

    train = [(i, t, None, None, None, "", "", "") for i, t in enumerate(["a b a c", "a a b", "b c a b a d", "a c c", "d a b", "a b b a"]) if zlib.crc32(str(i).encode()) % 10]
    held = iter(i for i in range(100, 10_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    start = next(held)
    probes = {w: next(held) for w in ["a", "b", "c", "d", "zzz"]}
    data = train + [(start, "a", *[None] * 3, "", "", "")] + [(i, f"a {w}", *[None] * 3, "", "", "") for w, i in probes.items()]
    r = {x["doc_id"]: x["score"] for x in language_scores(frame(spark, data)).collect()}
    # P(start, a, w, end) and P(start, a, end): compare texts that differ in the second word, each without its end.
    ends = {w: next(held) for w in probes}
    data += [(i, f"{w}", *[None] * 3, "", "", "") for w, i in ends.items()]
    r = {x["doc_id"]: x["score"] for x in language_scores(frame(spark, data)).collect()}
    one = {w: 10 ** r[i] for w, i in ends.items()}
    assert 0 < sum(one.values()) < 1  # one-word texts
    assert all(v < 0 for v in r.values())


def test_seating_keeps_bounds():
    import numpy as np

    from reposcope.llm.pitman_yor import SAMPLES, sample_tables

    c = np.array([0, 1, 2, 5, 100, 10_000])
    n = sample_tables(c, np.full(6, 50.0), np.full(6, 0.01), 0.7, 1.0, np.arange(6, dtype=np.uint64)) / SAMPLES
    assert n[0] == 0 and n[1] == 1 and (n[1:] >= 1).all() and (n <= c).all()
    more = sample_tables(c, np.full(6, 50_000.0), np.full(6, 0.5), 0.7, 1.0, np.arange(6, dtype=np.uint64)) / SAMPLES
    assert (more[3:] > n[3:]).all()


def test_all_texts_add_up_to_one(spark):
    """The chances of all texts of any length, found from those of texts of none, one and two words, words of all parts frequent."""
    import numpy as np

    from reposcope.llm.pitman_yor import language_scores

    train = [(i, t, *[None] * 3, "", "", "") for i, t in enumerate(["a b a c", "a a b " * 30, "b c a b a d", "a c c " * 9, "d a b", "a b b a"] * 3) if zlib.crc32(str(i).encode()) % 10]
    held = iter(i for i in range(100, 100_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    known = ["a", "b", "c", "d", "zzz"]  # the last is the unknown word
    probes = {t: next(held) for t in ["", *known, *[f"{u} {w}" for u in known for w in known]]}
    data = train + [(i, t, *[None] * 3, "", "", "") for t, i in probes.items()]
    r = {x["doc_id"]: 10 ** x["score"] for x in language_scores(frame(spark, data)).collect()}
    p = {t: r[i] for t, i in probes.items()}
    step = np.array([[p[f"{u} {w}"] / p[u] for w in known] for u in known])
    assert math.isclose(p[""] + np.array([p[w] for w in known]) @ np.linalg.solve(np.eye(len(known)) - step, np.ones(len(known))), 1, rel_tol=1e-9)


def test_tables_are_drawn_from_their_distribution():
    """Against the chances of all numbers of tables by recursion, for dishes below and above EXACT customers."""
    import numpy as np

    from reposcope.llm.pitman_yor import EXACT, SAMPLES, sample_tables

    d, n, others, base = 0.8, 3000, 1e6, 2e-5
    weights = np.zeros(1)  # log S(1, 1)
    for c in range(1, 2 * EXACT):
        t = np.arange(1, c + 1)
        grown = np.full(c + 1, -np.inf)
        grown[:-1] = weights + np.log(c - d * t)
        grown[1:] = np.logaddexp(grown[1:], weights)
        weights = grown
        if c + 1 in (6, 300, 2 * EXACT):
            t = np.arange(1, c + 2)
            chance = np.exp((w := weights + t * np.log((1 + d * others) * base)) - w.max())
            chance /= chance.sum()
            mean = (chance * t).sum()
            got = sample_tables(np.full(n, c + 1), np.full(n, others), np.full(n, base), d, 1.0, np.arange(n, dtype=np.uint64) * np.uint64(977)) / SAMPLES
            assert abs(got.mean() - mean) < 6 * math.sqrt((chance * (t - mean) ** 2).sum() / (n * SAMPLES)) + 1e-3 * mean
