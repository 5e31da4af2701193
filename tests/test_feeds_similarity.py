import numpy as np
from pyspark.sql import functions as F

from conftest import SF001, ts
from reposcope.functions.ordinal import global_rank
from reposcope.operators import feed as FD
from reposcope.operators import similarity as SI
from reposcope.operators.facets import top_unseen
from reposcope.sources import fixtures as FX

VIEWS = "session_id string, repository_id long, viewed_at timestamp_ntz"
SIM = "source_id long, candidate_id long, score double"


def test_personalised_weights_and_empty_history_list(spark):
    views = spark.createDataFrame([("s", 1, ts("2024-01-01")), ("s", 1, ts("2024-01-02")),
                                   ("s", 1, ts("2024-01-03")), ("s", 2, ts("2024-01-04")),
                                   ("t", 9, ts("2024-01-01"))], VIEWS)
    sim = spark.createDataFrame([(1, 10, 0.5), (2, 11, 1.2), (2, 1, 0.9)], SIM)
    out = [(r.session_id, r.repository_id, r.score) for r in
           FD.feed_personalized(views, sim).orderBy("session_id", "rank").collect()]
    # repository 1 viewed 3x → candidate 10 weighs 1.5; candidate 1 is seen → removed;
    # session t has history without lists → no rows (no trending fallback)
    assert out == [("s", 10, 1.5), ("s", 11, 1.2)]


def test_paging(spark):
    views = spark.createDataFrame([("s", 0, ts("2024-01-01"))], VIEWS)
    sim = spark.createDataFrame([(0, i, float(i)) for i in range(1, 51)], SIM)
    assert FD.feed_personalized(views, sim, page=0).count() == 50
    assert FD.feed_personalized(views, sim, page=1).count() == 0


def test_top_unseen_matches_brute_force(spark):
    ranked = spark.createDataFrame([(100 + i, i) for i in range(1, 41)], "repository_id long, rank long")
    seen_rows = [("a", 101), ("a", 103), ("a", 110), ("b", 999)]
    seen = spark.createDataFrame(seen_rows, "session_id string, repository_id long")
    sessions = spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")
    got = {(r.session_id, r.position): r.repository_id for r in top_unseen(ranked, seen, sessions, 5, 10).collect()}
    for s in "abc":
        lst = [100 + i for i in range(1, 41) if (s, 100 + i) not in set(seen_rows)][5:15]
        assert [got[(s, p)] for p in range(6, 16)] == lst


def test_global_rank_is_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") % 37).alias("k"), F.col("id"))
    r = global_rank(df, [F.desc("k"), F.asc("id")]).toPandas().sort_values("rank")
    assert list(r["rank"]) == list(range(1, 5001))
    assert (r["k"].diff().fillna(0) <= 0).all()


def test_blocked_topk_equals_brute_force(spark):
    vec = FX.vectors(spark, SF001)
    pdf = vec.toPandas()
    m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    ids = pdf["repository_id"].to_numpy()
    k = 5
    expect = {}
    for i, sid in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]
        expect[int(sid)] = [int(ids[j]) for j in order]
    for blocks in (1, 3):
        got = SI.similar_topk(vec, k, blocks=blocks).toPandas().sort_values(["source_id", "rank"])
        assert {int(a): [int(x) for x in g["candidate_id"]] for a, g in got.groupby("source_id")} == expect


def test_hybrid_skips_missing_metadata(spark):
    topk = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2), (1, 4, 0.7, 3), (5, 2, 0.5, 1)],
                                 "source_id long, candidate_id long, cosine double, rank long")
    enriched = spark.createDataFrame([(1, ["a", "b"], {"Go": 1}), (2, ["a"], {"Go": 1}), (4, [], {})],
                                     "id long, topics array<string>, languages map<string,bigint>")
    out = [(r.source_id, r.candidate_id, r.rank, round(r.score, 6)) for r in
           SI.similarity_hybrid(topk, enriched).orderBy("source_id", "rank").collect()]
    # candidate 3 has no record → skipped, order stays cosine order; source 5 → no list
    assert out == [(1, 2, 1, round(0.6 * 0.9 + 0.3 * 0.5 + 0.1 * 1.0, 6)), (1, 4, 2, round(0.6 * 0.7, 6))]


def test_similarity_json_round_trip(spark):
    lists = spark.createDataFrame([(7, 9, 0.25, 2), (7, 8, 0.5, 1)],
                                  "source_id long, candidate_id long, score double, rank long")
    js = SI.similarity_json(lists)
    assert js.first().data == '[{"Score":0.5,"Member":8},{"Score":0.25,"Member":9}]'
    odd = spark.createDataFrame([(7, 9, 0.1234567890123, 1)], lists.schema)
    assert SI.similarity_from_json(SI.similarity_json(odd)).first().score == 0.1234567890123  # in full
    back = [(r.candidate_id, r.rank) for r in SI.similarity_from_json(js).orderBy("rank").collect()]
    assert back == [(8, 1), (9, 2)]


def test_blocked_topk_with_sources_uses_asymmetric_blocks(spark):
    vec = FX.vectors(spark, SF001)
    pdf = vec.toPandas()
    m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = pdf["repository_id"].to_numpy()
    src_ids = [int(x) for x in ids if x % 7 == 0]
    sources = spark.createDataFrame([(x,) for x in src_ids], "repository_id long")
    got = SI.similar_topk(vec, 4, sources=sources, block_rows=60).toPandas()  # Bq=2, Bc=9
    assert set(got["source_id"]) == set(src_ids)
    pos = {int(x): i for i, x in enumerate(ids)}
    for sid, g in got.groupby("source_id"):
        s = m @ m[pos[int(sid)]]
        s[pos[int(sid)]] = -np.inf
        order = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:4]
        assert list(g.sort_values("rank")["candidate_id"]) == [int(ids[j]) for j in order]


def test_block_kernel_slices_match_brute_force():
    import pandas as pd
    rng = np.random.default_rng(5)
    q = rng.normal(size=(23, 6)); q /= np.linalg.norm(q, axis=1, keepdims=True)
    c = np.vstack([q[:10], rng.normal(size=(30, 6))]); c /= np.linalg.norm(c, axis=1, keepdims=True)
    qid, cid = np.arange(23), np.concatenate([np.arange(10), np.arange(100, 130)])
    qdf = pd.DataFrame({"q_id": qid, "q_unit": list(q)})
    cdf = pd.DataFrame({"c_id": cid, "c_unit": list(c)})
    got = SI._block_topk(3, rows_per_slice=7)(qdf, cdf)
    for i in range(23):
        s = c @ q[i]
        s[cid == i] = -np.inf
        want = set(cid[np.argsort(-s)[:3]])
        assert set(got[got.source_id == i].candidate_id) == want


def test_equal_vectors_give_k_rows_each(spark):
    vec = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "repository_id long, embedding array<float>")
    got = SI.similar_topk(vec, 3, blocks=2).collect()
    assert len(got) == 900 and {r.candidate_id for r in got if r.source_id == 5} == {0, 1, 2}
    nothing = vec.limit(0)
    assert SI.similar_topk(nothing, 3, method="lsh").count() == 0 and SI.similar_topk(nothing, 3).count() == 0


def test_feed_answers_the_given_sessions_only(spark):
    views = spark.createDataFrame([("a", 1, ts("2024-01-01")), ("b", 1, ts("2024-01-01"))], VIEWS)
    sim = spark.createDataFrame([(1, 7, 0.5)], SIM)
    trending = spark.createDataFrame([(21, 1, 9)], "repository_id long, rank long, growth long")
    one = spark.createDataFrame([("a",)], "session_id string")
    assert {r.session_id for r in FD.feed(trending, views, sim, one, page_size=3).collect()} == {"a"}


def test_combined_feed_cold_and_warm_sessions(spark):
    views = spark.createDataFrame([("warm", 1, ts("2024-01-01")), ("warm", 21, ts("2024-01-02"))], VIEWS)
    sim = spark.createDataFrame([(1, 7, 0.5)], SIM)
    trending = spark.createDataFrame([(20 + i, i, 100 - i) for i in range(1, 6)],
                                     "repository_id long, rank long, growth long")
    sessions = spark.createDataFrame([("warm",), ("cold",)], "session_id string")
    out = {(r.session_id, r.rank): (r.repository_id, r.source)
           for r in FD.feed(trending, views, sim, sessions, page_size=3).collect()}
    assert out[("warm", 1)] == (7, "personalized") and ("warm", 2) not in out
    # a new session gets the growth list, page of 3, nothing seen yet
    assert [out[("cold", i)] for i in (1, 2, 3)] == [(21, "trending"), (22, "trending"), (23, "trending")]


def test_feed_sessions_are_all_with_views_and_the_cold_ones(spark, tmp_path):
    from reposcope.sources import fixtures as FX

    events = [(1, "view", '{"k": 1}'), (2, "click", '{"k": 2}'), (3, "view", '{"k": 1}'), (4, "purchase", '{"k": 1}')]
    (spark.createDataFrame([(u, t, ts("2024-01-01"), p) for u, t, p in events], "user_id long, event_type string, ts timestamp, props string")
     .write.parquet(str(tmp_path / "events.parquet")))
    spark.createDataFrame([(0,)], "n_nationkey long").write.parquet(str(tmp_path / "nation.parquet"))
    sessions = FX.feed_sessions(spark, str(tmp_path))
    assert sorted(r.session_id for r in sessions.collect()) == ["new0", "u1", "u2", "u3"]
    sim = spark.createDataFrame([(1, 7, 0.5), (2, 8, 0.4)], SIM)
    trending = spark.createDataFrame([(21, 1, 9)], "repository_id long, rank long, growth long")
    feed = lambda s: sorted((r.session_id, r.repository_id) for r in FD.feed(trending, FX.views(spark, str(tmp_path)), sim, s, page_size=3).collect())
    assert feed(sessions) == [("new0", 21), ("u1", 7), ("u2", 8), ("u3", 7)]
    assert feed(sessions.where("session_id IN ('new0', 'u3')")) == [("new0", 21), ("u3", 7)]
