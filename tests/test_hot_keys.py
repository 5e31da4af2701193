import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001
from reposcope.functions.ordinal import rank_within
from reposcope.operators import similarity as SI
from reposcope.operators import snapshots as S
from reposcope.sources import fixtures as FX

SCHEMA = ("repository_id long, event_time timestamp_ntz, stargazers_count long, watchers_count long, "
          "forks_count long, open_issues_count long, pushed_at timestamp_ntz, score double")


def hot_rows(n=3000, seed=3):
    """Repository 1 holds most rows, spread over several days; states repeat
    across day boundaries."""
    rnd = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        rid = 1 if i % 4 else rnd.randint(2, 20)
        t = t0 + timedelta(minutes=7 * i)
        out.append((rid, t, rnd.randint(0, 2), 0, rnd.randint(0, 1), 0, t, 1.0))
    return out


def test_rank_within_equals_row_number(spark):
    df = spark.createDataFrame(hot_rows(), SCHEMA)
    w = Window.partitionBy("repository_id").orderBy(F.desc("event_time"))
    want = {(r.repository_id, r.event_time): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    got_df = rank_within(df, ["repository_id"], [F.desc("event_time")], F.date_trunc("day", "event_time"),
                         bucket_desc=True)
    got = {(r.repository_id, r.event_time): r.rn for r in got_df.collect()}
    assert got == want


def test_bucketed_change_detection_equals_sequential(spark):
    data = hot_rows()
    df = spark.createDataFrame(data, SCHEMA)
    last, want = {}, set()
    for r in sorted(data, key=lambda x: x[1]):
        state = (r[2], r[3], r[4], r[5])
        if last.get(r[0]) != state:
            want.add((r[0], r[1]))
        last[r[0]] = state
    for bucket in ("day", "hour"):
        got = {(r.repository_id, r.event_time) for r in S.snapshots_changed(df, bucket=bucket).collect()}
        assert got == want
    # stored state continues the sequence: the first incoming row equal to it is skipped
    stored = spark.createDataFrame([(1, datetime(2023, 12, 31), data[1][2], 0, data[1][4], 0,
                                     datetime(2023, 12, 31), 1.0)], SCHEMA)
    first_hot = min(r[1] for r in data if r[0] == 1)
    got = {(r.repository_id, r.event_time) for r in S.snapshots_changed(df, stored).collect()}
    assert (1, first_hot) not in got


def test_lsh_returns_true_cosines_and_reasonable_recall(spark):
    vec = FX.vectors(spark, SF001)
    exact = {(r.source_id, r.candidate_id): r.cosine for r in SI.similar_topk(vec, 5, blocks=2).collect()}
    approx = SI.similar_topk(vec, 5, method="lsh", lsh_bits=3, lsh_tables=6, block_rows=64).collect()
    assert approx, "LSH found no pairs"
    hits = [r for r in approx if (r.source_id, r.candidate_id) in exact]
    assert all(abs(exact[(r.source_id, r.candidate_id)] - r.cosine) < 1e-9 for r in hits)
    assert len(hits) / len(exact) > 0.5
    assert max(r.rank for r in approx) <= 5


def test_empty_inputs(spark):
    from reposcope.functions.ordinal import global_rank
    from reposcope.operators import ranges as RG
    from reposcope.operators import upsert as UP
    from reposcope.operators.facets import top_unseen

    empty = spark.createDataFrame([], "k long, id long")
    assert global_rank(empty, [F.asc("id")]).count() == 0
    assert rank_within(empty, ["k"], [F.asc("id")], F.col("id")).count() == 0
    vec = FX.vectors(spark, SF001)
    none = spark.createDataFrame([], "repository_id long")
    assert SI.similar_topk(vec, 3, sources=none).count() == 0
    assert RG.adaptive_ranges(spark.createDataFrame([], "id long, v long")).count() == 0
    repos = FX.repos(spark, SF001)
    no_msgs = repos.limit(0).withColumn("seq", F.lit(0).cast("bigint"))
    assert UP.upsert_repositories(repos, no_msgs).count() == repos.count()
    ranked = spark.createDataFrame([(1, 1)], "repository_id long, rank long")
    seen = spark.createDataFrame([], "session_id string, repository_id long")
    sessions = spark.createDataFrame([("s",)], "session_id string")
    assert [r.repository_id for r in top_unseen(ranked, seen, sessions, 0, 5).collect()] == [1]
    assert S.snapshots_changed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_post_text_byte_budget_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from reposcope.operators.publish import post_text

    text = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"),
                   min_size=0, max_size=400)

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(text, min_size=1, max_size=6))
    def check(descs):
        rows = [(i, f"o/r{i}", d, {"Go": 1}, ["t"]) for i, d in enumerate(descs)]
        df = spark.createDataFrame(rows, "id long, full_name string, description string, "
                                         "languages map<string,bigint>, topics array<string>")
        for r in post_text(df, "https://example.org").collect():
            d = descs[r.repository_id]
            body = r.text.split("\n\n", 1)[1].rsplit("\n\n🔗 ", 1)[0]
            assert "�" not in body or "�" in d
            if body != d:  # cut: a prefix of the description plus "..."
                assert len(r.text.encode()) <= 270 and body.endswith("...") and d.startswith(body[:-3])

    check()


def test_top_unseen_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from reposcope.operators.facets import top_unseen

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.integers(min_value=1, max_value=30),
           st.lists(st.tuples(st.sampled_from("abc"), st.integers(min_value=0, max_value=35)), max_size=40),
           st.integers(min_value=0, max_value=10), st.integers(min_value=1, max_value=8))
    def check(n_list, seen_rows, offset, n):
        ranked = spark.createDataFrame([(100 + r, r) for r in range(1, n_list + 1)], "repository_id long, rank long")
        seen = spark.createDataFrame([(s, 100 + x) for s, x in seen_rows], "session_id string, repository_id long")
        sessions = spark.createDataFrame([(s,) for s in "abc"], "session_id string")
        got = {(r.session_id, r.position): r.repository_id
               for r in top_unseen(ranked, seen, sessions, offset, n).collect()}
        for s in "abc":
            seen_s = {100 + x for t, x in seen_rows if t == s}
            lst = [100 + r for r in range(1, n_list + 1) if 100 + r not in seen_s][offset:offset + n]
            assert [got.get((s, offset + i + 1)) for i in range(len(lst))] == lst
            assert not any(k[0] == s and k[1] > offset + len(lst) for k in got)

    check()


def test_change_detection_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    row = st.tuples(st.integers(min_value=1, max_value=3), st.integers(min_value=0, max_value=300),
                    st.integers(min_value=0, max_value=1), st.integers(min_value=0, max_value=1))

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(row, min_size=1, max_size=40, unique_by=lambda r: (r[0], r[1])),
           st.dictionaries(st.integers(min_value=1, max_value=3),
                           st.tuples(st.integers(min_value=0, max_value=1), st.integers(min_value=0, max_value=1)),
                           max_size=3))
    def check(rows, stored):
        t0 = datetime(2024, 1, 1)
        data = [(rid, t0 + timedelta(minutes=7 * m), s, 0, f, 0, t0, 1.0) for rid, m, s, f in rows]
        df = spark.createDataFrame(data, SCHEMA)
        latest = spark.createDataFrame([(rid, t0 - timedelta(days=1), s, 0, f, 0, t0, 1.0)
                                        for rid, (s, f) in stored.items()], SCHEMA)
        last = {rid: (s, 0, f, 0) for rid, (s, f) in stored.items()}
        want = set()
        for r in sorted(data, key=lambda x: (x[0], x[1])):
            state = (r[2], r[3], r[4], r[5])
            if last.get(r[0]) != state:
                want.add((r[0], r[1]))
            last[r[0]] = state
        got = {(r.repository_id, r.event_time) for r in S.snapshots_changed(df, latest, bucket="hour").collect()}
        assert got == want

    check()
