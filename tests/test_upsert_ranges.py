import random

from pyspark.sql import functions as F

from conftest import SF001, ts
from reposcope.operators import ranges as RG
from reposcope.operators import upsert as UP
from reposcope.sources import fixtures as FX

REPO = ("id long, name string, description string, homepage string, license_key string, "
        "is_archived boolean, is_disabled boolean, last_crawled_at timestamp_ntz, created_at timestamp_ntz")


def fold(current, messages):
    """Plain sequential application of the repository upsert rule."""
    state = dict(current)
    for m in messages:
        s = state.get(m["id"])
        cmp = ("description", "homepage", "license_key", "is_archived", "is_disabled")
        if s is None:
            state[m["id"]] = dict(m)
        elif any(s[c] != m[c] for c in cmp) or (s["last_crawled_at"] < m["last_crawled_at"]):
            state[m["id"]] = dict(m, created_at=s["created_at"])
    return state


def test_repository_upsert_rules(spark):
    cur = spark.createDataFrame([(1, "n", "d", None, "mit", False, False, ts("2024-01-10"), ts("2020-01-01"))], REPO)
    inc = spark.createDataFrame([
        (1, "stale-same", "d", None, "mit", False, False, ts("2024-01-01"), ts("2021-01-01"), 1),   # no-op
        (1, "stale-new", "d2", None, "mit", False, False, ts("2024-01-02"), ts("2021-01-01"), 2),   # overwrites
    ], REPO + ", seq long")
    r = UP.upsert_repositories(cur, inc).first()
    assert (r.name, r.description, r.last_crawled_at, r.created_at) == \
        ("stale-new", "d2", ts("2024-01-02"), ts("2020-01-01"))


def test_repository_upsert_equals_sequential_fold(spark):
    rnd = random.Random(7)
    current = {i: dict(id=i, name=f"c{i}", description=rnd.choice("ab"), homepage=None, license_key="x",
                       is_archived=False, is_disabled=False,
                       last_crawled_at=ts(f"2024-01-{rnd.randint(1, 28):02d}"), created_at=ts("2020-01-01"))
               for i in range(6)}
    msgs = []
    for seq in range(300):
        msgs.append(dict(id=rnd.randint(0, 8), name=f"m{seq}", description=rnd.choice("ab"), homepage=None,
                         license_key=rnd.choice(["x", None]), is_archived=rnd.random() < 0.2, is_disabled=False,
                         last_crawled_at=ts(f"2024-01-{rnd.randint(1, 28):02d}"), created_at=ts("2022-01-01"),
                         seq=seq))
    cols = ["id", "name", "description", "homepage", "license_key", "is_archived", "is_disabled",
            "last_crawled_at", "created_at"]
    cur_df = spark.createDataFrame([tuple(r[c] for c in cols) for r in current.values()], REPO)
    inc_df = spark.createDataFrame([tuple(m[c] for c in cols) + (m["seq"],) for m in msgs], REPO + ", seq long")
    got = {r.id: tuple(r[c] for c in cols) for r in UP.upsert_repositories(cur_df, inc_df).collect()}
    want = {k: tuple(v[c] for c in cols) for k, v in fold(current, msgs).items()}
    assert got == want


def test_licence_and_owner_rules(spark):
    cur = spark.createDataFrame([("mit", "MIT", "mit", None, "n0")], "key string, name string, spdx_id string, url string, node_id string")
    inc = spark.createDataFrame([("mit", "MIT", "mit", None, "n1", 1), (None, "X", "x", None, "n2", 2)],
                                "key string, name string, spdx_id string, url string, node_id string, seq long")
    rows = UP.upsert_licenses(cur, inc).collect()
    assert [(r.key, r.node_id) for r in rows] == [("mit", "n0")]  # node_id-only change ignored, null key skipped
    owners = spark.createDataFrame([(1, "a", None, None, "User")], "id long, login string, avatar_url string, html_url string, type string")
    inc_o = spark.createDataFrame([(1, "b", None, None, "User", 1), (2, "c", None, None, "User", 3),
                                   (2, "d", None, None, "User", 2)],
                                  "id long, login string, avatar_url string, html_url string, type string, seq long")
    got = {r.id: r.login for r in UP.upsert_owners(owners, inc_o).collect()}
    assert got == {1: "a", 2: "d"}  # never updated; first seen wins


def plain_recursion(values, lo, hi, cap, out):
    if lo > hi:
        return
    n = sum(1 for v in values if lo <= v <= hi)
    if lo == hi or n <= cap:
        if n:
            out.append((lo, hi, n))
        return
    mid = lo + (hi - lo) // 2
    plain_recursion(values, lo, mid, cap, out)
    plain_recursion(values, mid + 1, hi, cap, out)


def test_adaptive_ranges_equal_recursion(spark):
    df = FX.range_input(spark, SF001)
    values = [r.v for r in df.collect()]
    for cap in (50, 200):
        want = []
        plain_recursion(values, 50, 1_000_000, cap, want)
        got = sorted((r.lo, r.hi, r.n) for r in RG.adaptive_ranges(df, "v", 50, 1_000_000, cap).collect())
        assert got == sorted(want)


def test_adaptive_ranges_in_many_rounds(spark, monkeypatch):
    """Any number of halvings a round gives the same leaves, and no plan gathers rows in one group or task."""
    df = FX.range_input(spark, SF001)
    want = sorted(map(tuple, RG.adaptive_ranges(df, "v", 50, 1_000_000, 40).collect()))
    plans, write = [], RG.materialized
    monkeypatch.setattr(RG, "materialized", lambda x, name: plans.append(x._jdf.queryExecution().toString()) or write(x, name))
    for levels in (1, 3, 25):
        monkeypatch.setattr(RG, "LEVELS", levels)
        assert sorted(map(tuple, RG.adaptive_ranges(df, "v", 50, 1_000_000, 40).collect())) == want
    assert len(plans) > 20
    for plan in plans:
        assert "SinglePartition" not in plan and "FlatMapGroups" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_adaptive_ranges_hot_value(spark):
    df = spark.createDataFrame([(i, 500 if i % 3 == 0 else 600 + i) for i in range(3000)], "id long, v long")
    leaves = RG.adaptive_ranges(df, "v", 50, 1_000_000, 100)
    got = sorted((r.lo, r.hi, r.n) for r in leaves.collect())
    assert (500, 500, 1000) in got  # single-valued leaf above the cap
    assert sum(n for _, _, n in got) == 3000
    pages = RG.range_pages(df, RG.value_leaves(df, "v", 50, 1_000_000, 100), "v", "id", 100)
    hot = pages.where((F.col("lo") == 500) & (F.col("hi") == 500))
    assert hot.agg(F.max("page")).first()[0] == 10 and hot.count() == 1000


def test_repository_upsert_null_stored_crawl_time(spark):
    cur = spark.createDataFrame([(1, "n", "d", None, "mit", False, False, None, ts("2020-01-01"))], REPO)
    inc = spark.createDataFrame([
        (1, "same-later", "d", None, "mit", False, False, ts("2024-01-05"), ts("2021-01-01"), 1),  # NULL < t: no update
        (2, "new", "x", None, None, False, False, None, ts("2021-01-01"), 2),                     # insert
        (2, "new-later", "x", None, None, False, False, ts("2024-01-05"), ts("2021-01-01"), 3),   # NULL < t: no update
    ], REPO + ", seq long")
    got = {r.id: (r.name, r.last_crawled_at) for r in UP.upsert_repositories(cur, inc).collect()}
    assert got == {1: ("n", None), 2: ("new", None)}


def test_licence_upsert_matches_sequential_rule(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    names = st.sampled_from(["A", "B", None])
    msg = st.tuples(st.sampled_from(["k1", "k2", None]), names, st.sampled_from(["s", "t"]),
                    st.sampled_from(["n1", "n2", "n3"]))

    @settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(msg, min_size=1, max_size=12), st.booleans())
    def check(msgs, with_current):
        current = [("k1", "A", "s", None, "n0")] if with_current else []
        state = {c[0]: list(c[1:]) for c in current}
        for key, name, spdx, node in msgs:  # the SQL rule, one message at a time
            if key is None:
                continue
            s = state.get(key)
            if s is None or s[0] != name or s[1] != spdx or s[2] is not None:
                state[key] = [name, spdx, None, node]
        want = sorted((k, *v) for k, v in state.items())
        schema = "key string, name string, spdx_id string, url string, node_id string"
        cur = spark.createDataFrame(current, schema)
        inc = spark.createDataFrame([(k, n, s, None, nd, i) for i, (k, n, s, nd) in enumerate(msgs)],
                                    schema + ", seq long")
        got = sorted(tuple(r) for r in UP.upsert_licenses(cur, inc).select(
            "key", "name", "spdx_id", "url", "node_id").collect())
        assert got == want

    check()


def test_adaptive_ranges_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.integers(min_value=0, max_value=300), min_size=1, max_size=200),
           st.integers(min_value=1, max_value=40))
    def check(values, cap):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
        got = sorted((r.lo, r.hi, r.n) for r in RG.adaptive_ranges(df, "v", 10, 256, cap).collect())
        want = []
        plain_recursion(values, 10, 256, cap, want)
        assert got == sorted(want)
        inside = [v for v in values if 10 <= v <= 256]
        assert sum(n for _, _, n in got) == len(inside)  # cover
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))  # disjoint
        assert all(n <= cap or lo == hi for lo, hi, n in got)

    check()
