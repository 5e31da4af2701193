from pyspark.sql import functions as F

from conftest import SF001, ts
from reposcope.operators import snapshots as S
from reposcope.sources import fixtures as FX

SCHEMA = ("repository_id long, event_time timestamp_ntz, stargazers_count long, watchers_count long, "
          "forks_count long, open_issues_count long, pushed_at timestamp_ntz, score double")


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def snap(rid, t, stars, forks=0):
    return (rid, ts(t), stars, 0, forks, 0, ts(t), 1.0)


def test_change_detection_and_global_dedupe(spark):
    # states A, A, B, A
    df = rows(spark, [snap(1, "2024-01-01", 5), snap(1, "2024-01-02", 5),
                      snap(1, "2024-01-03", 6), snap(1, "2024-01-04", 5)])
    kept = [r.event_time.day for r in S.snapshots_changed(df).orderBy("event_time").collect()]
    assert kept == [1, 3, 4]  # first A, B, last A
    ded = [r.event_time.day for r in S.dedupe_global(df).orderBy("event_time").collect()]
    assert ded == [1, 3]  # A, B
    chk = S.dedupe_check(df).first()
    assert (chk.n_before, chk.n_after) == (4, 2)


def test_change_detection_against_stored_state(spark):
    incoming = rows(spark, [snap(1, "2024-01-05", 5), snap(1, "2024-01-06", 7), snap(2, "2024-01-05", 1)])
    latest = rows(spark, [snap(1, "2024-01-04", 5)])
    kept = sorted((r.repository_id, r.event_time.day) for r in S.snapshots_changed(incoming, latest).collect())
    assert kept == [(1, 6), (2, 5)]  # equal to stored → skipped; unknown repository → kept


def test_growth_rules(spark):
    df = rows(spark, [
        snap(1, "2024-01-20", 10, 5), snap(1, "2024-01-30", 8, 9),   # stars down, forks up → present
        snap(2, "2024-01-29", 1), snap(2, "2024-01-30", 50),         # only after cutoff → absent
        snap(3, "2024-01-10", 3), snap(3, "2024-01-30", 3),          # no growth → absent
    ])
    out = {r.repository_id: r for r in S.trending_growth(df, ts("2024-01-31"), days=7).collect()}
    assert set(out) == {1}
    assert (out[1].star_growth, out[1].fork_growth, out[1].growth, out[1].rank) == (-2, 4, 2, 1)


def test_one_pass_growth_equals_two_pass(spark):
    st = FX.stats(spark, SF001)
    cutoff = "2024-01-24 00:00:00"
    one = S.growth_table(st, cutoff).where("has_past").select(
        "repository_id", "latest_stars", "latest_forks", "past_stars", "past_forks")
    two = S.latest_counters(st).join(S.past_counters(st, cutoff), "repository_id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(one.columns).collect()))


def test_recently_pushed_uses_latest_row_and_ties(spark):
    df = rows(spark, [
        (1, ts("2024-01-01"), 1, 0, 0, 0, ts("2024-01-29"), 1.0),   # old row pushed late: ignored
        (1, ts("2024-01-05"), 1, 0, 0, 0, ts("2024-01-02"), 1.0),
        (2, ts("2024-01-05"), 1, 0, 0, 0, ts("2024-01-02"), 1.0),   # tie on latest time:
        (2, ts("2024-01-05"), 2, 0, 0, 0, ts("2024-01-29"), 1.0),   # any tied row counts
    ])
    got = sorted(r.repository_id for r in S.recently_pushed(df, "2024-01-28 00:00:00").collect())
    assert got == [2]


def test_trending_plan_is_one_scan_one_exchange(spark):
    plan = S.trending_growth(FX.stats(spark, SF001), ts("2024-01-31"), 7)._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "TakeOrderedAndProject" in plan
