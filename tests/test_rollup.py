"""Growth from the daily rollup equals growth from all snapshots."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reposcope.operators import rollup as RU
from reposcope.operators.snapshots import trending_growth
from reposcope.session import scratch_path

COLS = "repository_id long, event_time timestamp_ntz, tie long, stargazers_count long, forks_count long"
ORDER = ("event_time", "tie")


def snapshots(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        t = datetime(2024, 1, 1) + timedelta(days=rng.randrange(20), hours=rng.choice([0, 0, 6, 12, 23]), microseconds=rng.choice([0, 0, 1]))
        rows.append((rng.randrange(25) if i % 3 else 7, t, i, rng.randrange(50), rng.randrange(50)))  # a third belong to one repository
    return rows


@pytest.mark.parametrize("as_of", [datetime(2024, 1, 15), datetime(2024, 1, 20, 12), datetime(2024, 1, 20, 6, 0, 0, 1)])
def test_batches_in_any_order(spark, as_of):
    rows = snapshots()
    whole = spark.createDataFrame(rows, COLS)
    table = RU.rollup_table(spark, scratch_path(spark, "t-rollup"), buckets=4)
    for i in range(4):  # every fourth snapshot: later batches hold earlier days
        RU.update_rollup(table, i, spark.createDataFrame(rows[3 - i::4], COLS), ORDER)
    RU.update_rollup(table, 3, spark.createDataFrame(rows[0::4], COLS), ORDER)  # again
    rollup = table.read()
    assert sorted(map(tuple, rollup.collect())) == sorted(map(tuple, RU.daily(whole, ORDER).collect()))
    assert rollup.count() <= 25 * 21
    want = [tuple(r) for r in trending_growth(whole, as_of, 5, 200, ORDER).collect()]
    got = RU.trending_from_rollup(rollup, as_of, 5, 200, ORDER, snapshots=whole)
    assert [tuple(r) for r in got.collect()] == want and want
    if as_of.hour:
        with pytest.raises(ValueError):
            RU.trending_from_rollup(rollup, as_of, 5, 200, ORDER)
    else:  # the rollup alone
        alone = RU.trending_from_rollup(rollup, as_of, 5, 200, ORDER)
        assert [tuple(r) for r in alone.collect()] == want
        assert all("t-rollup" in f for f in alone.inputFiles())
        assert "ExistingRDD" not in alone._jdf.queryExecution().toString()


def test_nulls_and_an_empty_rollup(spark):
    empty = spark.createDataFrame([], COLS)
    assert RU.daily(empty, ORDER).collect() == []
    table = RU.rollup_table(spark, scratch_path(spark, "t-rollup0"))
    RU.update_rollup(table, 0, empty, ORDER)
    RU.update_rollup(table, 1, spark.createDataFrame([(1, None, 1, 5, 5), (1, datetime(2024, 1, 3), 2, None, 5)], COLS), ORDER)
    assert [(r["repository_id"], str(r["day"]), r["stargazers_count"]) for r in table.read().collect()] == [(1, "2024-01-02", None)]
    assert RU.trending_from_rollup(table.read(), datetime(2024, 1, 15), 5, 10, ORDER).collect() == []
    assert table.read().where(F.col("tie") == 2).count() == 1
