"""Cluster settings win; shared storage is required off a local master."""

from types import SimpleNamespace

import pytest

from reposcope import session as SS


def test_set_keys_are_kept(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64m")
    try:
        assert SS.get_session().conf.get(key) == "64m"
    finally:
        spark.conf.unset(key)


def test_checkpoint_folder_is_required_on_a_cluster(spark):
    nothing = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default),
                              sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        SS.checkpoint_root(nothing)
    assert SS.checkpoint_root(spark)


def test_materialized_frames_are_read_back(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    got = SS.materialized(df, "t-materialized")
    assert got.columns == ["n"] and sorted(r.n for r in got.collect()) == list(range(10))
    assert "parquet" in got._jdf.queryExecution().executedPlan().toString().lower()
