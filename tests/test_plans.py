"""Plan-shape guards for the scale properties the operators rely on."""

import re

from conftest import SF001
from reposcope.operators import enrich as EN
from reposcope.operators import feed as FD
from reposcope.operators import snapshots as S
from reposcope.sources import fixtures as FX


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_past_cutoff_reaches_the_scan(spark):
    p = plan(S.past_counters(FX.stats(spark, SF001), "2024-01-24 00:00:00"))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(ts,2024-01-24", p)
    # only the columns the aggregate needs are read
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double,props:string>" in p


def test_top_one_and_history_use_partial_window_limits(spark):
    assert plan(S.latest_stat(FX.stats(spark, SF001))).count("WindowGroupLimit") == 2
    p = plan(FD.session_history(FX.views(spark, SF001), 15))
    assert "WindowGroupLimit" in p and "Partial" in p and "In(event_type, [click,view])" in p


def test_enrichment_folds_children_in_one_aggregate(spark):
    e = EN.enrich(FX.repos(spark, SF001), FX.owners(spark, SF001), FX.licenses(spark, SF001),
                  FX.tags(spark, SF001), FX.topics(spark, SF001), FX.langs(spark, SF001))
    p = plan(e)
    # one partial + one final collect aggregate for all three bridges
    assert len(re.findall(r"ObjectHashAggregate\(keys=\[repository_id", p)) == 2


def test_growth_ranking_is_one_scan(spark):
    from conftest import ts
    p = plan(S.trending_growth(FX.stats(spark, SF001), ts("2024-01-31"), 7))
    assert p.count("FileScan parquet") == 1 and p.count("Exchange hashpartitioning") == 1
