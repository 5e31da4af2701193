"""Stored ranked lists: pages equal offset paging, and read only the ranges they need."""

import random
import re

from pyspark.sql import functions as F

from reposcope.operators.paging import page, ranked_rows, write_ranked


def test_pages_equal_offset_paging(spark, tmp_path):
    rng = random.Random(5)
    data = [(rng.randint(0, 40) if rng.random() < 0.9 else None, i, f"n{i}") for i in range(1000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "score int, id long, `a name` string").repartition(5)
    order = [F.desc("score"), F.asc("id")]
    path = str(tmp_path / "list")
    write_ranked(df, order, path, rows_per_range=100)
    assert ranked_rows(spark, path) == 1000
    expected = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for offset, limit in ((0, 50), (95, 20), (400, 350), (990, 50), (1000, 10), (5000, 10), (10, 0)):
        got = page(spark, path, offset, limit, df.schema).orderBy("rank").collect()
        assert [tuple(r) for r in got] == [(*r, offset + k + 1) for k, r in enumerate(expected[offset:offset + limit])]


def test_a_deep_page_reads_its_ranges_only(spark, tmp_path):
    path = str(tmp_path / "list")
    write_ranked(spark.range(2000).toDF("id"), [F.asc("id")], path, rows_per_range=100)
    index = spark.read.parquet(f"{path}/index").orderBy("_first").collect()
    deep = next(r for r in index if r["_first"] >= 1800)
    got = page(spark, path, deep["_first"], min(10, deep["_n"]), spark.range(1).toDF("id").schema)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(index) > 10 and re.search(rf"PartitionFilters: \[[^\]]*_range#\d+ = {deep['_range']}\)", plan)
    assert "rangepartitioning" not in plan and [r["id"] for r in got.orderBy("rank").collect()][0] == deep["_first"]


def test_an_empty_list_has_empty_pages(spark, tmp_path):
    df = spark.range(5).toDF("id").where("id > 9")
    path = str(tmp_path / "list")
    write_ranked(df, [F.asc("id")], path)
    assert ranked_rows(spark, path) == 0 and page(spark, path, 0, 10, df.schema).count() == 0
