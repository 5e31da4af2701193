"""Facet index and seen sets as bitmaps: the same answers as from the rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from reposcope.functions.bitmaps import as_words, ids_of
from reposcope.operators import facet_index as FI
from reposcope.operators import seen_set as SE
from reposcope.operators.facets import facet_filter, top_unseen
from reposcope.session import scratch_path

IDS = [-200, -65, -64, -1, 0, 1, 62, 63, 64, 127, 128, 5000, 2**40, 2**62]


def test_words_and_back(spark):
    rows = [("a", i) for i in IDS] + [("a", 63), ("b", 7), ("b", None), (None, 9), (None, 9)]
    words = as_words(spark.createDataFrame(rows, "k string, id long"), ["k"], "id")
    got = [tuple(r) for r in ids_of(words, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, i) for k, i in rows if i is not None}
    assert words.where("k = 'a'").count() == len({i >> 6 for i in IDS})
    assert ids_of(as_words(spark.createDataFrame([], "k string, id long"), ["k"], "id"), "id").count() == 0


def bridges(spark, seed=1):
    rng = random.Random(seed)
    ids = [*IDS, *range(300, 380)]
    make = lambda col, values: [(i, v) for i in ids for v in values if rng.random() < 0.4] + [(None, values[0]), (ids[0], None), (ids[1], values[0])] * 2
    rows = {"langs": make("language", ["Go", "Rust", "go"]), "tags": make("tag", ["web", "cli"]), "topics": make("topic", ["db", "ml", ""])}
    cols = {"langs": "language", "tags": "tag", "topics": "topic"}
    return {b: spark.createDataFrame(r, f"repository_id long, {cols[b]} string") for b, r in rows.items()}, ids


def test_index_answers_as_the_bridges_do(spark):
    kw, ids = bridges(spark)
    ranked = spark.createDataFrame([(i, n) for n, i in enumerate([*ids, ids[3], 99999, None])], "repository_id long, rank int")
    table = FI.index_table(spark, scratch_path(spark, "t-facets"), buckets=4)
    split = {b: [d.where(F.pmod(F.xxhash64(*d.columns), F.lit(3)) == n) for n in range(3)] for b, d in kw.items()}
    for n in range(3):
        FI.add_to_index(table, n, *[split[b][n] for b in ("langs", "tags", "topics")])
    FI.add_to_index(table, 2, *[split[b][2] for b in ("langs", "tags", "topics")])  # again
    key = lambda rows: sorted(rows, key=str)
    assert key(map(tuple, table.read().collect())) == key(map(tuple, FI.facet_postings(**kw).collect()))
    for languages, tag_names, topic_names in itertools.product([(), ("Go",), ("Go", "Rust"), ("GO", None)], [(), ("web", "cli")], [(), ("ml", "")]):
        ask = dict(languages=languages, tag_names=tag_names, topic_names=topic_names)
        want = key(map(tuple, facet_filter(ranked, **kw, **ask).collect()))
        for index in (table, table.read()):
            got = FI.facet_filter_indexed(ranked, index, **ask)
            assert got.columns == ranked.columns and key(map(tuple, got.collect())) == want
    with pytest.raises(ValueError):
        FI.matching_words(table.read())

    gone = {b: d.where("repository_id % 2 = 0") for b, d in kw.items()}
    FI.remove_from_index(table, 3, *[gone[b] for b in ("langs", "tags", "topics")])
    left = {b: d.where("repository_id % 2 <> 0") for b, d in kw.items()}
    want = key(map(tuple, facet_filter(ranked, **left, languages=["Go"], tag_names=["web"]).collect()))
    assert key(map(tuple, FI.facet_filter_indexed(ranked, table, languages=["Go"], tag_names=["web"]).collect())) == want and want


def test_request_reads_its_buckets_and_joins_no_bridge(spark):
    kw, ids = bridges(spark)
    table = FI.index_table(spark, scratch_path(spark, "t-facet-plan"), buckets=16)
    FI.add_to_index(table, 0, kw["langs"], kw["tags"], kw["topics"])
    ranked = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "repository_id long, rank int")
    out = FI.facet_filter_indexed(ranked, table, languages=["Go"], tag_names=["web"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1
    read = {r["f"] for r in FI.postings_of(table, ["Go"], ["web"]).select(F.input_file_name().alias("f")).distinct().collect()}
    everything = {r["f"] for r in table.read().select(F.input_file_name().alias("f")).distinct().collect()}
    assert 1 <= len(read) <= 2 and read < everything


def test_seen_sets_by_batches(spark):
    rng = random.Random(4)
    views = [(rng.choice(["hot", "hot", "a", "b", "c", None]), rng.choice([*range(40), *range(70, 100), -3, 2**40, None])) for _ in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "session_id string, repository_id long")
    table = SE.seen_table(spark, scratch_path(spark, "t-seen"), buckets=4)
    for n in range(3):
        SE.update_seen(table, n, frame(views[n::3]))
    SE.update_seen(table, 2, frame(views[2::3]))  # again
    stored = table.read()
    whole = {v for v in views if v[1] is not None}
    assert {tuple(r) for r in SE.seen_rows(stored).collect()} == whole and SE.seen_rows(stored).count() == len(whole)
    assert table.buckets_of(stored.where("session_id = 'hot'")) and len(table.buckets_of(stored.where("session_id = 'hot'"))) > 1

    listed = [*range(0, 100, 3), 2**40, 500, 501]
    rng.shuffle(listed)
    ranked = spark.createDataFrame([(i, n + 1) for n, i in enumerate(listed)], "repository_id long, rank long")
    sessions = frame(views + [("new", 1)])
    seen = frame(views)
    for offset, n in ((0, 5), (3, 4), (0, 100), (30, 10), (200, 5)):
        want = {tuple(r) for r in top_unseen(ranked, seen, sessions, offset, n).select("session_id", "position", "repository_id", "rank").collect()}
        got = SE.top_unseen_stored(ranked, stored, sessions, offset, n).select("session_id", "position", "repository_id", "rank")
        assert {tuple(r) for r in got.collect()} == want and (want or offset == 200)
    assert SE.top_unseen_stored(ranked, stored.limit(0), sessions, 0, 2).count() == 2 * sessions.select("session_id").distinct().count()
