"""The stored neighbour index against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reposcope.operators import neighbour_index as NI
from reposcope.operators import similarity as SI

VEC = "repository_id long, embedding array<float>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], VEC).repartition(4)


def clustered(n=1500, dim=20, clusters=40, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return centres[rng.integers(clusters, size=n)] + 0.25 * rng.normal(size=(n, dim))


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return np.sort(s, axis=1)[:, ::-1][:, :k]


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_recall_and_work(spark, kind):
    x = clustered() if kind == "clustered" else np.random.default_rng(1).normal(size=(1500, 20))
    df = frame(spark, x)
    model = NI.fit_index(df, k=5)
    index = NI.build_index(df, model)
    assert index.sizes.sum() == len(x)  # every row is in a list
    rows = NI.search_report(index, df, df, SI.similar_topk(df, 5), k=5).collect()
    assert len(rows) == len(x) and all(r["n"] == 5 for r in rows)
    assert np.mean([r["recall"] for r in rows]) >= 0.9
    assert max(r["exact_share"] for r in rows) <= 0.2
    if kind == "clustered":  # the probes are fitted to the data
        assert np.mean([r["scanned_share"] for r in rows]) < 0.25


def test_scores_are_exact_and_ranked(spark):
    x = clustered(400)
    df = frame(spark, x)
    index = NI.build_index(df, NI.fit_index(df, k=4))
    got = NI.search_index(index, df.where("repository_id < 50"), df, k=4).collect()
    want, u = brute(x, 4), x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {r["source_id"] for r in got} == set(range(50))
    for r in got:
        assert r["candidate_id"] != r["source_id"]
        assert abs(r["cosine"] - u[r["source_id"]] @ u[r["candidate_id"]]) < 1e-6
        assert r["cosine"] <= want[r["source_id"], r["rank"] - 1] + 1e-6


def test_one_hot_list_is_split(spark, monkeypatch):
    """A third of the rows are one vector: its list spans several groups, and lists stay whole."""
    x = np.concatenate([np.tile(clustered(1), (600, 1)), clustered(1200)])
    df = frame(spark, x)
    index = NI.build_index(df, NI.fit_index(df, k=3))
    monkeypatch.setattr(NI, "BLOCK_ROWS", 100)
    first, copies = NI._groups(index.sizes, 100)
    assert copies.max() >= 6 and index.sizes.max() >= 600
    spans = sorted({(int(a), int(b)) for a, b in zip(first, copies) if b > 1})
    assert all(a + b <= c for (a, b), (c, _) in zip(spans, spans[1:]))
    assert all(s <= 200 for s in np.bincount(first[copies == 1], weights=index.sizes[copies == 1]))
    rows = NI.search_report(index, df, df, SI.similar_topk(df, 3), k=3).collect()
    assert all(r["n"] == 3 for r in rows) and np.mean([r["recall"] for r in rows]) >= 0.9


def test_few_null_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0])], VEC)
    index = NI.build_index(df, NI.fit_index(df, k=10))
    got = sorted((r["source_id"], r["rank"], r["candidate_id"]) for r in NI.search_index(index, df, df, k=10).collect())
    assert got == [(1, 1, 2), (1, 2, 5), (2, 1, 1), (2, 2, 5), (5, 1, 2), (5, 2, 1)]
    assert NI.fit_index(df.where("repository_id = 3")) is None
    assert NI.search_index(index, df.where("repository_id = 4"), df, k=2).collect() == []


def test_search_of_few_lists_filters_the_scan(spark):
    df = frame(spark, clustered(800))
    index = NI.build_index(df, NI.fit_index(df, k=3))
    plan = NI.search_index(index, df.where(F.col("repository_id") == 7), df, k=3)._jdf.queryExecution().toString()
    assert "In(list" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tasks_score_bounded_blocks(spark, monkeypatch):
    """However many queries and probes there are, a task gets a block of queries, a bit a list, and a group of entries."""
    df = frame(spark, np.random.default_rng(4).normal(size=(1500, 20)))
    model = NI.fit_index(df, k=3, target_recall=1.0)
    assert model.probes > len(model.centroids) // 2  # most lists are probed
    index = NI.build_index(df, model)
    want = sorted(map(tuple, NI.search_index(index, df, df, k=3).collect()))
    monkeypatch.setattr(NI, "BLOCK_ROWS", 300)
    monkeypatch.setattr(NI, "_QUERY_VALUES", 20 * 100, raising=False)
    scored = NI._scored

    def held(model, rerank):
        run = scored(model, rerank)

        def checked(queries, entries):
            assert len(queries) <= 200 and len(entries) <= 600, (len(queries), len(entries))
            assert queries.nbytes <= len(queries) * (20 * 4 + 40), queries.nbytes
            return run(queries, entries)
        return checked

    monkeypatch.setattr(NI, "_scored", held)
    got = sorted(map(tuple, NI.search_index(index, df, df, k=3).collect()))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want])


def test_kernel_finds_the_best_codes_of_the_probed_lists(monkeypatch):
    """Against brute force, with copies of a vector, one of them the query, ids that come twice and slices of all kinds."""
    rng = np.random.default_rng(3)
    n, dim = 700, 10
    model = NI.IndexModel(rng.normal(size=(9, dim)).astype(np.float32), rng.normal(size=(3, 256, 4)).astype(np.float32), 4, n)
    lists, codes = rng.integers(9, size=n).astype(np.int32), rng.integers(256, size=(n, 3)).astype(np.uint8)
    ids = np.arange(n) * 7
    lists[:200], codes[:200], ids[300:320] = 4, codes[0], ids[:20]
    q_ids, q = np.arange(60) * 7, rng.normal(size=(60, dim)).astype(np.float32)
    wanted = rng.random((60, 9)) < 0.6
    wanted[0] = False
    monkeypatch.setattr(NI, "_SCORES", 1)  # slices of 256 queries
    monkeypatch.setattr(NI, "_COLUMNS", 64)
    monkeypatch.setattr(NI, "_DECODED_VALUES", 150 * dim)
    queries = pa.table({"q_id": q_ids, "unit": pa.array(q.tolist(), pa.list_(pa.float32())), "lists": NI._packed(np.packbits(wanted, axis=1, bitorder="little"))})
    entries = pa.table({"list": lists, "repository_id": ids, "code": NI._packed(codes)})
    got = NI._scored(model, 6)(queries, entries).to_pylist()
    scores = q @ (model.decode(codes) + model.centroids[lists]).T
    for r, s, mine, q_id in zip(got, scores, wanted, q_ids):
        s = np.where(mine[lists] & (ids != q_id), s, -np.inf).round(4)
        best = np.lexsort((ids, -s))[:6]
        best = best[np.isfinite(s[best])]
        assert r["q_id"] == q_id and r["near"] == ids[best].tolist() and np.allclose(r["approx"], s[best], atol=1e-3)


def test_rows_without_an_id_have_no_lists_and_are_in_none(spark):
    x = clustered(300)
    df = frame(spark, x)
    with_null = df.unionByName(df.where("repository_id < 5").withColumn("repository_id", F.lit(None).cast("long")))
    index = NI.build_index(with_null, NI.fit_index(df, k=3))
    got = NI.search_index(index, with_null, with_null, k=3).collect()
    assert len(got) == 3 * len(x) and all(r["source_id"] is not None and r["candidate_id"] is not None for r in got)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_and_norms_stand_for_the_same_units(spark, kind):
    """To the last bit; vectors of single precision travel as they are."""
    x = np.random.default_rng(12).normal(size=(300, 7))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [0.0] * 7), (902, [1.0] * 6 + [None])],
                               f"repository_id long, embedding array<{kind}>")
    normed = SI.normed_vectors(df)
    assert normed.schema["vec"].dataType.simpleString() == f"array<{kind}>"
    rows, units = normed.orderBy("repository_id").toArrow(), SI.unit_vectors(df).orderBy("repository_id").toArrow()
    assert rows.column("repository_id").to_pylist() == units.column("repository_id").to_pylist() == list(range(300))
    got = SI.unit_rows(SI.vector_rows(rows.column("vec")), rows.column("norm").to_numpy())
    assert (got == SI.vector_rows(units.column("unit"))).all()


def test_many_pairs_are_ranked_by_more_tasks(spark, monkeypatch):
    df = frame(spark, clustered(400))
    want = sorted(map(tuple, SI.similar_topk(df, 4).collect()))
    monkeypatch.setattr(SI, "RANKED_PAIRS", 100, raising=False)
    got = SI.similar_topk(df, 4, blocks=3)
    assert "hashpartitioning(source_id" in (plan := got._jdf.queryExecution().toString()) and ", 48)" in plan, plan  # 400 x 3 blocks x 4 pairs at most
    assert [r[:2] + r[3:] for r in sorted(map(tuple, got.collect()))] == [r[:2] + r[3:] for r in want]
    index = NI.build_index(df, NI.fit_index(df, k=4))
    ranked = NI.search_index(index, df, df, k=4)
    assert ", 16)" in ranked._jdf.queryExecution().toString() and ranked.count() == 1600
