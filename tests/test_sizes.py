"""What queries move, hold and compute as their tables grow."""

import numpy as np
from pyspark.sql import functions as F

from reposcope.plans import catalog


def test_page_render_broadcasts_neither_pages_nor_meta(spark, tmp_path):
    """Copies of a page take little room in a file, and none of a broadcast's limit."""
    part = spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("red blue").alias("p_name"), F.lit("Brand#13").alias("p_brand"),
                                  F.lit("PROMO").alias("p_type"), F.lit(3).alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    pages = spark.createDataFrame([(1, "u", "<head><title>a</title></head>"), (2, "u", "<p>no title</p>"), (2, "u", None), (99, "u", "<title>b</title>")],
                                  "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = catalog.queries()["page_render"](spark, str(tmp_path))
    rows = sorted(((r.page_id, r.n_chars, r.html_sha256) for r in out.collect()), key=str)
    assert [r[0] for r in rows] == [1, 2, 2] and rows[0][1] > 500
    assert {r[1] for r in rows[1:]} == {None, len("<p>no title</p>")}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def _copied(spark, n, block_rows=None):
    """Vectors that the exact search shuffles to its kernel, for n of them."""
    from reposcope.operators import similarity as SI

    seen = []
    kernel, SI._cogrouped = SI._cogrouped, lambda qs, cs, keys, k, groups: (seen.append(qs.count() + cs.count()), kernel(qs, cs, keys, k, groups))[1]
    try:
        vec = spark.range(n).select(F.col("id").alias("repository_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(i * F.col("id"))).alias("embedding"))
        SI.similar_topk(vec, 3)
    finally:
        SI._cogrouped = kernel
    return seen[0]


def test_copies_of_vectors_grow_with_the_vectors(spark):
    assert _copied(spark, 60_000) <= 6.1 * _copied(spark, 10_000)


def test_kernel_keeps_ties_repeated_ids_and_odd_vectors():
    import pandas as pd

    from reposcope.operators import similarity as SI
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    x = np.concatenate([x, np.tile(x[:3], (400, 1))])  # many copies, more than a list holds
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(len(x)) // 2 * 3  # every id twice
    x[7] = np.nan
    got = SI._block_topk(4, rows_per_slice=50)(pd.DataFrame({"q_id": ids, "q_unit": list(x)}), pd.DataFrame({"c_id": ids, "c_unit": list(x)}))
    s = np.einsum("id,jd->ij", x, x)
    want = []
    for i in np.flatnonzero(np.isfinite(x[:, 0])):
        able = np.flatnonzero((ids != ids[i]) & np.isfinite(s[i]))
        best = able[np.lexsort((ids[able], -np.round(s[i][able], 9)))][:4]
        want += [(int(ids[i]), int(ids[j]), round(float(s[i, j]), 9) + 0.0) for j in best]
    assert sorted((a, b, round(c, 9) + 0.0) for a, b, c in zip(got.source_id, got.candidate_id, got.cosine)) == sorted(want)


def test_kernel_holds_a_small_matrix_of_products():
    import tracemalloc

    from reposcope.operators import similarity as SI
    x = np.random.default_rng(4).normal(size=(20_000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    import pyarrow as pa
    side = lambda p, m: pa.table({f"{p}_id": ids[:m], f"{p}_unit": pa.FixedSizeListArray.from_arrays(pa.array(x[:m].ravel()), 8).cast(pa.list_(pa.float64()))})
    q, c = side("q", 3000), side("c", 20_000)
    tracemalloc.start()
    SI._block_topk(5)(q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_dual_tree_scores_blocks_not_handfuls(monkeypatch):
    from reposcope.llm import exact_topk as E
    rng = np.random.default_rng(6)
    x = rng.integers(-1000, 1000, size=(6000, 32))
    q, calls, scores = x[:60], [], E.exact_scores
    monkeypatch.setattr(E, "exact_scores", lambda a, b: (calls.append(len(b)), scores(a, b))[1])
    found = E.dual_tree(np.arange(60), q, [np.array([i]) for i in range(len(x))], x, 5, np.full(60, -np.inf)).found
    s = q @ x.T
    s[np.arange(60), np.arange(60)] = -(1 << 60)
    assert [[i for _, i in f] for f in found] == [list(np.lexsort((np.arange(len(x)), -row))[:5]) for row in s]
    assert len(calls) <= 400


def test_reranking_moves_no_vector_for_a_pair(spark):
    """The shuffles that carry vectors come before the pairs are expanded."""
    from reposcope.operators import neighbour_index as NI
    x = np.random.default_rng(8).normal(size=(600, 6))
    df = spark.createDataFrame([(i // 2 * 2, [float(v) for v in row]) for i, row in enumerate(x)], "repository_id long, embedding array<float>")
    index = NI.build_index(df, NI.fit_index(df, k=4))
    got = NI.search_index(index, df, df, k=4)
    plan = got._jdf.queryExecution().optimizedPlan().toString().replace("Python", "")
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("c_unit"), plan  # what comes after the kernel has no vector
    rows = got.collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {r.source_id for r in rows} == set(range(0, 600, 2)) and all(r.source_id != r.candidate_id for r in rows)
    for r in rows[:40]:  # an id stands for two vectors
        assert np.abs(u[r.source_id:r.source_id + 2] @ u[r.candidate_id:r.candidate_id + 2].T - r.cosine).min() < 1e-6
