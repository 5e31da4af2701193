"""Tables kept by deltas."""

import os
import random

from pyspark.sql import functions as F

from reposcope.operators.upsert import upsert_bridges, upsert_vectors
from reposcope.session import scratch_path
from reposcope.sources import storage
from reposcope.sources.delta_table import DeltaTable

VEC = "repository_id long, embedding array<float>"
MSG = f"{VEC}, seq long"


def files(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def content(df):
    return sorted((r["repository_id"], tuple(r["embedding"])) for r in df.collect())


def test_a_batch_writes_touched_buckets_only(spark):
    root = scratch_path(spark, "t-delta")
    t = DeltaTable(spark, root, ["repository_id"], buckets=16)
    t.create(spark.range(400).select(F.col("id").alias("repository_id"), F.array(F.lit(0.0).cast("float")).alias("embedding")))
    before = files(root)
    assert len({f.split("/")[2] for f in before}) == 16
    held = t.apply(1, spark.createDataFrame([(5, [1.0], 1), (5, [2.0], 2), (900, [3.0], 3), (7, [0.0], 4)], MSG), upsert_vectors)
    new = files(root) - before
    assert before <= files(root) and 1 <= len(held) <= 2  # row 7 is as it was, so its bucket is not written
    assert {f.split("/")[2] for f in new} == {f"bucket={b}" for b in held} and len(new) == len(held)
    got = dict(content(t.read()))
    assert len(got) == 401 and got[5] == (2.0,) and got[900] == (3.0,) and got[7] == (0.0,)
    # A batch whose rows change nothing writes nothing.
    now = files(root)
    assert t.apply(2, spark.createDataFrame([(5, [2.0], 1)], MSG), upsert_vectors) == [] and files(root) == now
    # Only the buckets of the keys are scanned for the next batch.
    near = t.current(spark.createDataFrame([(6, [0.0], 1)], MSG))
    assert content(near) == [(6, (0.0,))]
    scans = [x for x in near._jdf.queryExecution().toString().split("PartitionFilters: ")[1:]]
    assert scans and all("bucket" in x.split("]")[0] for x in scans)
    read = t.read(buckets=[3]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("bucket=")[1].split("/")[0] for r in read if "bucket=" in r["f"]} <= {"3"}


def test_batches_equal_one_upsert_through_folds(spark):
    rng = random.Random(5)
    root = scratch_path(spark, "t-folds")
    start = spark.createDataFrame([(i, [float(i)]) for i in range(60)], VEC)
    t = DeltaTable(spark, root, ["repository_id"], buckets=4, fold_after=3, keep=2)
    t.create(start)
    msgs = [[(rng.randrange(80), [float(rng.randrange(3))], 100 * b + i) for i in range(rng.choice([1, 9]))] for b in range(8)]
    for b, rows in enumerate(msgs, 1):
        t.apply(b, spark.createDataFrame(rows, MSG), upsert_vectors)
        if b == 5:  # the same batch again, as after a crash
            t.apply(b, spark.createDataFrame(rows, MSG), upsert_vectors)
    want = upsert_vectors(start, spark.createDataFrame([r for rows in msgs for r in rows], MSG))
    assert content(DeltaTable(spark, root).read()) == content(want)
    assert len(storage.names(spark, f"{root}/log")) == 2  # older states and what only they needed are gone
    assert len(storage.names(spark, f"{root}/delta")) <= 4
    assert content(t.read(7)) != [] and t.newest() == 8


def test_an_unfinished_batch_is_not_seen(spark):
    root = scratch_path(spark, "t-crash")
    t = DeltaTable(spark, root, ["repository_id"], buckets=4)
    t.create(spark.createDataFrame([(1, [1.0])], VEC))
    spark.createDataFrame([(1, [9.0], 0)], "repository_id long, embedding array<float>, bucket int").write.partitionBy("bucket").parquet(f"{root}/delta/seq=1")
    assert content(t.read()) == [(1, (1.0,))]
    t.apply(1, spark.createDataFrame([(2, [2.0], 1)], MSG), upsert_vectors)
    assert content(t.read()) == [(1, (1.0,)), (2, (2.0,))]


def test_null_parts_of_a_key_and_a_hot_repository(spark):
    root = scratch_path(spark, "t-bridge")
    cols = "repository_id long, kind string, name string, size long"
    start = spark.createDataFrame([(1, "tag", f"t{i}", None) for i in range(300)] + [(2, "lang", None, 3)], cols)
    t = DeltaTable(spark, root, ["repository_id", "kind", "name"], by=["repository_id", "kind"], buckets=8)
    t.create(start)
    new = spark.createDataFrame([(2, "lang", None, 5, 1), (1, "tag", "t0", None, 2), (1, "tag", "u", None, 3)], f"{cols}, seq long")
    t.apply(1, new, upsert_bridges)
    got = sorted(map(str, map(tuple, t.read().collect())))
    assert got == sorted(map(str, map(tuple, upsert_bridges(start, new).collect())))
    assert len(got) == 302


def test_an_empty_table(spark):
    root = scratch_path(spark, "t-empty")
    t = DeltaTable(spark, root, ["repository_id"])
    t.create(spark.createDataFrame([], VEC))
    assert t.read().collect() == [] and t.read().columns == ["repository_id", "embedding"]
    t.apply(1, spark.createDataFrame([], MSG), upsert_vectors)
    t.apply(2, spark.createDataFrame([(4, None, 1)], MSG), upsert_vectors)
    assert [tuple(r) for r in t.read().collect()] == [(4, None)]
