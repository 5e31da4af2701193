import os

from pyspark.sql import functions as F

from conftest import SF001, ts
from reposcope.session import scratch_path
from reposcope.sources import fixtures as FX
from reposcope.streaming import jobs as ST


def test_entry_and_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "growth" in df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    from reposcope.plans import catalog
    assert set(catalog.queries()) - {"similar_topk_indexed"} <= set(sql)  # its recall and work have no SQL form


def test_stream_views_in_batches_equals_batch(spark):
    root = scratch_path(spark, "t-views")
    msgs = FX.view_messages(spark, SF001)
    for part in range(3):  # three landed files → three micro-batches
        (msgs.where(F.abs(F.hash("value")) % 3 == part).coalesce(1)
         .write.mode("append").text(f"{root}/src"))
    q = ST.stream_views(spark, f"{root}/src", f"{root}/sink", f"{root}/ckpt")
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{root}/sink").collect()))
    want = sorted(map(tuple, FX.views(spark, SF001).collect()))
    assert got == want
    # a restart from the same checkpoint finds nothing new: no duplicates
    q2 = ST.stream_views(spark, f"{root}/src", f"{root}/sink", f"{root}/ckpt")
    q2.awaitTermination()
    assert spark.read.parquet(f"{root}/sink").count() == len(want)


def test_stream_ingest_dead_letters(spark):
    root = scratch_path(spark, "t-ingest")
    FX.crawl_result_messages(spark, SF001).write.text(f"{root}/src")
    ST.stream_ingest(spark, f"{root}/src", f"{root}/out", f"{root}/ckpt").awaitTermination()
    n_parts = FX.table(spark, SF001, "part").count()
    assert spark.read.parquet(f"{root}/out/repositories").count() == n_parts
    assert spark.read.parquet(f"{root}/out/dead_letter").count() == (n_parts + 49) // 50
    assert spark.read.parquet(f"{root}/out/embed_requests").count() > 0


def test_crawl_gate_sees_crawls_stored_while_it_runs(spark):
    root = scratch_path(spark, "t-gate")
    line = '{"repository":{"id":%d,"full_name":"o/r","pushed_at":"2024-01-01T00:00:00Z"},"discovered_at":"2024-01-02T00:00:00Z"}'
    reads = []

    def stored():
        reads.append(1)
        rows = [(1, ts("2024-06-01"))] if len(reads) > 1 else [(1, None)]
        return spark.createDataFrame(rows, "id long, last_crawled_at timestamp_ntz")

    for _ in range(2):
        spark.createDataFrame([(line % 1,)], "value string").coalesce(1).write.mode("append").text(f"{root}/src")
    ST.stream_crawl_gate(spark, f"{root}/src", stored, f"{root}/out", f"{root}/ckpt", max_files=1).awaitTermination()
    assert len(reads) == 2
    assert [tuple(r) for r in spark.read.parquet(f"{root}/out").groupBy("batch_id").count().collect()] == [(0, 1)]


def test_sinks_round_trip(spark):
    from reposcope.sources import sinks
    root = scratch_path(spark, "t-sinks")
    os.makedirs(f"{root}/files/readmes", exist_ok=True)
    for i, text in [(7, "héllo\nworld"), (12, "x" * 5000)]:
        with open(f"{root}/files/readmes/{i}.md", "w", encoding="utf-8") as fh:
            fh.write(text)
    got = {r.repository_id: len(r.body) for r in sinks.read_readmes(spark, f"{root}/files").collect()}
    assert got == {7: 11, 12: 5000}  # whole texts
    with open(f"{root}/files/readmes/13.md", "wb") as fh:
        fh.write(b"ok \xff\xfe end")
    bad = sinks.read_readmes(spark, f"{root}/files").where("repository_id = 13").first().body
    assert bad.startswith("ok \ufffd") and bad.endswith(" end")
    st = FX.stats(spark, SF001)
    sinks.append_snapshots(st, f"{root}/stats")
    back = spark.read.parquet(f"{root}/stats")
    assert back.count() == st.count() and "row_hash" in back.columns
    assert back.where("event_month = '202401'").count() == st.count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.append_snapshots(st, f"{root}/spread")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(f"{root}/spread").inputFiles()) > 2  # one month, several tasks


def test_stream_repositories_in_batches_equals_one_upsert(spark):
    from reposcope.operators.upsert import upsert_repositories
    root = scratch_path(spark, "t-repos")
    repos = FX.repos(spark, SF001)
    records = FX.repository_records(spark, SF001)
    # Four landed files; arrival order = file order, then seq inside a file.
    for part in range(4):
        chunk = records.where(F.col("id") % 4 == part).select(F.concat(
            F.lit('{"repository":'), F.col("record"),
            F.lit(',"crawled_at":"'), F.lit(f"2023-0{part + 1}-01T00:00:00Z"),
            F.lit('","seq":'), (F.col("id") + part * 100000).cast("string"), F.lit("}")).alias("value"))
        chunk.coalesce(1).write.mode("append").text(f"{root}/src")
    q = ST.stream_repositories(spark, f"{root}/src", repos, f"{root}/state", f"{root}/ckpt", max_files=1)
    q.awaitTermination()
    got = ST.latest_version(spark, f"{root}/state")
    # The same messages applied in one batch.
    flat = spark.read.text(f"{root}/src").select(F.from_json("value", ST.CRAWL_RESULT_T).alias("m"))
    from reposcope.sources.ingest import flatten_repository, parse_time
    msgs = flat.select(*flatten_repository(F.col("m.repository")),
                       parse_time(F.col("m.crawled_at")).alias("_lca"), F.col("m.seq").alias("seq"))
    incoming = msgs.select(*[F.col("_lca").alias(c) if c == "last_crawled_at"
                             else (F.col(c) if c in msgs.columns else F.lit(None).cast(repos.schema[c].dataType).alias(c))
                             for c in repos.columns], "seq")
    want = upsert_repositories(repos, incoming)
    cols = ["id", "name", "description", "license_key", "last_crawled_at", "created_at"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    from reposcope.sources.delta_table import DeltaTable
    assert DeltaTable(spark, f"{root}/state").newest() == 4  # the table it began with, and four batches
    # With a new checkpoint the stream goes on from the stored table, not from what it began with.
    ST.stream_repositories(spark, f"{root}/src", repos.limit(0), f"{root}/state", f"{root}/ckpt2", max_files=1).awaitTermination()
    again = ST.latest_version(spark, f"{root}/state")
    assert again.count() == got.count() and DeltaTable(spark, f"{root}/state").newest() == 8


def test_embed_texts_encoder_paths(spark):
    import numpy as np

    from reposcope.operators.embed import embed_texts
    docs = spark.createDataFrame([(1, "Alpha beta beta"), (2, ""), (3, None)], "repository_id long, text string")
    hashed = {r.repository_id: r.embedding for r in embed_texts(docs, dim=16).collect()}
    assert len(hashed[1]) == 16 and abs(sum(x * x for x in hashed[1]) - 1.0) < 1e-5
    assert sum(abs(x) for x in hashed[2]) == 0.0  # empty text → zero vector

    def factory():
        def encode(texts):
            out = np.zeros((len(texts), 4), dtype=np.float32)
            for i, t in enumerate(texts):
                out[i, len(t) % 4] = 1.0
            return out
        return encode

    model = {r.repository_id: list(r.embedding) for r in embed_texts(docs, encoder_factory=factory).collect()}
    assert model == {1: [0.0, 0.0, 0.0, 1.0], 2: [1.0, 0.0, 0.0, 0.0], 3: [1.0, 0.0, 0.0, 0.0]}


def test_rewrite_deduped_and_versions(spark):
    from reposcope.sources import sinks
    root = scratch_path(spark, "t-rewrite")
    st = FX.stats_long(spark, SF001, coarse=True)
    sinks.rewrite_deduped(st, f"{root}/deduped", order_cols=("event_time", "tie"))
    from reposcope.operators.snapshots import dedupe_check
    n_after = dedupe_check(st, order_cols=("event_time", "tie")).first().n_after
    assert spark.read.parquet(f"{root}/deduped").count() == n_after
    p = sinks.write_version(st.limit(5), f"{root}/tbl", 3)
    assert p.endswith("v=3") and spark.read.parquet(p).count() == 5
    assert ST.latest_version(spark, f"{root}/tbl").count() == 5


def test_past_counters_prunes_month_partitions(spark):
    from reposcope.operators.snapshots import past_counters
    from reposcope.sources import sinks
    root = scratch_path(spark, "t-months")
    st = FX.stats_long(spark, SF001)
    sinks.append_snapshots(st, f"{root}/stats")
    stored = spark.read.parquet(f"{root}/stats")
    q = past_counters(stored, "1996-01-01 00:00:00", order_cols=("event_time", "tie"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and "<= 199601" in plan
    want = past_counters(st, "1996-01-01 00:00:00", order_cols=("event_time", "tie"))
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, want.collect()))


def test_stream_dimensions_in_batches_equals_one_upsert(spark):
    from reposcope.operators import upsert as UP
    root = scratch_path(spark, "t-dims")
    repos = FX.repos(spark, SF001)
    initial = {"repositories": repos, "owners": FX.owners(spark, SF001), "licenses": FX.licenses(spark, SF001),
               "bridges": FX.bridge_rows(spark, SF001)}
    records = FX.repository_records(spark, SF001)
    lang_json = FX.landed_languages(spark, SF001).withColumnRenamed("repository_id", "id")
    rec = records.join(lang_json, "id", "left").select(
        "id", F.when(F.col("body").isNotNull(),
                     F.regexp_replace("record", r"\}$", F.concat(F.lit(',"languages":'), F.col("body"), F.lit("}"))))
        .otherwise(F.col("record")).alias("record"))
    for part in range(3):
        (rec.where(F.col("id") % 3 == part).select(F.concat(
            F.lit('{"repository":'), F.col("record"), F.lit(',"crawled_at":"2023-0'), F.lit(str(part + 1)),
            F.lit('-01T00:00:00Z","seq":'), (F.col("id") + part * 100000).cast("string"), F.lit("}")).alias("value"))
         .coalesce(1).write.mode("append").text(f"{root}/src"))
    ST.stream_dimensions(spark, f"{root}/src", initial, f"{root}/state", f"{root}/ckpt", max_files=1).awaitTermination()
    allmsg = ST._dimension_messages(spark.read.text(f"{root}/src"), repos.columns, repos.schema)
    rules = {"repositories": UP.upsert_repositories, "owners": UP.upsert_owners,
             "licenses": UP.upsert_licenses, "bridges": UP.upsert_bridges}
    for table, rule in rules.items():
        got = ST.latest_version(spark, f"{root}/state/{table}")
        want = rule(initial[table], allmsg[table])
        cols = [c for c in want.columns if c not in ("created_at",)]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect())), table
    n_lang = ST.latest_version(spark, f"{root}/state/bridges").where("kind = 'lang'").count()
    assert n_lang == FX.langs(spark, SF001).count()


def test_stream_source_as_reader_options(spark):
    root = scratch_path(spark, "t-opts")
    FX.view_messages(spark, SF001).write.text(f"{root}/src")
    src = {"format": "text", "path": f"{root}/src", "maxFilesPerTrigger": "1"}
    ST.stream_views(spark, src, f"{root}/sink", f"{root}/ckpt").awaitTermination()
    assert spark.read.parquet(f"{root}/sink").count() == FX.views(spark, SF001).count()


def test_two_stream_change_detection_forms_agree(spark):
    root = scratch_path(spark, "t-two")
    msgs = FX.snapshot_messages(spark, SF001)
    for y in (1995, 1997, 1999, 2001):  # four landed files, in time order
        msgs.where((F.col("year") >= y) & (F.col("year") < y + 2)).select("value").coalesce(1) \
            .write.mode("append").text(f"{root}/src")
    ST.stream_snapshots(spark, f"{root}/src", f"{root}/a", f"{root}/ca", max_files=1,
                        state_partitions=4).awaitTermination()
    ST.stream_snapshots_versioned(spark, f"{root}/src", f"{root}/b", f"{root}/sb", f"{root}/cb",
                                  max_files=1).awaitTermination()
    cols = ["repository_id", "event_time", "tie", "stargazers_count", "forks_count"]
    a = sorted(map(tuple, spark.read.parquet(f"{root}/a").select(cols).collect()))
    b = sorted(map(tuple, spark.read.parquet(f"{root}/b").select(cols).collect()))
    assert a == b and len(a) > 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"  # restored after the start
