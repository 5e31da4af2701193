"""Structured Streaming jobs over landed message files.

Every job reads JSON lines with a fixed schema (no inference), checkpoints
its progress in the given folder and can run continuously or with
``availableNow`` (process what is there, then stop) — the periodic jobs of
the reference are batch runs of these. Sinks are idempotent: a file sink
with its commit log, or ``foreachBatch`` writing one directory per batch id
with overwrite, so a batch replayed after a lost executor or driver
rewrites the same output instead of duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from reposcope.operators.embed import embed_texts
from reposcope.operators.snapshots import latest_stat, snapshots_changed
from reposcope.operators.upsert import (upsert_bridges, upsert_licenses, upsert_owners,
                                        upsert_repositories, upsert_vectors)
from reposcope.sources import storage
from reposcope.sources.delta_table import DeltaTable
from reposcope.sources.ingest import REPO_T, flatten_repository, needs_crawl, object_key, parse_time

VIEW_EVENT_T = "struct<sessionId:string,repositoryId:bigint,viewedAt:string>"
DISCOVERY_T = f"struct<repository:{REPO_T},discovered_at:string>"
CRAWL_RESULT_T = f"struct<repository:{REPO_T},discovered_at:string,crawled_at:string,seq:bigint>"
EMBED_REQUEST_T = "struct<repository_id:bigint,minio_path:string,download_url:string>"


def _lines(spark: SparkSession, src, max_files: int | None = None) -> DataFrame:
    """One JSON message per row in a ``value`` string column.

    ``src`` is a folder of landed JSON-lines files, or a dict of reader
    options with a ``format`` key, e.g. ``{"format": "kafka",
    "kafka.bootstrap.servers": …, "subscribe": "repos_to_write"}`` (the
    connector must be on the class path); message bytes become text."""
    if isinstance(src, dict):
        opts = dict(src)
        fmt = opts.pop("format")
        r = spark.readStream.format(fmt).options(**opts)
        df = r.load()
        return df.select(F.col("value").cast("string").alias("value"))
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(src)


def _start(writer, checkpoint: str, available_now: bool):
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w


def _batch_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch_id={batch_id}"


def _tables(spark: SparkSession, checkpoint: str, roots: dict[str, str], initial: dict[str, DataFrame], keys: dict[str, tuple[tuple[str, ...], tuple[str, ...]]],
            buckets: int) -> tuple[int, dict[str, DeltaTable]]:
    """The tables a stream keeps, made of ``initial`` where they are not there yet, and the number of its first batch.

    A new stream goes on from the tables' newest batch. The number of its
    first batch is kept in the checkpoint, so a restarted stream, or a batch
    that runs again, writes the same batches."""
    tables = {}
    for name, root in roots.items():
        key, by = keys[name]
        tables[name] = DeltaTable(spark, root, key, by, buckets)
        if tables[name].newest() is None:
            tables[name].create(initial[name])
    kept = f"{checkpoint.rstrip('/')}/first_batch"
    text = storage.read_text(spark, kept)
    if text is None:
        text = str(1 + max(t.newest() for t in tables.values()))
        storage.write_text(spark, kept, text)
    return int(text), tables


# -- T7: view events ------------------------------------------------------------------------

def stream_views(spark: SparkSession, src: str, sink: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """View events → append-only view log (session_id, repository_id,
    viewed_at). History and seen set are read-time operators over the log."""
    m = F.from_json("value", VIEW_EVENT_T)
    rows = (_lines(spark, src).select(m.alias("m"))
            .where(F.col("m.sessionId").isNotNull() & F.col("m.repositoryId").isNotNull())
            .select(F.col("m.sessionId").alias("session_id"), F.col("m.repositoryId").alias("repository_id"),
                    parse_time(F.col("m.viewedAt")).alias("viewed_at")))
    return _start(rows.writeStream.format("parquet"), checkpoint, available_now).start(sink)


# -- T1/T3/T5: typed consume, dead letters, README fan-out ------------------------------------

def stream_ingest(spark: SparkSession, src: str, out_root: str, checkpoint: str, available_now: bool = True,
                  bodies: DataFrame | Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Crawl results → flat repository rows, README bodies, embedding
    requests, and a dead-letter table for lines that do not parse
    (``from_json`` yields a struct of nulls, so validity is tested on the
    repository id).

    ``bodies`` are the landed README texts (repository_id, body): those of
    the batch's repositories with a README are stored as ``readmes``
    (repository_id, object_key, body), and only stored ones are asked to be
    embedded. Without ``bodies`` the texts are stored elsewhere, and every
    repository with a README is asked for."""
    root = out_root.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        # Decoded once, used by three writes (recomputed from the same files
        # if an executor holding it is lost).
        m = batch.select("value", F.from_json("value", CRAWL_RESULT_T).alias("m")).persist()
        ok = F.col("m.repository.id").isNotNull()
        good = m.where(ok).select(*flatten_repository(F.col("m.repository")),
                                  parse_time(F.col("m.crawled_at")).alias("crawled_at"))
        good.write.mode("overwrite").parquet(_batch_path(f"{root}/repositories", batch_id))
        asked = (good.where(F.col("readme_url").isNotNull())
                 .select(F.col("id").alias("repository_id"), object_key(F.col("id")).alias("minio_path"),
                         F.col("readme_url").alias("download_url")))
        if bodies is not None:
            stored = _now(bodies).where(F.col("body").isNotNull()).select("repository_id", "body")
            (asked.join(stored, "repository_id").select("repository_id", F.col("minio_path").alias("object_key"), "body")
             .write.mode("overwrite").parquet(_batch_path(f"{root}/readmes", batch_id)))
            asked = asked.join(stored, "repository_id", "left_semi")
        (asked
         .write.mode("overwrite").parquet(_batch_path(f"{root}/embed_requests", batch_id)))
        (m.where(~ok).select(F.col("value").alias("raw"), F.lit(batch_id).cast("bigint").alias("batch_id"))
         .write.mode("overwrite").parquet(_batch_path(f"{root}/dead_letter", batch_id)))
        m.unpersist()

    return _start(_lines(spark, src).writeStream.foreachBatch(write), checkpoint, available_now).start()


# -- T2: crawl gate ---------------------------------------------------------------------------

def _now(table: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """A stored table as it is now: a callable reads it anew for each batch."""
    return table() if callable(table) else table


def stream_crawl_gate(spark: SparkSession, src: str, repos: DataFrame | Callable[[], DataFrame], sink: str,
                      checkpoint: str, available_now: bool = True, max_files: int | None = None) -> StreamingQuery:
    """Discovery messages → crawl requests for repositories that need a
    crawl, in ``sink/batch_id=<n>``. ``repos`` is read in every batch: give a
    callable to see crawls that are stored while the stream runs."""
    m = F.from_json("value", DISCOVERY_T)

    def write(batch: DataFrame, batch_id: int) -> None:
        d = (batch.select(m.alias("m")).where(F.col("m.repository.id").isNotNull())
             .select(F.col("m.repository.id").alias("repository_id"),
                     F.col("m.repository.full_name").alias("full_name"),
                     parse_time(F.col("m.repository.pushed_at")).alias("pushed_at"),
                     parse_time(F.col("m.discovered_at")).alias("discovered_at")))
        gated = needs_crawl(d, _now(repos)).where("needs_crawl").drop("needs_crawl")
        gated.write.mode("overwrite").parquet(_batch_path(sink, batch_id))

    return _start(_lines(spark, src, max_files).writeStream.foreachBatch(write), checkpoint, available_now).start()


# -- T4: write path -------------------------------------------------------------------------

STATE_FIELDS = ("stargazers_count", "watchers_count", "forks_count", "open_issues_count")
SNAPSHOT_T = ("repository_id long, event_time timestamp_ntz, tie long, stargazers_count long, "
              "watchers_count long, forks_count long, open_issues_count long, pushed_at timestamp_ntz, "
              "score double")
LAST_STATE_T = "stargazers_count long, watchers_count long, forks_count long, open_issues_count long"


def _changed_snapshots(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Per repository: keep a snapshot only when its state differs from the
    previous one (kept or stored); the last state lives in the state store."""
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["event_time", "tie"], kind="stable")
    cur = pdf[list(STATE_FIELDS)].astype("int64").reset_index(drop=True)
    prev = cur.shift(1)
    if state.exists:
        prev.iloc[0] = list(state.get)
    keep = (cur != prev).any(axis=1).to_numpy()  # NaN (no predecessor) compares unequal
    last = tuple(int(x) for x in cur.iloc[-1])
    state.update(last)
    out = pdf.reset_index(drop=True)[keep]
    if len(out):
        yield out[["repository_id", "event_time", "tie", *STATE_FIELDS, "pushed_at", "score"]]


def stream_snapshots(spark: SparkSession, src: str, sink: str, checkpoint: str,
                     available_now: bool = True, max_files: int | None = None,
                     state_partitions: int | None = None) -> StreamingQuery:
    """Crawl results → snapshot rows to append, skipping unchanged states
    across micro-batches (keyed state = last state per repository).

    ``state_partitions`` sets the number of state-store partitions when the
    query first starts (Spark records it in the checkpoint and keeps it for
    the life of the query); by default the session's shuffle partitions.
    """
    m = F.from_json("value", CRAWL_RESULT_T)
    r = F.col("m.repository")
    rows = (_lines(spark, src, max_files).select(m.alias("m")).where(r["id"].isNotNull())
            .select(r["id"].alias("repository_id"), parse_time(F.col("m.crawled_at")).alias("event_time"),
                    F.col("m.seq").alias("tie"),
                    *[r[c].alias(c) for c in STATE_FIELDS],
                    parse_time(r["pushed_at"]).alias("pushed_at"), r["score"].alias("score")))
    out = rows.groupBy("repository_id").applyInPandasWithState(
        _changed_snapshots, SNAPSHOT_T, LAST_STATE_T, "append", GroupStateTimeout.NoTimeout)
    writer = _start(out.writeStream.format("parquet").outputMode("append"), checkpoint, available_now)
    if state_partitions is None:
        return writer.start(sink)
    key = "spark.sql.shuffle.partitions"
    previous = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start(sink)
    finally:
        spark.conf.set(key, previous)


def _snapshot_rows(lines: DataFrame) -> DataFrame:
    m = F.from_json("value", CRAWL_RESULT_T)
    r = F.col("m.repository")
    return (lines.select(m.alias("m")).where(r["id"].isNotNull())
            .select(r["id"].alias("repository_id"), parse_time(F.col("m.crawled_at")).alias("event_time"),
                    F.col("m.seq").alias("tie"), *[r[c].alias(c) for c in STATE_FIELDS],
                    parse_time(r["pushed_at"]).alias("pushed_at"), r["score"].alias("score")))


def stream_snapshots_versioned(spark: SparkSession, src, sink: str, state_root: str, checkpoint: str,
                               available_now: bool = True, max_files: int | None = None,
                               bucket: str = "day", buckets: int = 32) -> StreamingQuery:
    """JVM-only form of ``stream_snapshots``: each micro-batch runs the
    set-based ``snapshots_changed`` against the batch's repositories in a
    latest-state table (one row per repository, kept by deltas); kept rows go
    to ``sink/batch_id=<n>``. No per-key Python, and a batch reads and writes
    only the buckets its repositories fall into."""
    order = ("event_time", "tie")
    empty = spark.createDataFrame([], SNAPSHOT_T)
    first, tables = _tables(spark, checkpoint, {"state": state_root.rstrip("/")}, {"state": empty}, {"state": (("repository_id",), ())}, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _snapshot_rows(batch).persist()
        state, seq = tables["state"], first + batch_id
        kept = snapshots_changed(rows, state.current(rows, before=seq), state_cols=("repository_id", *STATE_FIELDS),
                                 order_cols=order, bucket=bucket)
        kept.write.mode("overwrite").parquet(_batch_path(sink, batch_id))
        state.apply(seq, rows, lambda now, new: latest_stat(now.unionByName(new), order))
        rows.unpersist()

    return _start(_lines(spark, src, max_files).writeStream.foreachBatch(write), checkpoint,
                  available_now).start()


def _crawl_results(batch: DataFrame) -> DataFrame:
    """One micro-batch of crawl results, decoded; lines that are none are left out."""
    return batch.select(F.from_json("value", CRAWL_RESULT_T).alias("m")).where(F.col("m.repository.id").isNotNull())


def _dimension_messages(batch: DataFrame, repo_cols, repo_schema) -> dict[str, DataFrame]:
    """Decode one micro-batch into the incoming rows of every dimension table."""
    return _dimension_rows(_crawl_results(batch), repo_cols, repo_schema)


def _dimension_rows(m: DataFrame, repo_cols, repo_schema) -> dict[str, DataFrame]:
    """The incoming rows of every dimension table from decoded crawl results
    (each with the arrival order ``seq``)."""
    r, seq = F.col("m.repository"), F.col("m.seq").alias("seq")
    flat = m.select(*flatten_repository(r), parse_time(F.col("m.crawled_at")).alias("_crawled_at"), seq)
    repos = flat.select(
        *[F.col("_crawled_at").alias(c) if c == "last_crawled_at"
          else (F.col(c) if c in flat.columns else F.lit(None).cast(repo_schema[c].dataType).alias(c))
          for c in repo_cols], "seq")
    owners = m.select(r["owner"]["id"].alias("id"), r["owner"]["login"].alias("login"),
                      r["owner"]["avatar_url"].alias("avatar_url"), r["owner"]["html_url"].alias("html_url"),
                      r["owner"]["type"].alias("type"), seq).where(F.col("id").isNotNull())
    lic = r["license"]
    licenses = m.select(lic["key"].alias("key"), lic["name"].alias("name"), lic["spdx_id"].alias("spdx_id"),
                        lic["url"].alias("url"), lic["node_id"].alias("node_id"), seq)
    rid = r["id"].alias("repository_id")
    none = F.lit(None).cast("bigint").alias("size")
    bridges = (m.select(rid, F.lit("tag").alias("kind"), F.explode(r["tags"]).alias("name"), none, seq)
               .unionByName(m.select(rid, F.lit("topic").alias("kind"), F.explode(r["topics"]).alias("name"),
                                     none, seq))
               .unionByName(m.select(rid, F.lit("lang").alias("kind"),
                                     F.explode(r["languages"]).alias("name", "size"), seq)))
    return {"repositories": repos, "owners": owners, "licenses": licenses, "bridges": bridges}


#: Rules of the dimension tables, the columns that identify a row, and those that choose its bucket.
DIMENSIONS = {"repositories": (upsert_repositories, ("id",), ()), "owners": (upsert_owners, ("id",), ()), "licenses": (upsert_licenses, ("key",), ()),
              "bridges": (upsert_bridges, ("repository_id", "kind", "name"), ("repository_id", "kind"))}


def stream_dimensions(spark: SparkSession, src: str, initial: dict[str, DataFrame], state_root: str,
                      checkpoint: str, available_now: bool = True,
                      max_files: int | None = None, buckets: int = 32) -> StreamingQuery:
    """Crawl results → upsert of every dimension table (repositories,
    owners, licences, bridges), each kept by deltas in ``<root>/<table>``
    (``latest_version`` reads it). The first batch starts from the stored
    tables, from ``initial`` if there are none. A micro-batch reads and writes
    only the buckets its keys fall into. Bridges are in long form
    (repository_id, kind, name, size)."""
    root = state_root.rstrip("/")
    first, tables = _tables(spark, checkpoint, {t: f"{root}/{t}" for t in DIMENSIONS}, initial, {t: d[1:] for t, d in DIMENSIONS.items()}, buckets)
    repo_cols, repo_schema = initial["repositories"].columns, initial["repositories"].schema

    def write(batch: DataFrame, batch_id: int) -> None:
        results = _crawl_results(batch).persist()  # read and decoded once for four tables
        incoming = _dimension_rows(results, repo_cols, repo_schema)
        for table, (rule, keys, _) in DIMENSIONS.items():
            rows = incoming[table].dropna(subset=list(keys))
            tables[table].apply(first + batch_id, rows, rule)
        results.unpersist()

    return _start(_lines(spark, src, max_files).writeStream.foreachBatch(write), checkpoint,
                  available_now).start()


def stream_repositories(spark: SparkSession, src: str, initial: DataFrame, state_root: str,
                        checkpoint: str, available_now: bool = True,
                        max_files: int | None = None, buckets: int = 32) -> StreamingQuery:
    """Crawl results → repository dimension upsert only, kept by deltas as in
    ``stream_dimensions``."""
    first, tables = _tables(spark, checkpoint, {"repositories": state_root.rstrip("/")}, {"repositories": initial}, {"repositories": (("id",), ())}, buckets)
    cols, schema = initial.columns, initial.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        tables["repositories"].apply(first + batch_id, _dimension_messages(batch, cols, schema)["repositories"], upsert_repositories)

    return _start(_lines(spark, src, max_files).writeStream.foreachBatch(write), checkpoint,
                  available_now).start()


# -- T6: embedding consumer -----------------------------------------------------------------

def stream_embed(spark: SparkSession, src: str, readmes: DataFrame | Callable[[], DataFrame], initial: DataFrame,
                 state_root: str, checkpoint: str, available_now: bool = True,
                 dim: int = 384, buckets: int = 32) -> StreamingQuery:
    """Embedding requests → README text by object key → vector → upsert into
    a vector table kept by deltas. ``readmes`` is read in every batch. A request
    whose text is missing is skipped (it is asked for again by the
    embed-request job); of several requests of a batch for one repository the
    last one's vector stays."""
    first, tables = _tables(spark, checkpoint, {"vectors": state_root.rstrip("/")}, {"vectors": initial}, {"vectors": (("repository_id",), ())}, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        req = (batch.select(F.from_json("value", EMBED_REQUEST_T).alias("m"))
               .where(F.col("m.repository_id").isNotNull())
               .select(F.col("m.repository_id").alias("repository_id"), F.col("m.minio_path").alias("object_key"),
                       F.monotonically_increasing_id().alias("seq")))
        texts = (req.groupBy("repository_id").agg(F.max_by("object_key", "seq").alias("object_key"), F.max("seq").alias("seq"))
                 .join(_now(readmes).select("object_key", "body"), "object_key", "inner"))
        order = texts.select("repository_id", "seq")
        vec = embed_texts(texts, "body", "repository_id", dim).join(order, "repository_id")
        tables["vectors"].apply(first + batch_id, vec, upsert_vectors)

    return _start(_lines(spark, src).writeStream.foreachBatch(write), checkpoint, available_now).start()


def latest_version(spark: SparkSession, state_root: str) -> DataFrame:
    """A stored table as it is now: one kept by deltas, or the newest
    ``v=<n>`` folder of a versioned one. Lists one folder, no files below it."""
    root = state_root.rstrip("/")
    if storage.names(spark, f"{root}/log"):
        return DeltaTable(spark, root).read()
    versions = [int(n[2:]) for n in storage.names(spark, root) if n.startswith("v=")]
    return spark.read.parquet(f"{root}/v={max(versions)}")
