"""Readers and writers for the engine's stored tables.

Tables are Parquet directories. Snapshots are partitioned by month and
sorted by (repository_id, event_time) inside each file, which gives
partition pruning on month and tight row-group statistics on the id.
Versioned tables (the result of an upsert) go to a new ``v=<n>``
directory; a path is never overwritten while it is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.operators.snapshots import STATE_COLS, dedupe_global, state_hash, with_event_month
from reposcope.sources.ingest import key_to_id


def append_snapshots(stats: DataFrame, path: str) -> None:
    """Append snapshot rows (with ``row_hash``) partitioned by ``event_month``.

    Rows are dealt by ranges of (month, repository), sized from the data: the
    current month is spread over as many tasks as its share of the rows."""
    out = with_event_month(state_hash(stats))
    (out.repartitionByRange("event_month", "repository_id")
     .sortWithinPartitions("event_month", "repository_id", "event_time")
     .write.mode("append").partitionBy("event_month").parquet(path))


def rewrite_deduped(stats: DataFrame, path: str, state_cols=STATE_COLS,
                    order_cols=("event_time",)) -> None:
    """One-off rewrite of a snapshot table keeping the first row of every
    state, into a NEW path (the source stays readable until swapped)."""
    append_snapshots(dedupe_global(stats, state_cols, order_cols), path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write ``df`` as version ``version`` of a versioned table."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_readmes(spark: SparkSession, path: str) -> DataFrame:
    """README bodies stored one file per repository as ``readmes/<id>.md``
    under ``path``. Bytes that are not UTF-8 become U+FFFD.
    → repository_id, object_key, body (whole text)"""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.md")
             .option("recursiveFileLookup", "true").load(path))
    key = F.regexp_extract("path", r"(readmes/\d+\.md)$", 1)
    return files.select(key_to_id(key).alias("repository_id"), key.alias("object_key"),
                        F.make_valid_utf8(F.col("content").cast("string")).alias("body"))


def publish_messages(df: DataFrame, writer_format: str = "text", **options) -> None:
    """Rows as JSON messages, one per row, appended to a message sink:
    JSON-lines files (``path=…``) or a broker (its connector's options)."""
    messages = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    messages.write.format(writer_format).mode("append").options(**options).save()
