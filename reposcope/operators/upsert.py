"""Table maintenance as pure functions ``(current, incoming) → next``.

Plain Parquet has no MERGE; each upsert returns the next version of a
table, to be written to a new versioned path. Incoming messages carry an
arrival order (``order_cols``); the reference applies them one by one, and
every rule here is rewritten as a few keyed aggregates that give the same
final state — partial aggregation runs map-side, so a key holding a third
of all messages is never gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPO_COMPARED = ("description", "homepage", "license_key", "is_archived", "is_disabled")


def _ord(order_cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order_cols])


def _sequence(current: DataFrame, incoming: DataFrame, cols: Sequence[str],
              order_cols: Sequence[str]) -> DataFrame:
    """Current rows first (``_first`` true, lowest order), then messages."""
    ordt = _ord(order_cols)
    lowest = F.struct(*[F.lit(None).cast(incoming.schema[c].dataType).alias(c) for c in order_cols])
    cur = current.select(*cols, lowest.alias("_o"), F.lit(0).alias("_src"))
    inc = incoming.select(*cols, ordt.alias("_o"), F.lit(1).alias("_src"))
    # (src, order) is the total order: current (src 0) before any message.
    return cur.unionByName(inc).withColumn("_k", F.struct("_src", "_o"))


def upsert_owners(current: DataFrame, incoming: DataFrame,
                  order_cols: Sequence[str] = ("seq",)) -> DataFrame:
    """Insert only: an existing owner never changes; a new one is taken
    from its first message. → current columns"""
    cols = current.columns
    first = (incoming.groupBy("id")
             .agg(F.min_by(F.struct(*[c for c in cols if c != "id"]), _ord(order_cols)).alias("_r"))
             .select("id", "_r.*"))
    new = first.join(current.select("id"), "id", "left_anti")
    return current.unionByName(new.select(*cols))


def _distinct_any(cols: Sequence[str], left: str, right: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | ~F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
    return out


def upsert_licenses(current: DataFrame, incoming: DataFrame,
                    order_cols: Sequence[str] = ("seq",)) -> DataFrame:
    """Skip null keys; a message updates a licence only when name, spdx_id
    or url differ (a node_id-only change is ignored).

    After every message the three compared fields equal the message's, so
    the final fields are the last message's, and the final node_id is the
    one of the first element of the last run of equal fields.
    → key, name, spdx_id, url, node_id
    """
    cmp_cols = ("name", "spdx_id", "url")
    cols = ["key", *cmp_cols, "node_id"]
    seq = _sequence(current.select(*cols), incoming.where(F.col("key").isNotNull()), cols, order_cols)
    last = seq.groupBy("key").agg(F.max_by(F.struct(*cmp_cols), "_k").alias("_t"))
    x = seq.join(last, "key")
    differs = _distinct_any(cmp_cols, "", "_t.")
    start = x.groupBy("key").agg(F.max(F.when(differs, F.col("_k"))).alias("_ks"))
    y = x.join(start, "key")
    in_run = F.col("_ks").isNull() | (F.col("_k") > F.col("_ks"))
    return (y.groupBy("key", "_t")
            .agg(F.min_by("node_id", F.when(in_run, F.col("_k"))).alias("node_id"))
            .select("key", "_t.*", "node_id"))


def upsert_repositories(current: DataFrame, incoming: DataFrame,
                        order_cols: Sequence[str] = ("seq",),
                        compared: Sequence[str] = REPO_COMPARED) -> DataFrame:
    """Insert or update repositories. A message (with ``last_crawled_at`` =
    its crawl time) overwrites every column but ``created_at`` when any
    compared column differs from the stored row OR the stored crawl time is
    older; so a stale message with a changed description still overwrites.

    Exact set form of the sequential rule: the final compared fields are
    the last message's; the other columns come from the earliest element
    holding the maximum crawl time inside the last run of equal compared
    fields; ``created_at`` is the first element's.
    """
    cols = current.columns
    # Rows without a message stay as they are; only the others are folded.
    touched = incoming.select("id").distinct()
    untouched = current.join(touched, "id", "left_anti").select(*cols)
    current = current.join(touched, "id", "left_semi").select(*cols)
    seq = _sequence(current, incoming.select(*cols, *order_cols), cols, order_cols)
    last = seq.groupBy("id").agg(F.max_by(F.struct(*compared), "_k").alias("_t"))
    x = seq.join(last, "id")
    start = x.groupBy("id").agg(F.max(F.when(_distinct_any(compared, "", "_t."), F.col("_k"))).alias("_ks"))
    y = x.join(start, "id")
    in_run = F.col("_ks").isNull() | (F.col("_k") > F.col("_ks"))
    lca = F.coalesce(F.unix_micros(F.col("last_crawled_at").cast("timestamp")), F.lit(-(2 ** 62)))
    pick_key = F.when(in_run, F.struct((-lca).alias("a"), F.col("_k").alias("b")))
    run_order = F.when(in_run, F.col("_k"))
    rest = [c for c in cols if c not in ("id", "created_at")]
    out = y.groupBy("id").agg(
        F.min_by(F.struct(*rest), pick_key).alias("_r"),
        # ``stored < incoming`` is never true once the stored time is NULL:
        # then the run's first element stays.
        F.min_by(F.struct(*rest), run_order).alias("_first"),
        F.min_by(F.col("last_crawled_at").isNull(), run_order).alias("_first_null"),
        F.min_by("created_at", "_k").alias("created_at"))
    chosen = F.when(F.col("_first_null"), F.col("_first")).otherwise(F.col("_r"))
    folded = out.select("id", chosen.alias("_c"), "created_at").select("id", "_c.*", "created_at").select(*cols)
    return folded.unionByName(untouched)


def upsert_bridges(current: DataFrame, incoming: DataFrame,
                   order_cols: Sequence[str] = ("seq",)) -> DataFrame:
    """Bridge rows (repository_id, kind, name, size): insert if absent, never
    delete; a size (languages) is overwritten by the last message.
    → repository_id, kind, name, size"""
    cols = ["repository_id", "kind", "name", "size"]
    seq = _sequence(current.select(*cols), incoming, cols, order_cols)
    return (seq.groupBy("repository_id", "kind", "name")
            .agg(F.max_by("size", "_k").alias("size")))


def upsert_vectors(current: DataFrame, incoming: DataFrame,
                   order_cols: Sequence[str] = ("seq",)) -> DataFrame:
    """Replace by id, last write wins. → repository_id, embedding"""
    cols = ["repository_id", "embedding"]
    seq = _sequence(current.select(*cols), incoming, cols, order_cols)
    return seq.groupBy("repository_id").agg(F.max_by("embedding", "_k").alias("embedding"))
