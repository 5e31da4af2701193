"""Keyed tables that change by batches: hash buckets, deltas, merge on read.

A table is a folder on shared storage:

* ``base/gen=<g>/bucket=<b>``: whole rows, a bucket at a time;
* ``delta/seq=<n>/bucket=<b>``: the rows that batch n added or changed, in the
  buckets they belong to and no others;
* ``log/<n>.json``: what the table consists of after batch n, written last and
  in one step, so that a reader sees a batch whole or not at all.

A batch reads the buckets its keys fall into, applies an upsert rule to the
stored rows of those keys, and writes what differs. Readers take the newest
delta row of a key, else its base row; buckets without deltas are read as they
are. After ``fold_after`` batches with changes the buckets that have deltas
are rewritten as a new generation, the others stay. Files that none of the
last ``keep`` states needs are removed. A batch that runs again after a crash
starts from the state before it and overwrites its own files only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposcope.sources import storage as ST

def _nullable(kind):
    """The JSON form of a type with everything nullable, as files give it."""
    if isinstance(kind, dict):
        return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else _nullable(v) for k, v in kind.items()}
    return [_nullable(v) for v in kind] if isinstance(kind, list) else kind


Rule = Callable[[DataFrame, DataFrame], DataFrame]


class DeltaTable:
    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = (), by: Sequence[str] = (), buckets: int = 32,
                 fold_after: int = 8, keep: int = 3):
        """``keys`` identify a row, ``by`` (some of them, all by default) choose its bucket. A table that exists keeps the settings it was made with."""
        self.spark, self.root = spark, root.rstrip("/")
        newest = self.newest()
        made = self._state(newest) if newest is not None else {}
        self.keys = list(made.get("keys", keys))
        self.by = list(made.get("by", by or keys))
        self.buckets = int(made.get("buckets", buckets))
        self.fold_after, self.keep = fold_after, max(2, keep)

    # -- states -----------------------------------------------------------------------------

    def newest(self, before: int | None = None) -> int | None:
        """The last batch (before ``before``) that is in the table; None if there is no table yet. Reads one listing of the log."""
        found = [int(n[:-5]) for n in ST.names(self.spark, f"{self.root}/log") if n.endswith(".json")]
        return max((n for n in found if before is None or n < before), default=None)

    def _state(self, seq: int | None) -> dict:
        text = ST.read_text(self.spark, f"{self.root}/log/{seq:012d}.json") if seq is not None else None
        if text is None:
            raise ValueError(f"no table in {self.root}")
        return json.loads(text)

    def _commit(self, seq: int, state: dict) -> None:
        ST.write_text(self.spark, f"{self.root}/log/{seq:012d}.json", json.dumps(state))

    # -- files ------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> list[int]:
        """Rows by buckets, replacing the folder; the buckets that got some. Partitions are sized from the data, a large bucket is written by several tasks."""
        path = f"{self.root}/{folder}"
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return [int(n.split("=")[1]) for n in ST.names(self.spark, path) if n.startswith("bucket=")]

    def _load(self, state: dict, kind: str, places: list[tuple[int, int]]) -> DataFrame | None:
        name = {"base": "gen", "delta": "seq"}[kind]
        if not places:
            return None
        fields = [*T.StructType.fromJson(state["schema"]).fields, T.StructField(name, T.LongType()), T.StructField("bucket", T.IntegerType())]
        held: dict[int, list[int]] = {}
        for n, b in places:
            held.setdefault(n, []).append(b)
        read = self.spark.read.schema(T.StructType(fields)).option("basePath", f"{self.root}/{kind}")
        rows = read.parquet(*[f"{self.root}/{kind}/{name}={n}" for n in held])
        wanted = F.lit(False)  # on partition columns: files of other buckets are not read
        for n, own in held.items():
            wanted = wanted | ((F.col(name) == n) & F.col("bucket").isin(own))
        return rows.where(wanted).withColumnRenamed(name, f"_{name}").drop("bucket")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into: ``buckets`` numbers at most."""
        return [r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()]

    # -- reading ----------------------------------------------------------------------------

    def read(self, seq: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table after batch ``seq`` (the newest by default), or those buckets of it."""
        return self._merged(self._state(self.newest() if seq is None else seq), buckets)

    def _merged(self, state: dict, buckets: Sequence[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        wanted = set(range(self.buckets) if buckets is None else buckets)
        deltas = [(n, b) for n, held in state["deltas"] for b in held if b in wanted]
        changed = {b for _, b in deltas}
        base = [(g, int(b)) for b, g in state["base"].items() if int(b) in wanted]
        quiet = self._load(state, "base", [(g, b) for g, b in base if b not in changed])
        under = self._load(state, "base", [(g, b) for g, b in base if b in changed])
        over = self._load(state, "delta", deltas)
        parts = [] if quiet is None else [quiet.select(*schema.names)]
        if over is not None:
            rows = F.struct(*schema.names)
            newest = over.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(F.max_by(rows, "_seq").alias("_r"))
            parts.append(newest.select("_r.*"))
            if under is not None:
                parts.append(under.join(newest, self._same(newest), "left_anti").select(*schema.names))
        out = self.spark.createDataFrame([], schema) if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _same(self, other: DataFrame) -> Column:
        """Equal keys, null like null, against ``_k0`` … of another frame."""
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return same

    def current(self, incoming: DataFrame, before: int | None = None) -> DataFrame:
        """The stored rows of the keys of ``incoming``: only the buckets these fall into are read."""
        return self._current(self._state(self.newest(before)), incoming)

    def _current(self, state: dict, incoming: DataFrame) -> DataFrame:
        keys = incoming.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).distinct()
        return self._merged(state, self.buckets_of(incoming)).join(keys, self._same(keys), "left_semi")

    # -- changing ---------------------------------------------------------------------------

    def create(self, rows: DataFrame, seq: int = 0) -> None:
        """Make the table of ``rows`` (one for each key), as state ``seq``."""
        held = self._write(rows, f"base/gen={seq}")
        self._commit(seq, {"schema": _nullable(rows.schema.jsonValue()), "keys": self.keys, "by": self.by, "buckets": self.buckets,
                           "base": {str(b): seq for b in held}, "deltas": []})

    def apply(self, seq: int, incoming: DataFrame, rule: Rule) -> list[int]:
        """Batch ``seq``: ``rule(stored rows of the keys, incoming)`` gives the keys' next rows; those that differ are written.

        Returns the buckets written. Keys that the rule does not return stay
        as they are; nothing is deleted.
        """
        state = self._state(self.newest(before=seq))
        schema = T.StructType.fromJson(state["schema"])
        # Rules read both sides several times. What a lost executor held is computed again from the same files.
        incoming = incoming.persist()
        now = self._current(state, incoming).select(*schema.names).persist()
        nxt = rule(now, incoming).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        held = self._write(nxt.exceptAll(now), f"delta/seq={seq}")
        now.unpersist()
        incoming.unpersist()
        state["deltas"] = [*state["deltas"], *([[seq, held]] if held else [])]
        if len(state["deltas"]) >= self.fold_after:
            state = self._folded(state, seq)
        self._commit(seq, state)
        self._vacuum(seq)
        return held

    def _folded(self, state: dict, seq: int) -> dict:
        """The buckets with deltas as a new generation of the base."""
        changed = sorted({b for _, held in state["deltas"] for b in held})
        held = self._write(self._merged(state, changed), f"base/gen={seq}")
        base = {b: g for b, g in state["base"].items() if int(b) not in changed} | {str(b): seq for b in held}
        return {**state, "base": base, "deltas": []}

    def _vacuum(self, seq: int) -> None:
        """Remove what no state of the last ``keep`` needs. Lists folder names only."""
        logs = [n for n in ST.names(self.spark, f"{self.root}/log") if n.endswith(".json") and int(n[:-5]) <= seq]
        for old in logs[:-self.keep]:
            ST.remove(self.spark, f"{self.root}/log/{old}")
        states = [self._state(int(n[:-5])) for n in logs[-self.keep:]]
        gens = {(int(g), int(b)) for s in states for b, g in s["base"].items()}
        seqs = {n for s in states for n, _ in s["deltas"]}
        for name in ST.names(self.spark, f"{self.root}/delta"):
            n = int(name.split("=")[1])
            if n < seq and n not in seqs:
                ST.remove(self.spark, f"{self.root}/delta/{name}")
        for name in ST.names(self.spark, f"{self.root}/base"):
            g = int(name.split("=")[1])
            if not any(g == used for used, _ in gens) and g < seq:
                ST.remove(self.spark, f"{self.root}/base/{name}")
                continue
            for part in ST.names(self.spark, f"{self.root}/base/{name}"):
                if part.startswith("bucket=") and (g, int(part.split("=")[1])) not in gens:
                    ST.remove(self.spark, f"{self.root}/base/{name}/{part}")
