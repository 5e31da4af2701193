"""Session set-up and shared-storage helpers.

Cluster settings always win: ``get_session`` only fills in keys that are
unset, so the same code runs in a local test and on a large cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Defaults that matter for every operator in the package.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Let AQE size shuffle partitions from the data instead of a fixed count.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # Remove checkpointed frames (global ranks) once they are unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Keyed streaming state (last snapshot state per repository) off-heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "reposcope") -> SparkSession:
    """Return the active session or build one with package defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    active = SparkSession.getActiveSession()
    settled = SparkConf()
    known = {k for k, _ in settled.getAll()}
    if active is not None:
        known |= {k for k, _ in active.sparkContext.getConf().getAll()} | set(active.conf.getAll)
    for key, value in _DEFAULTS.items():
        if key not in known:
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    """Apply runtime SQL defaults the operators rely on (UTC clock)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


_LOCAL_ROOTS: dict[int, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and job state.

    On a cluster ``spark.checkpoint.dir`` names a shared file system path and
    is used as is. Only when it is unset and the master is local (tests) is a
    scratch folder chosen, once per SparkContext (the setting itself cannot
    be changed at run time), and registered as the context's checkpoint
    directory. On any other master the setting is required.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = _LOCAL_ROOTS.get(id(sc))
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.environ.get("REPOSCOPE_SCRATCH") or tempfile.gettempdir()
        root = os.path.join(base, f"reposcope-ckpt-{uuid.uuid4().hex[:8]}")
        _LOCAL_ROOTS[id(sc)] = root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several branches of a plan read to shared scratch
    storage, and read it back: computed once, and nothing to recompute after
    a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
