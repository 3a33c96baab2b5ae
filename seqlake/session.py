"""Session construction and shared-folder helpers.

Everything that has to be written between stages (pinned block layouts,
stream sources, sinks, checkpoints) goes below ``spark.checkpoint.dir``:
on a cluster that is the shared folder the cluster names; we only pick a
folder ourselves when the session has none (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, cores: int | None = None,
                  shuffle_partitions: int | None = None,
                  app_name: str = "seqlake") -> SparkSession:
    """Local or cluster session with the settings every job here assumes."""
    builder = SparkSession.builder.appName(app_name)
    # the launcher's master and cluster settings stand unless the caller asks for others
    master = master or (f"local[{cores}]" if cores else os.environ.get("SEQLAKE_MASTER"))
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        # regrouping exploded sequences (collect_list per sequence) stays hash-based
        # up to this many sequences per task, then falls back to sort-based
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
        # unreferenced pinned blocks are deleted
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # keyed state for the streaming operators (applyInPandasWithState)
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if shuffle_partitions or cores:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cores)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("SEQLAKE_DRIVER_MEMORY", "16g")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current and not sc.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="seqlake-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    if not (hasattr(sc, "getCheckpointDir") and sc.getCheckpointDir()):
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder, unique per call."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def landed(df: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back.

    Cuts the lineage, survives lost executors, and gives Spark the table's true
    size for its choice of join.  ``compact`` lets Spark merge the small
    partitions that a selective filter leaves before they become files.
    """
    path = scratch_dir(df.sparkSession, label)
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows per Arrow batch handed to Python: bounds a worker's memory with long texts.
ROWS_PER_BATCH = 512


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Lower the session's Arrow batch length to ``rows`` (never raises it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
