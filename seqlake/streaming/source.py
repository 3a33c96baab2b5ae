"""Streaming sources and sinks: file slices in arrival order, the corpus stream
(A5 / J1), routed multi-sink (J2) and the running funnel (J6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The state store with column families, which ``transformWithState`` needs.
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a landed slice per file, at least.
ROWS_PER_FILE = 100_000


def slice_files(spark: SparkSession, rows: int) -> int:
    """Files that a landed slice of ``rows`` rows is written as: one a core, fewer if it is short."""
    return max(1, min(spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE))


def land_slice(df: DataFrame, path: str, n_files: int) -> None:
    """Append ``df`` as exactly ``n_files`` files, so that a stream that takes ``n_files`` a batch takes what landed together."""
    spark = df.sparkSession
    if n_files == 1:
        df.coalesce(1).write.mode("append").parquet(path)
        return
    def listed():
        return len(spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(path).inputFiles())
    # the folder is there, if with an empty file, before its files are counted
    spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    before = listed()
    df.repartition(n_files - 1).write.mode("append").parquet(path)
    for _ in range(before + n_files - 1 - listed()):          # a task without rows writes no file
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)


def land_in_order(df: DataFrame, path: str, order_col: str, n_slices: int = 3) -> int:
    """Test fixture: write ``df`` as ``n_slices`` time-ordered slices, one after
    another, so the file source sees them arrive in event-time order (the
    order-dependent state operators need that; see README).  Returns the number
    of files in a slice: a stream has to take so many a batch."""
    lo, hi, rows = df.agg(F.min(order_col), F.max(order_col), F.count(order_col)).first()
    step = (hi - lo) / n_slices
    n_files = slice_files(df.sparkSession, rows // n_slices)
    for i in range(n_slices):
        a = lo + step * i
        cond = (F.col(order_col) >= F.lit(a)) if i else F.lit(True)
        if i < n_slices - 1:
            cond = cond & (F.col(order_col) < F.lit(lo + step * (i + 1)))
        land_slice(df.where(cond), path, n_files)
    return n_files


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A5 / J1 source: new Parquet files become micro-batches as they land;
    ``maxFilesPerTrigger`` is the back-pressure bound (the reference's queue)."""
    return (spark.readStream.schema(schema)
                 .option("maxFilesPerTrigger", files_per_trigger)
                 .parquet(path))


def stream_listing(spark: SparkSession, path: str, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """The files landing under ``path`` themselves as a stream: ``path, length, modificationTime``, one row per file.

    Their content is not read, so a file that no reader can open is a row like any other."""
    return (spark.readStream.format("binaryFile")
                 .schema("path string, modificationTime timestamp, length long, content binary")
                 .option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime"))


def run_available(query_builder, checkpoint: str, timeout_s: int | None = None, state_partitions: int | None = None):
    """Start with ``trigger(availableNow=True)`` and wait for the backlog to drain
    (without limit, unless ``timeout_s`` is given).

    ``state_partitions`` fixes the number of state-store partitions of a new
    stateful query (a stream copies the session settings when it starts and
    keeps the number in its checkpoint), independent of the batch setting; such
    a query runs on the state store that ``transformWithState`` needs."""
    spark = SparkSession.getActiveSession()
    old = {}
    if state_partitions is not None and spark is not None:
        for name, value in (("spark.sql.shuffle.partitions", str(state_partitions)), (STORE_CONF, STATE_STORE)):
            old[name] = spark.conf.get(name, None)
            spark.conf.set(name, value)
    try:
        q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    q.awaitTermination(timeout_s) if timeout_s is not None else q.awaitTermination()
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()
    return q


def stream_corpus(stream: DataFrame, keep: Column, project, out_path: str, checkpoint: str,
                  timeout_s: int | None = None) -> None:
    """Filter and project each arriving file, append to Parquet; the
    checkpoint replaces the reference's skip-if-done bookkeeping (A4)."""
    out = stream.where(keep).select(*project)
    run_available(out.writeStream.format("parquet").option("path", out_path).outputMode("append"),
                  checkpoint, timeout_s)


def route_stream(stream: DataFrame, type_col: str, mapping: dict, out_path: str, checkpoint: str,
                 timeout_s: int | None = None) -> None:
    """One parsed stream, one folder per route (``foreachBatch``).  Each batch
    writes ``route=<r>/batch=<id>`` with overwrite, so a replayed batch is idempotent."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        # one pass over the batch; a replayed batch overwrites its own folders only
        names = [F.when(F.col(type_col) == src, F.lit(route)) for src, route in mapping.items()]
        routed = batch.withColumn("route", F.coalesce(*names)).where(F.col("route").isNotNull())
        (routed.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
               .option("partitionOverwriteMode", "dynamic").partitionBy("route", "batch").parquet(out_path))
    run_available(stream.writeStream.foreachBatch(sink), checkpoint, timeout_s)


def live_funnel(stream: DataFrame, stem: str, passed: Column, kept: Column, out_path: str,
                checkpoint: str, timeout_s: int | None = None) -> None:
    """Running per-source totals while the corpus streams (complete mode,
    each batch overwrites the small result table)."""
    agg = stream.groupBy(stem).agg(F.count("*").alias("n_rows"), F.count_if(passed).alias("n_passed"),
                                   F.count_if(passed & kept).alias("n_kept"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)
    run_available(agg.writeStream.outputMode("complete").foreachBatch(sink), checkpoint, timeout_s)
