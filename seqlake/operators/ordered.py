"""Order-dependent primitives that scale past one task.

A global position or a running sum is inherently sequential; the usual
``Window.orderBy(...)`` without a partition key moves every row into one task,
and ``Window.partitionBy(key)`` moves a hot key into one task.  Both are avoided
here with the same three steps:

1. ``repartitionByRange`` on the full order, then ``checkpoint()`` — range bounds
   are sampled, so a recomputed plan could move rows between blocks; the
   reliable checkpoint pins the block layout (and survives executor loss).
2. Work inside each block (row index, or running sum per key).
3. A per-block summary with one row per block (a size bound we know: the
   number of blocks) is collected, composed in block order on the driver, and
   broadcast back as the carry each block starts from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.session import ensure_checkpoint_dir

BLOCK = "_blk"
_LOCAL_MASK = (1 << 33) - 1  # monotonically_increasing_id = partition << 33 | row


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def default_blocks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def pin_blocks(df: DataFrame, order_cols, n_blocks: int | None = None,
               bucket: Column | None = None, then=None) -> DataFrame:
    """Put rows in blocks that are contiguous ranges of ``order_cols``, sorted
    inside, with the block id in ``_blk``, and checkpoint.

    Without ``bucket`` the blocks come from ``repartitionByRange`` (one block per
    partition; bounds are sampled, hence the checkpoint).  With ``bucket`` — a
    deterministic, non-decreasing function of the order into ``0..n-1``, e.g. a
    prefix of a uniform hash — no sampling pass is needed, and the block id is the
    partition.  ``then`` (DataFrame ->
    DataFrame) is applied before the checkpoint, so per-block work that needs its
    own exchange is materialised in the same job; the block id is a column by then.
    """
    ensure_checkpoint_dir(df.sparkSession)
    oc = _cols(order_cols)
    if bucket is None:
        # without an explicit count AQE sizes the blocks to the data (coalesced
        # range partitions stay contiguous and ordered); the checkpoint pins them
        ranged = df.repartitionByRange(n_blocks, *oc) if n_blocks else df.repartitionByRange(*oc)
        ranged = ranged.sortWithinPartitions(*oc).withColumn(BLOCK, F.spark_partition_id())
    else:
        n = n_blocks or default_blocks(df)
        ranged = (df.withColumn(BLOCK, bucket.cast("int"))
                    .repartitionById(n, F.col(BLOCK))
                    .sortWithinPartitions(BLOCK, *oc))
    if then is not None:
        ranged = then(ranged)
    return ranged.checkpoint(eager=True)


def hex_bucket(hex_key: Column, n: int) -> Column:
    """Monotone bucket ``0..n-1`` of a uniform lowercase-hex key (first 8 digits); NULL, first in order, is in bucket 0."""
    return F.coalesce(F.floor(F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("bigint") * F.lit(n) / F.lit(1 << 32)), F.lit(0))


def _small_table(spark, rows, schema) -> DataFrame:
    # one row per block: the size bound is the block count, so a broadcast is safe
    return F.broadcast(spark.createDataFrame(rows, schema))


def dense_index(df: DataFrame, order_cols, name: str = "idx",
                n_blocks: int | None = None) -> DataFrame:
    """0-based global position in ``order_cols`` order (which must be a total order).

    No single-partition window: the in-block position comes from the pinned
    partition's row order, the block offset from a broadcast prefix sum.
    """
    pinned = pin_blocks(df, order_cols, n_blocks)
    local = pinned.withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK)))
    counts = sorted((r[0], r[1]) for r in pinned.groupBy(BLOCK).count().collect())
    offsets, acc = [], 0
    for blk, n in counts:
        offsets.append((blk, acc))
        acc += n
    spark = df.sparkSession
    off = _small_table(spark, offsets or [(0, 0)], f"{BLOCK} int, _off long")
    out = (local.join(off, BLOCK, "left")
                .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
                .drop("_off", "_local", BLOCK))
    return out


def _sum2(a, b):
    if a is None:
        return b
    return a if b is None else a + b


def _max2(a, b):
    if a is None:
        return b
    return a if b is None else max(a, b)


def running_sum(df: DataFrame, values, order_cols, partition_cols=(), name: str = "cum",
                n_blocks: int | None = None, how: str = "sum") -> DataFrame:
    """Inclusive running sums per ``partition_cols`` in ``order_cols`` order.

    ``values`` is one column (result in ``name``) or a dict ``{out_name: column}``.
    Equivalent to ``sum(v).over(partitionBy(p).orderBy(o).rowsBetween(unbounded, 0))``
    but a key holding a third of all rows is spread over many range blocks: each
    block sums its own piece (one balanced exchange on (block, key)); only the
    first key of a block can continue from earlier blocks, so the carry table
    has one row per block.  ``how="max"`` gives a running maximum instead (the
    carry is combined with ``greatest``); NULL values are skipped.
    """
    if how not in ("sum", "max"):
        raise ValueError(f"unknown running aggregate {how!r}")
    agg = F.sum if how == "sum" else F.max
    vals = dict(values) if isinstance(values, dict) else {name: values}
    vals = {k: (F.col(v) if isinstance(v, str) else v) for k, v in vals.items()}
    names = list(vals)
    pc, oc = list(partition_cols), list(order_cols)
    work = df
    for i, k in enumerate(names):
        work = work.withColumn(f"_v{i}", vals[k])
    w = Window.partitionBy(BLOCK, *_cols(pc)).orderBy(*_cols(oc)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)

    def in_block(ranged: DataFrame) -> DataFrame:
        for i in range(len(names)):
            ranged = ranged.withColumn(f"_c{i}", agg(f"_v{i}").over(w))
        return ranged
    # in-block running values are computed once, inside the pinning job
    inblock = pin_blocks(work, [*pc, *oc], n_blocks, then=in_block)
    spark = df.sparkSession
    key = F.struct(*_cols(pc)) if pc else F.lit(0)
    order_key = F.struct(key.alias("k"), F.struct(*_cols(oc)).alias("o"))
    summary = (inblock.groupBy(BLOCK)
               .agg(F.min_by(key, order_key).alias("first_key"),
                    F.max_by(key, order_key).alias("last_key"),
                    *[F.max_by(F.col(f"_c{i}"), order_key).alias(f"last{i}") for i in range(len(names))])
               .collect())  # one row per block
    summary.sort(key=lambda r: r[BLOCK])
    join2 = _sum2 if how == "sum" else _max2
    tab_rows = []
    prev_key, prev_tot = None, None
    for r in summary:
        fk, lk = r["first_key"], r["last_key"]
        same_prev = prev_key is not None and fk == prev_key
        # NULL until a value was seen, as in a window aggregate
        carry = [prev_tot[i] if same_prev else None for i in range(len(names))]
        prev_tot = [join2(r[f"last{i}"], carry[i] if lk == fk else None) for i in range(len(names))]
        tab_rows.append((r[BLOCK], *carry, *(tuple(fk) if pc else ())))
        prev_key = lk
    schema = [f"{BLOCK} int"] + [
        f"_k{i} {inblock.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(names))] + [
        f"_fk{i} {inblock.schema[c].dataType.simpleString()}" for i, c in enumerate(pc)]
    if not tab_rows:
        tab_rows = [tuple([0] + [None] * (len(names) + len(pc)))]
    tab = _small_table(spark, tab_rows, ", ".join(schema))
    match = F.lit(True)
    for i, c in enumerate(pc):
        match = match & F.col(c).eqNullSafe(F.col(f"_fk{i}"))
    out = inblock.join(tab, BLOCK, "left")
    for i, k in enumerate(names):
        t = inblock.schema[f"_c{i}"].dataType
        if how == "sum":
            carried = F.when(match, F.col(f"_k{i}"))
            out = out.withColumn(k, F.when(carried.isNull(), F.col(f"_c{i}")).otherwise(
                F.coalesce(F.col(f"_c{i}"), F.lit(0).cast(t)) + carried).cast(t))
        else:
            out = out.withColumn(k, F.greatest(F.col(f"_c{i}"), F.when(match, F.col(f"_k{i}"))))
    drop = [BLOCK] + [f"_{p}{i}" for p in "vck" for i in range(len(names))] + [f"_fk{i}" for i in range(len(pc))]
    return out.drop(*drop)
