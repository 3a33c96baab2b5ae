"""Seeded orders, splits, rank sharding and batching.

Every permutation is ``md5(seed:…:id)`` order, so a retry, a recomputation and
the SQL oracle agree.  Global positions come from ``dense_index`` (range blocks,
no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.keys import hash_key, xxhash_key
from seqlake.operators.ordered import dense_index

HIST_DIGITS = 3  # 16^3 = 4,096 prefix buckets for the exact split


#: How the sort key of a permutation is made: ``md5`` can be repeated in SQL anywhere, ``xxhash64`` is 8 bytes in place
#: of 32 on their way through the sort.  Either is a pure function of seed and id.
KEYS = {"md5": hash_key, "xxhash64": xxhash_key}


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, name: str = "perm_idx",
                   n_blocks: int | None = None, key: str = "md5") -> DataFrame:
    """global position in ``md5(seed:id)`` order, or in that of another of ``KEYS`` (ties by id)."""
    keyed = df.withColumn("_key", KEYS[key](seed, id_col))
    return dense_index(keyed, [F.col("_key"), F.col(id_col)], name, n_blocks).drop("_key")


def epoch_shuffle(df: DataFrame, id_col: str, seed: int, epoch: int, name: str = "perm_idx",
                  n_blocks: int | None = None, key: str = "md5") -> DataFrame:
    """a new permutation per epoch, identical on every rank."""
    keyed = df.withColumn("_key", KEYS[key](seed, epoch, id_col))
    return dense_index(keyed, [F.col("_key"), F.col(id_col)], name, n_blocks).drop("_key")


def random_split(df: DataFrame, id_col: str, frac: float = 0.05, seed: int = 42,
                 small: str = "val", large: str = "train") -> DataFrame:
    """Exactly ``floor(n * frac)`` rows (first in seeded order) go to ``small``.

    No global sort: a 4,096-bucket histogram of the key's first hex digits
    (one small aggregate) locates the bucket holding the cut; only the rows of
    that bucket are ranked.
    """
    keyed = df.withColumn("_key", hash_key(seed, id_col)) \
              .withColumn("_b", F.substring("_key", 1, HIST_DIGITS))
    hist = sorted((r[0], r[1]) for r in keyed.groupBy("_b").count().collect())  # <= 4,096 rows
    n = sum(c for _, c in hist)
    n_small = int(n * frac)
    acc, cut_bucket, before = 0, None, 0
    for b, c in hist:
        if acc + c > n_small:
            cut_bucket, before = b, acc
            break
        acc += c
    if cut_bucket is None:  # everything is small
        return keyed.withColumn("split", F.lit(small)).drop("_key", "_b")
    inside = keyed.where(F.col("_b") == cut_bucket)
    ranked = dense_index(inside.select(id_col, "_key"), [F.col("_key"), F.col(id_col)], "_r")
    chosen = ranked.where(F.col("_r") < n_small - before).select(id_col).withColumn("_in", F.lit(True))
    out = keyed.join(chosen, id_col, "left")
    split = (F.when(F.col("_b") < cut_bucket, F.lit(small))
              .when(F.col("_b") > cut_bucket, F.lit(large))
              .when(F.col("_in"), F.lit(small)).otherwise(F.lit(large)))
    return out.withColumn("split", split).drop("_key", "_b", "_in")


def date_split(df: DataFrame, date_col: str, fractions=(("train", 0.95), ("val", 0.025), ("test", 0.025))) -> DataFrame:
    """Whole days go to train / validation / test by the cumulative share of
    rows in earlier days (a day is never divided).  The per-day histogram is
    bounded by the number of calendar days and broadcast back.  A row without a
    date keeps a NULL split and counts in no share."""
    day = F.to_date(F.col(date_col))
    hist = df.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    # one row per calendar day: a bounded table, so ordering it in one task is fine
    w = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    tot = Window.partitionBy(F.lit(1))
    hist = hist.where(F.col("_day").isNotNull())
    share = hist.withColumn("_share", F.coalesce(F.sum("_n").over(w), F.lit(0)) / F.sum("_n").over(tot))
    acc, cond = 0.0, None
    for name, frac in fractions:
        acc += frac
        cond = (F.when(F.col("_share") < F.lit(acc), F.lit(name)) if cond is None
                else cond.when(F.col("_share") < F.lit(acc), F.lit(name)))
    share = share.withColumn("split", cond.otherwise(F.lit(fractions[-1][0]))).select("_day", "split")
    return df.join(F.broadcast(share), day == F.col("_day"), "left").drop("_day")


def shard_ranks(ordered: DataFrame, idx_col: str, world: int, pad: bool = True) -> DataFrame:
    """Strided sharding ``rank = p mod world`` of the positions ``p`` of an
    ordered table; with ``pad`` the first indices are repeated so every rank has
    ``ceil(n / world)`` rows (the public DistributedSampler behaviour)."""
    n = ordered.count()
    per_rank = -(-n // world) if pad else n // world
    extra = per_rank * world - n if pad else 0
    rows = ordered.withColumn("p", F.col(idx_col))
    if not pad:
        rows = rows.where(F.col("p") < per_rank * world)
    if extra > 0 and n:
        # fewer than ``world`` positions, each the copy of index ``p mod n``: a short table may repeat several times
        more = ordered.sparkSession.range(n, n + extra).select(
            F.col("id").alias("p"), (F.col("id") % n).cast(ordered.schema[idx_col].dataType).alias(idx_col))
        rows = rows.unionByName(ordered.join(F.broadcast(more), idx_col).select(*ordered.columns, "p"))
    return (rows.withColumn("rank", F.pmod(F.col("p"), F.lit(world)).cast("int"))
                .withColumn("pos_in_rank", F.floor(F.col("p") / world).cast("bigint")))


def batch(ranked: DataFrame, size: int, drop_last: bool, per_rank: int | None = None) -> DataFrame:
    """I8: consecutive batches of ``size`` inside a rank; ``drop_last`` drops the
    short final batch (all ranks have equal length after padding)."""
    out = ranked.withColumn("batch_id", F.floor(F.col("pos_in_rank") / size).cast("bigint"))
    if drop_last:
        if per_rank is None:
            per_rank = ranked.groupBy("rank").count().agg(F.min("count")).first()[0] or 0
        out = out.where(F.col("pos_in_rank") < (per_rank // size) * size)
    return out


def optimizer_steps(batches_per_rank: int, epochs: int, accum: int, fast_path: bool = False) -> int:
    """Optimiser steps as counted by the baseline (``epochs * (batches // accum)``)
    or the fast trainer (``epochs * batches // accum``)."""
    return (epochs * batches_per_rank) // accum if fast_path else epochs * (batches_per_rank // accum)


def random_pick(df: DataFrame, id_col: str, n: int, seed: int = 42, owner: str | None = None) -> DataFrame:
    """F8: shuffle candidates (md5 order) and take ``n`` (per ``owner`` if given).

    ``row_number() <= n`` is planned with a partial per-partition group limit
    before the shuffle, so a hot owner ships at most ``n`` rows per partition."""
    key = hash_key(seed, id_col)
    if owner is None:
        return df.withColumn("_key", key).orderBy("_key", id_col).limit(n).drop("_key")
    w = Window.partitionBy(owner).orderBy(key, F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sorted_listing(df: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """distinct values in byte order (UTF8 binary = the reference's ASCII
    order) with their 0-based position."""
    return dense_index(df.select(col).distinct(), [F.col(col)], name)


def training_feed(items: DataFrame, id_col: str, frac: float, seed: int, world: int, batch_size: int,
                  epochs, drop_last: bool = True) -> DataFrame:
    """I5 -> F2 -> I7 -> I8 over training items (chunks): the exact random split
    keeps ``floor(n * frac)`` items for validation; every epoch re-permutes the
    training items (md5 of seed:epoch:id, identical on every rank), pads and
    strides them over ``world`` ranks and cuts consecutive batches.  Returns
    (id, epoch, rank, pos_in_rank, batch_id) for the training side; write it
    with ``partitionBy("epoch", "rank")``."""
    train = random_split(items.select(id_col), id_col, frac, seed).where(F.col("split") == "train").drop("split")
    out = None
    for e in epochs:
        ranked = shard_ranks(epoch_shuffle(train, id_col, seed, e, "_idx"), "_idx", world)
        b = batch(ranked, batch_size, drop_last).select(id_col, F.lit(e).alias("epoch"), "rank",
                                                        "pos_in_rank", "batch_id")
        out = b if out is None else out.unionByName(b)
    return out
