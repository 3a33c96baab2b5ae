"""Packing encoded sequences into fixed-size chunks and building training examples.

I2 ``pack_exact`` reproduces the sequential next-fit rule exactly, in parallel:

* the items are put in the seeded order (F1) by blocks pinned with a checkpoint;
* pass A (``mapInArrow``, per block) tabulates, for every possible entry fill in
  ``0..chunk_len``, the exit fill, the number of chunks closed and the items of the
  open chunk (``nextfit.fit_table``);
* the driver composes those tables in block order (one row per block);
* pass B places the items of each block from its known entry state.

Only ids and lengths take part; the token arrays stay in the token store and are
joined to the packing on the game key (C3, ``gather_chunks``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.keys import hash_key
from seqlake.operators.nextfit import compose, fit, fit_table
from seqlake.operators.ordered import BLOCK, default_blocks, hex_bucket, pin_blocks
from seqlake.session import ensure_checkpoint_dir

DEFAULT_CHUNK_LEN = 257  # max_seq_len 256 + 1
DEFAULT_SEED = 42


def seeded_key(seed, *id_cols):
    """F1 permutation key: md5 of ``seed:id``; ties (never in practice) by id."""
    return hash_key(seed, *id_cols)


def _lengths(batch: pa.RecordBatch, len_col: str) -> np.ndarray:
    return batch.column(len_col).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _stretches(groups: np.ndarray):
    """``(group, first, end)`` of each stretch of equal neighbours."""
    if not len(groups):
        return
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(groups[a]), a, b


def _tables(chunk_len: int, len_col: str):
    """Pass A: one table per block, composed batch by batch."""
    def fn(batches):
        found: dict[int, list] = {}
        for batch in batches:
            lens = _lengths(batch, len_col)
            fits = (lens >= 1) & (lens <= chunk_len)
            lens = np.clip(lens, 1, chunk_len)              # lengths that do not fit are counted and raise below
            for blk, a, b in _stretches(batch.column(BLOCK).to_numpy()):
                table, n, bad = found.get(blk, (None, 0, 0))
                own = fit_table(lens[a:b], chunk_len)
                table = own if table is None else compose(table, own, b - a)
                found[blk] = [table, n + b - a, bad + int((~fits[a:b]).sum())]
        for blk, (table, n, bad) in found.items():
            # (chunk_len + 1) x 24 bytes per block
            yield pa.RecordBatch.from_arrays(
                [pa.array([blk], pa.int32()), pa.array([n], pa.int64()), pa.array([table.astype("<i8").tobytes()], pa.binary()),
                 pa.array([bad], pa.int64())], [BLOCK, "n", "table", "n_bad"])
    return fn


def _placed(chunk_len: int, len_col: str, group_col: str, chunk_col: str, entries: dict | None = None):
    """Chunk and place of every item, group by group, in the order of the rows; the state of a group that goes on in
    the next batch is carried.  ``entries``: entry state of each group, else empty."""
    def fn(batches):
        open_, state = None, None
        for batch in batches:
            lens = _lengths(batch, len_col)
            chunk, pos = np.empty(len(lens), np.int64), np.empty(len(lens), np.int32)
            for group, a, b in _stretches(batch.column(group_col).to_numpy()):
                if group != open_:
                    open_, state = group, entries[group] if entries else (0, 0, 0)
                chunk[a:b], pos[a:b], state = fit(lens[a:b], chunk_len, *state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk), pa.array(pos)],
                                             [*batch.schema.names, chunk_col, "pos"])
    return fn


def pack_exact(items: DataFrame, id_cols, len_col: str = "len",
               chunk_len: int = DEFAULT_CHUNK_LEN, seed: int = DEFAULT_SEED,
               key_col: str | None = None, n_blocks: int | None = None) -> DataFrame:
    """Sequential next-fit packing in seeded order, computed in parallel.

    ``items`` holds one row per sequence with its length; every length must be
    in ``1..chunk_len`` (apply ``max_length_filter`` first).  Returns the input
    columns plus ``chunk_id`` (bigint, dense from 0 in packing order) and
    ``pos`` (index of the item inside its chunk).
    """
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    keyed = items.withColumn("_key", F.col(key_col) if key_col else seeded_key(seed, *id_cols))
    order = [F.col("_key"), *[F.col(c) for c in id_cols]]
    if key_col:      # arbitrary order: sampled range blocks
        pinned = pin_blocks(keyed, order, n_blocks)
    else:            # uniform md5 order: blocks straight from the key prefix, no sampling pass
        n = n_blocks or default_blocks(items)
        pinned = pin_blocks(keyed, order, n, bucket=hex_bucket(F.col("_key"), n))
    tab_schema = T.StructType([
        T.StructField(BLOCK, T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("table", T.BinaryType()), T.StructField("n_bad", T.LongType())])
    tables = (pinned.select(BLOCK, len_col)
                    .mapInArrow(_tables(chunk_len, len_col), tab_schema)
                    .collect())  # one row per block: 3 x (chunk_len + 1) int64 as bytes
    if any(r["n_bad"] for r in tables):
        raise ValueError(f"pack_exact: lengths must be within 1..{chunk_len} (apply max_length_filter)")
    tables.sort(key=lambda r: r[BLOCK])
    entries, cur, fill, base = {}, 0, 0, 0
    for r in tables:
        entries[r[BLOCK]] = (cur, fill, base)
        exit_cur, closed, tail = np.frombuffer(r["table"], dtype="<i8").reshape(3, chunk_len + 1)
        c = int(closed[cur])
        fill = int(tail[cur]) if c > 0 else fill + r["n"]
        base += c
        cur = int(exit_cur[cur])
    out_schema = T.StructType([*pinned.schema.fields, T.StructField("chunk_id", T.LongType()), T.StructField("pos", T.IntegerType())])
    packed = pinned.mapInArrow(_placed(chunk_len, len_col, BLOCK, "chunk_id", entries), out_schema)
    return packed.drop("_key", BLOCK)


#: Items per bucket that ``pack_bucketed`` aims at.
BUCKET_ROWS = 1 << 20


def pack_bucketed(items: DataFrame, id_cols, n_buckets: int | None = None, len_col: str = "len",
                  chunk_len: int = DEFAULT_CHUNK_LEN, seed: int = DEFAULT_SEED) -> DataFrame:
    """Next-fit inside each hash bucket (chunk id = (bucket, chunk_no)).

    One pass, no driver composition; wastes at most one open chunk per bucket.
    The bucket is a function of the md5 key, so buckets are uniform; their number
    follows from the row count unless given.  A bucket is a sorted stream that is
    folded batch by batch, so memory does not depend on its size.
    """
    if n_buckets is None:
        n_buckets = max(1, -(-items.count() // BUCKET_ROWS))
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    key = seeded_key(seed, *id_cols)
    # the same rule as the exact packing: a length that fits no chunk is an error, never a silent loss
    fits = F.col(len_col).between(1, chunk_len)
    checked = F.when(fits, F.col(len_col)).otherwise(F.raise_error(F.concat(
        F.lit(f"length outside 1..{chunk_len}: "), F.coalesce(F.col(len_col).cast("string"), F.lit("NULL")))).cast("int"))
    keyed = (items.withColumn(len_col, checked.cast(items.schema[len_col].dataType))
                  .withColumn("_key", key)
                  .withColumn("bucket", F.coalesce(F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint"),
                                                          F.lit(n_buckets)), F.lit(0)).cast("int")))
    for i, c in enumerate(id_cols):
        keyed = keyed.withColumn(f"_id{i}", F.col(c))
    ids = [f"_id{i}" for i in range(len(id_cols))]
    schema = T.StructType([*keyed.schema.fields, T.StructField("chunk_no", T.LongType()),
                           T.StructField("pos", T.IntegerType())])
    dealt = keyed.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "_key", *ids)
    return dealt.mapInArrow(_placed(chunk_len, len_col, "bucket", "chunk_no"), schema).drop("_key", *ids)


def gather_chunks(packing: DataFrame, tokens: DataFrame, join_cols, tokens_col: str = "ids") -> DataFrame:
    """Each chunk's member sequences concatenated in packing order.

    Equi-join packing x token store on the sequence key, then regroup by
    ``chunk_id``; a chunk holds at most ``chunk_len`` tokens, so every group is
    bounded.  With a store that is bucketed on the key (``sources.tokens.
    write_bucketed``) only the packing's narrow rows are exchanged for the join;
    the token arrays move once, to their chunks.
    """
    store = tokens.select(*join_cols, tokens_col)
    return gather_packed(packing.select(*join_cols, "chunk_id", "pos").join(store, list(join_cols)), tokens_col)


def gather_packed(packed: DataFrame, tokens_col: str = "ids") -> DataFrame:
    """C3 when the packing already carries each sequence's tokens (they were
    passed through ``pack_exact``): one shuffle by chunk, no join."""
    return (packed.groupBy("chunk_id")
                  .agg(F.array_sort(F.collect_list(F.struct("pos", tokens_col))).alias("_m"),
                       F.count("*").alias("n_games"))
                  .select("chunk_id", "n_games",
                          F.flatten(F.transform("_m", lambda m: m[tokens_col])).alias("tokens")))


def chunk_tensor(chunks: DataFrame, chunk_len: int = DEFAULT_CHUNK_LEN, tokens_col: str = "tokens") -> DataFrame:
    """I4: pad each chunk with 0 to ``chunk_len`` then shift (E2): inputs = t[:-1],
    labels = t[1:]; no reset at game boundaries.  ``n_tokens`` counts label
    positions that are not PAD (D9)."""
    padded = F.concat(F.col(tokens_col),
                      F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(chunk_len) - F.size(tokens_col))))
    return (chunks.withColumn("_t", padded)
                  .select("chunk_id",
                          F.slice("_t", 1, chunk_len - 1).alias("input_ids"),
                          F.slice("_t", 2, chunk_len - 1).alias("labels"))
                  .withColumn("n_tokens", nonpad_tokens("labels")))


def shift_labels(tokens_col: str = "tokens"):
    """E2 in array form: (inputs, labels) = (t[:-1], t[1:])."""
    n = F.size(tokens_col)
    return (F.slice(tokens_col, 1, n - 1).alias("input_ids"), F.slice(tokens_col, 2, n - 1).alias("labels"))


def shift_labels_long(long_df: DataFrame, group: str, pos: str, token: str) -> DataFrame:
    """E2 in long form: the label of a position is the next token of its group."""
    w = Window.partitionBy(group).orderBy(pos)
    return long_df.withColumn("label", F.lead(token).over(w)).where(F.col("label").isNotNull())


def nonpad_tokens(labels_col: str = "labels"):
    """Number of labels that are not PAD (0)."""
    return F.size(F.filter(labels_col, lambda x: x != F.lit(0))).cast("int")


def packing_summary(packing: DataFrame, len_col: str = "len", shard_col: str = "shard",
                    chunk_len: int = DEFAULT_CHUNK_LEN) -> DataFrame:
    """Games, shards, chunks, tokens and fill = tokens / (chunks * chunk_len)."""
    return packing.agg(
        F.count("*").alias("n_games"),
        F.count_distinct(shard_col).alias("n_shards"),
        (F.max("chunk_id") + 1).cast("bigint").alias("n_chunks"),
        F.sum(len_col).cast("bigint").alias("n_tokens"),
    ).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_chunks") * F.lit(chunk_len)), 6))


def preview(tensors: DataFrame, vocab: DataFrame, n_chunks: int = 3, n_tokens: int = 20,
            ids_col: str = "input_ids") -> DataFrame:
    """the first ``n_chunks`` chunks (a limit is the feature here), their
    first ``n_tokens`` non-PAD tokens decoded."""
    from seqlake.operators.encode import decode_join
    ensure_checkpoint_dir(tensors.sparkSession)
    # a few rows, pinned: the lookup may read them more than once
    first = tensors.orderBy("chunk_id").limit(n_chunks).select("chunk_id", ids_col).checkpoint()
    dec = decode_join(first, "chunk_id", ids_col, vocab)
    toks = F.slice(F.filter("decoded", lambda t: t != F.lit("PAD")), 1, n_tokens)
    return dec.select("chunk_id", F.array_join(toks, " ").alias("preview"))
