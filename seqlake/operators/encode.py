"""Encoding token sequences into ids (C1 lookup, B7 reject, B8 strict, I1 encode)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators.joins import BROADCAST_BYTES, data_bytes, hot_values
from seqlake.operators.vocab import BOS, EOS, fixed_move_ids
from seqlake.session import landed, small_batches


def _pair():
    return F.struct("_pos", "_to")


def _regrouped_broadcast(exploded: DataFrame, lk: DataFrame, by, kept) -> DataFrame:
    """The rows put together again after a lookup that is broadcast: no exchange beside that of the input."""
    return exploded.join(F.broadcast(lk), "_from", "left").groupBy(*by).agg(
        *[F.first(c).alias(c) for c in kept],
        F.count_if(F.coalesce(F.col("_pos"), F.lit(0)) == 0).cast("int").alias("_times"),
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), _pair()))).alias("_pairs"))


def _filler(hot, out_col: str, kept):
    """Arrow batches of sequences -> ``kept`` and ``out_col``: every element through the frequent values (``hot``, a
    broadcast Arrow table), or the ``(_pos, _to)`` pairs in ``_cold`` where it has one."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        table = hot.value
        for b in batches:
            seqs, cold = b.column("_seq"), b.column("_cold")
            sizes, n_cold = (pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(np.int64) for c in (seqs, cold))
            ends = np.cumsum(sizes)
            flat, (pos, to) = seqs.flatten(), cold.flatten().flatten()
            known = table.column("_from").combine_chunks().cast(flat.type)
            own = table.column("_hot").combine_chunks().cast(to.type).take(pc.index_in(flat, value_set=known, skip_nulls=True))
            at = np.arange(len(flat))
            at[np.repeat(ends - sizes, n_cold) + pos.to_numpy()] = len(flat) + np.arange(len(pos))
            out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()),
                                           pa.concat_arrays([own, to]).take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], out], names=[*kept, out_col])
    return run


def _filled_hot_cold(seqs: DataFrame, arr_col: str, lk: DataFrame, n: int, kept, out_col: str) -> DataFrame:
    """``kept`` and ``out_col`` for a lookup over the broadcast bound: its frequent values are looked up inside the
    arrays, the long tail is shuffled.

    Rows are landed with a number, which is all that names them: only elements that are not frequent travel to the
    lookup, those that it knows travel back, and none of them has a hot key.  Sequences move once, as they are."""
    spark = seqs.sparkSession
    small_batches(spark)
    rows = landed(seqs.withColumn("_row", F.monotonically_increasing_id()), "sequences")
    hot = hot_values(rows.select("_row", F.posexplode(arr_col).alias("_pos", "_from")), "_from", ["_row", "_pos"])
    found = lk.join(F.broadcast(hot), "_from")            # at most HOT_ITEMS rows of at most HOT_BYTES
    hot = hot.join(F.broadcast(found), "_from", "left").select("_from", F.col("_to").alias("_hot"), F.lit(True).alias("_is_hot"))
    hot = hot.checkpoint()
    base = rows.select("_row", F.coalesce(arr_col, F.array().cast(rows.schema[arr_col].dataType)).alias("_seq"))
    # one exchange serves the long tail and the filling: outer forms and this filter, so that neither gets its own below it
    base = base.where(F.col("_row").isNotNull()).repartition(n, "_row")
    tried = base.select("_row", F.posexplode_outer("_seq").alias("_pos", "_from")).join(F.broadcast(hot), "_from", "left")
    cold = (tried.where(F.col("_is_hot").isNull() & F.col("_from").isNotNull()).select("_row", "_pos", "_from")
                 .join(lk.hint("shuffle_hash"), "_from")      # a lookup's values are its keys: no task holds more than its share
                 .select("_row", "_pos", "_to").repartition(n, "_row").groupBy("_row").agg(F.collect_list(_pair()).alias("_cold")))
    rest = rows.withColumn(arr_col, F.col(arr_col).isNull()) if arr_col in kept else rows
    whole = base.join(rest.select("_row", *kept).repartition(n, "_row"), "_row", "left").join(cold.hint("shuffle_hash"), "_row", "left")
    if arr_col in kept:
        whole = whole.withColumn(arr_col, F.when(~F.col(arr_col), F.col("_seq")))
    to = T.StructField(out_col, T.ArrayType(lk.schema["_to"].dataType))
    schema = T.StructType([*[T.StructField(c, seqs.schema[c].dataType) for c in kept], to])
    known = spark.sparkContext.broadcast(hot.select("_from", "_hot").toArrow())
    return whole.select(*kept, "_seq", "_cold").mapInArrow(_filler(known, out_col, kept), schema)


def map_elements(seqs: DataFrame, key: str, arr_col: str, lookup: DataFrame,
                 from_col: str, to_col: str, out_col: str,
                 n_partitions: int | None = None, carry=None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Replace every array element through a lookup table; misses become NULL.

    ``posexplode`` -> join with the lookup -> regroup by the sequence key.  A
    lookup of at most ``broadcast_bytes`` (measured) is broadcast; of a larger
    one the frequent values are, and only the long tail of the elements is
    exploded and shuffled to it and back (``_filled_hot_cold``).  The input is
    hash-partitioned first, so the regroup and the final join add no exchange of
    the rows.  Never a map column (a map lookup is a linear scan).

    ``carry`` names small per-sequence columns to bring through the regroup
    instead of joining the result back (one exchange of the input instead of
    two); only the key, ``carry`` and the result are returned then.  Large
    columns must not be carried: they would be copied once per element.
    """
    n = n_partitions or int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = list(carry or [])
    lk = lookup.select(F.col(from_col).alias("_from"), F.col(to_col).alias("_to"))
    if data_bytes(lk) > broadcast_bytes:
        return _filled_hot_cold(seqs, arr_col, lk, n, seqs.columns if carry is None else [key, *kept], out_col)
    # a sequence is its key and content: rows that share a key stay apart, equal rows are put back as often as they came
    base = seqs.repartition(n, key).withColumn("_row", F.xxhash64(key, arr_col, *kept))
    exploded = base.select(key, "_row", *kept, F.posexplode_outer(arr_col).alias("_pos", "_from"))
    regrouped = _regrouped_broadcast(exploded, lk, [key, "_row"], kept)
    # n equal rows gave every position n times in a row
    single = F.filter("_pairs", lambda _, i: i % F.col("_times") == 0)
    mapped = regrouped.withColumn(out_col, F.transform(
        F.when(F.col("_times") > 1, single).otherwise(F.col("_pairs")), lambda p: p["_to"]))
    if carry is not None:
        times = F.when(F.col("_times") > 1, F.array_repeat(F.lit(0), F.col("_times"))).otherwise(F.array(F.lit(0)))
        return mapped.withColumn("_copy", F.explode(times)).select(key, *kept, out_col)
    mapped = mapped.select(F.col(key).alias("_mk"), F.col("_row").alias("_mr"), out_col)
    same = (F.col("_row") == F.col("_mr")) & F.col(key).eqNullSafe(F.col("_mk"))
    return base.join(mapped, same, "left").drop("_row", "_mk", "_mr")


def lookup_ids(seqs: DataFrame, key: str, tokens_col: str, vocab: DataFrame,
               out_col: str = "ids", n_partitions: int | None = None, carry=None) -> DataFrame:
    """Token -> id for every element; unknown tokens become NULL."""
    voc = vocab.select("token", F.col("id").cast("int").alias("id"))
    return map_elements(seqs, key, tokens_col, voc, "token", "id", out_col, n_partitions, carry)


def decode_join(seqs: DataFrame, key: str, ids_col: str, vocab: DataFrame,
                out_col: str = "decoded", unknown: str = "?") -> DataFrame:
    """C2 for vocabularies of any size: id -> token by the same explode/join/regroup
    path; an unknown id decodes to ``unknown``."""
    out = map_elements(seqs, key, ids_col, vocab, "id", "token", "_dec")
    return out.withColumn(out_col, F.transform("_dec", lambda t: F.coalesce(t, F.lit(unknown)))).drop("_dec")


def all_known(ids_col: str = "ids"):
    """B7 predicate: non-empty and no unknown token."""
    return (F.size(ids_col) > 0) & F.forall(ids_col, lambda x: x.isNotNull())


def encode(seqs: DataFrame, key: str, tokens_col: str, vocab: DataFrame,
           on_unknown: str = "reject", keep_rejects: bool = False, carry=None, max_len: int | None = None) -> DataFrame:
    """``[BOS] ++ ids ++ [EOS]`` with length ``len``.

    ``max_len`` (with ``on_unknown="reject"``, rejects not kept) is B6 taken first: a sequence that would come out
    longer is left out before any of its tokens is looked up.

    ``on_unknown="reject"`` (B7) drops a sequence with any unknown token or no
    token at all (``keep_rejects=True`` keeps it with a ``reject_reason``);
    ``on_unknown="error"`` (B8, serving) raises on the first unknown token and
    appends no EOS.  ``carry``: see ``map_elements``.
    """
    if max_len is not None:
        if keep_rejects or on_unknown != "reject":
            raise ValueError("max_len leaves sequences out: only with rejects that are dropped")
        seqs = seqs.where(F.size(tokens_col) + 2 <= max_len)
    looked = lookup_ids(seqs, key, tokens_col, vocab, "_ids", carry=carry)
    if on_unknown == "error":
        def known(token, x):
            return F.coalesce(x, F.raise_error(F.concat(F.lit("unknown token: "), token)).cast("int"))
        if tokens_col in looked.columns:
            ids = F.zip_with(tokens_col, "_ids", lambda t, x: known(F.coalesce(t, F.lit("NULL")), x))
        else:
            ids = F.transform("_ids", lambda x: known(F.lit("(tokens not carried)"), x))
        return looked.withColumn("ids", F.concat(F.array(F.lit(BOS)), ids)) \
                     .withColumn("len", F.size("ids")).drop("_ids")
    if on_unknown != "reject":
        raise ValueError(f"unknown on_unknown mode {on_unknown!r}")
    reason = (F.when(F.col("_ids").isNull() | (F.size("_ids") == 0), F.lit("empty"))
               .when(~F.forall("_ids", lambda x: x.isNotNull()), F.lit("unknown_token")))
    out = (looked.withColumn("reject_reason", reason)
                 .withColumn("ids", F.when(F.col("reject_reason").isNull(),
                                           F.concat(F.array(F.lit(BOS)), F.col("_ids"), F.array(F.lit(EOS)))))
                 .withColumn("len", F.size("ids"))
                 .drop("_ids"))
    if keep_rejects:
        return out
    return out.where(F.col("reject_reason").isNull()).drop("reject_reason")


def encode_fixed(df: DataFrame, tokens_col: str, table, keep_rejects: bool = False) -> DataFrame:
    """I1 for the fixed move vocabulary: in-row, no join and no exchange.

    ``table`` is ``vocab.move_id_table``; every column of ``df`` stays, so repeated
    keys need no care.  Rejection as in ``encode``."""
    looked = df.withColumn("_ids", fixed_move_ids(tokens_col, table))
    reason = (F.when(F.col("_ids").isNull() | (F.size("_ids") == 0), F.lit("empty"))
               .when(~F.forall("_ids", lambda x: x.isNotNull()), F.lit("unknown_token")))
    out = (looked.withColumn("reject_reason", reason)
                 .withColumn("ids", F.when(F.col("reject_reason").isNull(),
                                           F.concat(F.array(F.lit(BOS)), F.col("_ids"), F.array(F.lit(EOS)))))
                 .withColumn("len", F.size("ids")).drop("_ids"))
    return out if keep_rejects else out.where(F.col("reject_reason").isNull()).drop("reject_reason")


def vocab_lookup(seqs: DataFrame, key: str, tokens_col: str, vocab: DataFrame, out_col: str = "ids") -> DataFrame:
    """C1 under its survey name (see ``lookup_ids``)."""
    return lookup_ids(seqs, key, tokens_col, vocab, out_col)


def reject_unknown(seqs: DataFrame, key: str, tokens_col: str, vocab: DataFrame) -> DataFrame:
    """Every sequence with ``reject_reason`` (NULL = kept, 'empty', 'unknown_token')."""
    return encode(seqs, key, tokens_col, vocab, on_unknown="reject", keep_rejects=True)


def strict_encode(seqs: DataFrame, key: str, tokens_col: str, vocab: DataFrame) -> DataFrame:
    """Serving encode — ``[BOS] ++ ids``, an unknown token fails the query."""
    return encode(seqs, key, tokens_col, vocab, on_unknown="error")
