"""Token store, vocabulary and packing-manifest persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators.ordered import running_sum


def with_offsets(games: DataFrame, shard: str = "shard", order: str = "game_no",
                 len_col: str = "len") -> DataFrame:
    """``end`` = running sum of lengths in the shard, ``start = end - len``
    (the reference's offsets), computed by the block-parallel segmented scan."""
    out = running_sum(games, {"end": F.col(len_col).cast("bigint")}, [order], [shard])
    return out.withColumn("start", F.col("end") - F.col(len_col))


def number_games(games: DataFrame, shard: str = "shard", order: str = "doc_id") -> DataFrame:
    """``game_no`` = 0-based position of a game inside its shard, plus offsets."""
    out = running_sum(games, {"game_no": F.lit(1).cast("bigint"),
                              "end": F.col("len").cast("bigint")}, [order], [shard])
    return (out.withColumn("game_no", (F.col("game_no") - 1).cast("int"))
               .withColumn("start", F.col("end") - F.col("len")))


def write_tokens(games: DataFrame, path: str, shard: str = "shard", mode: str = "overwrite",
                 files_per_shard: int | None = None) -> None:
    """The token store as Parquet partitioned by shard (a shard with no game
    writes nothing).  Columns: game_no, tokens, len, start, end."""
    out = games.select(shard, "game_no", "tokens", "len", "start", "end")
    if files_per_shard:
        # a shard's games are dealt over that many tasks, so that a large shard is not one task
        part = F.pmod(F.xxhash64("game_no"), F.lit(files_per_shard))
        out = out.repartition(shard, part)
    out.write.mode(mode).partitionBy(shard).parquet(path)


def read_tokens(spark: SparkSession, path: str, shard: str | None = None) -> DataFrame:
    """Load the store, or one shard by partition pruning."""
    df = spark.read.parquet(path)
    return df.where(F.col("shard") == shard) if shard is not None else df


#: Key of a game in the bucketed store: 128 bits over its id and tokens, never NULL.
GAME_KEY = ["game_hi", "game_lo"]


def write_bucketed(games: DataFrame, name: str, path: str, id_col: str, tokens_col: str = "ids", len_col: str = "len",
                   n_buckets: int | None = None) -> DataFrame:
    """A8 for gathering: the token store as a table bucketed and sorted on the game key, and read back.

    A join on ``GAME_KEY`` finds each bucket's games in one place and in order, so the token arrays take no part in the
    join's exchange, in any epoch and for any packing made from the store.  Rows with the same id and tokens are
    stored once, with their number in ``copies`` (``stored_games`` lists them again); a NULL id is a key like any other.
    ``name`` is the table's name in the session's catalog, ``path`` where its files are."""
    spark = games.sparkSession
    n = n_buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = games.select(id_col, len_col, tokens_col, *[
        F.xxhash64(F.lit(i), F.col(id_col).isNull(), id_col, tokens_col).alias(k) for i, k in enumerate(GAME_KEY)])
    once = keyed.repartition(n, *GAME_KEY).groupBy(*GAME_KEY).agg(
        *[F.first(c).alias(c) for c in (id_col, len_col, tokens_col)], F.count("*").alias("copies"))
    once.write.bucketBy(n, *GAME_KEY).sortBy(*GAME_KEY).mode("overwrite").option("path", path).saveAsTable(name)
    return spark.table(name)


def stored_games(store: DataFrame, id_col: str, len_col: str = "len") -> DataFrame:
    """``id, len`` and key of every game of a bucketed store, as often as it was written; no token is read."""
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")
    return store.select(id_col, len_col, *GAME_KEY, copies).drop("_copy")


def write_vocab(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A10: persist (token, id)."""
    vocab.select("token", "id").write.mode(mode).parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A10: (token, id); the inverse is the same table read the other way."""
    return spark.read.parquet(path).select("token", "id")


def packing_manifest(packing: DataFrame, chunk_len: int, seed: int, shard: str = "shard") -> DataFrame:
    """One row (chunk_len, seed, shards) — the ordered shard list is bounded
    by the number of shard files."""
    return packing.agg(F.array_sort(F.collect_set(shard)).alias("shards")).select(
        F.lit(chunk_len).alias("chunk_len"), F.lit(seed).cast("bigint").alias("seed"), "shards")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def check_manifest(spark: SparkSession, path: str, max_seq_len: int) -> DataFrame:
    """A11 guard: refuse a packing built for another context length."""
    m = spark.read.schema("chunk_len int, seed bigint, shards array<string>").json(path)
    row = m.first()
    if row is None:
        raise ValueError(f"no packing manifest at {path}")
    if row["chunk_len"] != max_seq_len + 1:
        raise ValueError(f"packing chunk_len {row['chunk_len']} != max_seq_len + 1 = {max_seq_len + 1}")
    return m
