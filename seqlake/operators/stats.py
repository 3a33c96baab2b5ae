"""Corpus statistics and evaluation aggregates.

All are single aggregations with map-side partial aggregation; exact medians
use ``percentile`` (``percentile_approx`` only as an explicit approximate mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators.joins import sized_broadcast
from seqlake.operators.ordered import running_sum


def funnel(df: DataFrame, stem: str, passed: Column, kept: Column) -> DataFrame:
    """Per source and grand total — rows, rows passing the SQL filter, rows
    kept after conversion — in one pass (``rollup``); ``is_total`` marks the total."""
    return (df.rollup(stem)
              .agg(F.count("*").alias("n_rows"),
                   F.count_if(passed).alias("n_passed"),
                   F.count_if(passed & kept).alias("n_kept"),
                   F.grouping(stem).cast("boolean").alias("is_total")))


def encode_totals(df: DataFrame, shard: str = "shard", len_col: str = "len",
                  skipped: Column | None = None) -> DataFrame:
    """Games written, lines skipped, tokens and bytes (2 per uint16 token)
    per shard, plus the overall row (``is_total``)."""
    ok = F.col(len_col).isNotNull() if skipped is None else ~skipped
    return (df.rollup(shard)
              .agg(F.count_if(ok).alias("n_games"),
                   F.count_if(~ok).alias("n_skipped"),
                   F.coalesce(F.sum(F.when(ok, F.col(len_col))), F.lit(0)).cast("bigint").alias("n_tokens"),
                   F.grouping(shard).cast("boolean").alias("is_total"))
              .withColumn("n_bytes", F.col("n_tokens") * 2))


def length_stats(df: DataFrame, len_col: str = "len", approx: bool = False) -> DataFrame:
    """D3: count, mean and median length.

    Exact mode works from the histogram of length values and its running count
    (block-parallel), so no task ever holds all values (Spark's exact
    ``percentile`` buffers every value of its group) and nothing is collected.
    The median is the mean of the two middle values, as ``percentile(len, 0.5)``.
    ``approx=True`` is the flagged ``percentile_approx`` monitoring mode."""
    if approx:
        return df.agg(F.count(len_col).alias("n"), F.round(F.avg(len_col), 6).alias("mean_len"),
                      F.percentile_approx(len_col, 0.5, 10000).cast("double").alias("median_len"))
    hist = df.where(F.col(len_col).isNotNull()).groupBy(F.col(len_col).alias("v")).agg(F.count("*").alias("c"))
    cum = running_sum(hist, {"upto": F.col("c")}, ["v"])
    n = cum.agg(F.max("upto")).first()[0] or 0       # from the pinned counts: the lengths are read once
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))  # noqa: E731  value at 0-based rank k
    return cum.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n"),
                   F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean_len"),
                   ((at((n - 1) // 2) + at(n // 2)) / 2).cast("double").alias("median_len"))


def token_frequency(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Occurrences per token (explode, then a partial + final count)."""
    return (df.select(F.explode(tokens_col).alias("token"))
              .groupBy("token").agg(F.count("*").alias("n")))


def rating_histogram(df: DataFrame, cols, width: int) -> DataFrame:
    """Histogram of ratings of both players (``stack``, not a self-union)."""
    stacked = df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("rating"))
    return (stacked.where(F.col("rating").isNotNull())
                   .groupBy((F.floor(F.col("rating") / width) * width).cast("bigint").alias("bucket"))
                   .agg(F.count("*").alias("n")))


def category_distribution(df: DataFrame, col: str) -> DataFrame:
    """Count per category and its share of the total (one number, from a count of the input)."""
    total = df.count()
    return df.groupBy(col).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.lit(total), 6))


def completeness_by_period(df: DataFrame, date_col: str, cols, unit: str = "month") -> DataFrame:
    """Share of non-null values of every column per period."""
    period = F.date_trunc(unit, F.col(date_col)).alias("period")
    aggs = [F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(f"{c}_filled") for c in cols]
    return df.groupBy(period).agg(F.count("*").alias("n"), *aggs)


def token_weighted_loss(df: DataFrame, keys, loss: str = "loss", n: str = "n_tokens",
                        guard: bool = True) -> DataFrame:
    """sum(loss * n) / sum(n) per group; 0.0 when there are no tokens
    (training path, ``guard=True``) or NULL (validation path divides unguarded)."""
    num = F.sum(F.col(loss) * F.col(n))
    den = F.sum(F.col(n))
    val = F.when(den > 0, num / den).otherwise(F.lit(0.0)) if guard else num / F.nullif(den, F.lit(0))
    return df.groupBy(*keys).agg(F.round(val, 6).alias("weighted_loss"),
                                 den.cast("bigint").alias("n_tokens"))


def throughput_log(metrics: DataFrame, log_every: int = 50, epoch: str = "epoch", step: str = "step",
                   loss: str = "loss", n: str = "n_tokens", ts: str = "ts_s",
                   world_size: int = 1) -> DataFrame:
    """One row per complete window of ``log_every`` steps: its tokens, tokens
    per second since the previous log (the epoch's start for the first; summed
    over ranks), the loss of its last step, its mean loss and the running
    token-weighted loss since the epoch start (E6 over the window sums)."""
    win = F.floor((F.col(step) - 1) / log_every).cast("bigint").alias("log_window")
    per = (metrics.groupBy(epoch, win)
                  .agg(F.sum(n).cast("bigint").alias("tokens"),
                       F.sum(F.col(loss) * F.col(n)).alias("_ln"),
                       F.min(ts).alias("_from"), F.max(ts).alias("_to"),
                       F.round(F.max_by(loss, F.struct(step, ts)), 6).alias("last_loss"),
                       F.max(step).alias("last_step")))
    per = per.where(F.col("last_step") == (F.col("log_window") + 1) * log_every)
    w = Window.partitionBy(epoch).orderBy("log_window")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    elapsed = F.col("_to") - F.coalesce(F.lag("_to").over(w), F.col("_from"))
    return (per.withColumn("_dt", elapsed)
               .withColumn("tok_per_s", F.round(F.col("tokens") * world_size / F.nullif(F.col("_dt"), F.lit(0.0)), 6))
               .withColumn("window_loss", F.round(F.col("_ln") / F.nullif(F.col("tokens"), F.lit(0)), 6))
               .withColumn("running_loss", F.round(F.sum("_ln").over(upto) / F.nullif(F.sum("tokens").over(upto), F.lit(0)), 6))
               .drop("_ln", "_dt", "_from", "_to"))


def phase_of(ply: Column) -> Column:
    """D13 buckets by full move ``ceil(ply / 2)``: opening 1-10, middle 11-25, end 26+."""
    move = F.ceil(ply / 2)
    return F.when(move <= 10, F.lit("opening")).when(move <= 25, F.lit("middlegame")).otherwise(F.lit("endgame"))


def accuracy_by_phase(df: DataFrame, ply: str, correct: str) -> DataFrame:
    """Accuracy per game phase."""
    return (df.groupBy(phase_of(F.col(ply)).alias("phase"))
              .agg(F.count("*").alias("n"),
                   F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy")))


def key_drift(left: DataFrame, right: DataFrame, key: str, allow: DataFrame | None = None) -> DataFrame:
    """Keys missing on the right and unexpected on the right, minus an allow-list."""
    lk = left.select(F.col(key).alias("k")).distinct()
    rk = right.select(F.col(key).alias("k")).distinct()
    missing = lk.subtract(rk).withColumn("kind", F.lit("missing"))
    unexpected = rk.subtract(lk).withColumn("kind", F.lit("unexpected"))
    out = missing.unionByName(unexpected)
    if allow is not None:
        out = out.join(allow.select(F.col(key).alias("k")), "k", "left_anti")
    return out.withColumnRenamed("k", key)


def running_weighted_avg(per_step: DataFrame, epoch: str = "epoch", step: str = "step",
                         loss_x_n: str = "ln", n: str = "n") -> DataFrame:
    """After each step, sum(loss*n) / sum(n) since the epoch start (two
    block-parallel running sums; an epoch may hold any share of the rows)."""
    cum = running_sum(per_step, {"_cln": loss_x_n, "_cn": n}, [step], [epoch])
    return cum.withColumn("running_loss", F.round(F.col("_cln") / F.nullif(F.col("_cn"), F.lit(0)), 6)) \
              .drop("_cln", "_cn")


def ply_index(df: DataFrame, moves_played: str) -> DataFrame:
    """Ply, full move ``ceil(ply / 2)`` and side to move (white iff the
    number of moves played is even)."""
    m = F.col(moves_played)
    return (df.withColumn("ply", (m + 1).cast("bigint"))
              .withColumn("full_move", F.ceil((m + 1) / 2).cast("bigint"))
              .withColumn("side_to_move", F.when(m % 2 == 0, F.lit("white")).otherwise(F.lit("black"))))


def book_agreement(pred: DataFrame, book: DataFrame, group: str, prefix: str = "pfx", nxt: str = "nxt") -> DataFrame:
    """Share of (prefix -> next move) predictions found in the opening book.
    Joined on a 64-bit prefix hash plus full equality (a hash collision cannot
    produce a false match); the book is de-duplicated first."""
    p = pred.withColumn("_h", F.xxhash64(prefix))
    # a popular opening is a hot key on the prediction side: broadcast the
    # de-duplicated book when its size is checked small (else AQE splits the skew)
    b = sized_broadcast(book.select(F.col(prefix).alias("_bp"), F.col(nxt).alias("_bn")).distinct()
                            .withColumn("_bh", F.xxhash64("_bp")).withColumn("_hit", F.lit(1)))
    j = p.join(b, (p["_h"] == b["_bh"]) & (p[prefix] == b["_bp"]) & (p[nxt] == b["_bn"]), "left")
    return (j.groupBy(group).agg(F.count("*").alias("n"), F.count("_hit").alias("n_in_book"))
             .withColumn("share", F.round(F.col("n_in_book") / F.col("n"), 6)))
