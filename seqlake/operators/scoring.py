"""Batch scoring over vocabulary-sized logit vectors.

Everything is in-row array algebra (``transform`` / ``filter`` / ``aggregate``
/ ``sort_array``): no explode, no shuffle, whole-stage code generation.  The
legal set is an input column of token ids (the rules engine is not built).
Ties are broken towards the higher id everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.keys import uniform01
from seqlake.operators.vocab import N_SPECIAL

MIN_TEMPERATURE = 1e-8


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scored(logits) -> Column:
    """array<struct<logit double, id int>> for the non-special ids."""
    pairs = F.transform(_c(logits), lambda x, i: F.struct(x.cast("double").alias("logit"), i.alias("id")))
    return F.filter(pairs, lambda s: s["id"] >= N_SPECIAL)


def _is_legal(legal, sid) -> Column:
    return F.array_contains(_c(legal), sid)


def greedy_legal(logits, legal, game_over=None) -> Column:
    """highest-logit legal id (specials excluded); NULL when the game is over
    or nothing is legal.  ``array_max`` over (logit, id) structs = ties to the higher id."""
    best = F.array_max(F.filter(scored(logits), lambda s: _is_legal(legal, s["id"])))["id"]
    return best if game_over is None else F.when(~_c(game_over), best)


def _with_scalar(arr: Column, scalar: Column, fn) -> Column:
    """``transform(arr, x -> fn(x, scalar))`` with ``scalar`` evaluated once per row.

    A per-row scalar referenced inside a lambda is re-evaluated for every
    element once Catalyst collapses the projections (O(n^2) per row); handing
    it in as a repeated array through ``zip_with`` keeps it outside the lambda.
    """
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), fn)


def probabilities(logits, temperature: float = 1.0) -> Column:
    """Softmax over the full (non-special) vocabulary at ``max(T, 1e-8)``:
    array<struct<p double, id int>> in id order."""
    t = max(float(temperature), MIN_TEMPERATURE)
    s = scored(logits)
    m = F.array_max(F.transform(s, lambda x: x["logit"]))
    w = _with_scalar(s, m, lambda x, mm: F.struct(F.exp((x["logit"] - mm) / F.lit(t)).alias("w"),
                                                   x["id"].alias("id")))
    z = F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x["w"])
    return _with_scalar(w, z, lambda x, zz: F.struct((x["w"] / zz).alias("p"), x["id"].alias("id")))


def topk_legal(logits, legal, k: int = 5, temperature: float = 1.0) -> Column:
    """the first ``k`` legal ids by probability (full-vocabulary softmax, not
    renormalised; fewer than ``k`` if fewer are legal): array<struct<p, id>>."""
    probs = F.filter(probabilities(logits, temperature), lambda x: _is_legal(legal, x["id"]))
    return F.slice(F.sort_array(probs, asc=False), 1, k)


def _draw(weights: Column, u: Column) -> Column:
    """Inverse CDF in array order over array<struct<w, id>>: first id whose
    cumulative weight exceeds ``u * total``; NULL when the total is 0.  The
    target travels in the fold state, so it is computed once per row."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x["w"])
    init = F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("int").alias("pick"),
                    (u * total).alias("target"))
    folded = F.aggregate(weights, init, lambda s, x: F.struct(
        (s["acc"] + x["w"]).alias("acc"),
        F.when(s["pick"].isNull() & (s["acc"] + x["w"] > s["target"]), x["id"]).otherwise(s["pick"]).alias("pick"),
        s["target"].alias("target")))
    return F.when(folded["target"] > 0, folded["pick"])


def sample_legal(logits, legal, temperature: float, seed: int, id_col) -> Column:
    """softmax at T over the legal ids, one repeatable draw (uniform =
    md5(seed:id) / 2^32).  Nothing legal -> NULL; ``T <= 0`` is greedy."""
    if float(temperature) <= 0:
        return greedy_legal(logits, legal)
    t = max(float(temperature), MIN_TEMPERATURE)
    # the maximum over the legal ids: a high illegal logit cannot underflow all legal weights
    s = F.filter(scored(logits), lambda x: _is_legal(legal, x["id"]))
    m = F.array_max(F.transform(s, lambda x: x["logit"]))
    w = _with_scalar(s, m,
                     lambda x, mm: F.struct(F.exp((x["logit"] - mm) / F.lit(t)).alias("w"), x["id"].alias("id")))
    return _draw(w, uniform01(seed, id_col))


def sample_topk(logits, legal, k: int, temperature: float, seed: int, id_col) -> Column:
    """F4's candidates renormalised over the ``k`` and drawn in rank order."""
    cands = topk_legal(logits, legal, k, temperature)
    w = F.transform(cands, lambda x: F.struct(x["p"].alias("w"), x["id"].alias("id")))
    return _draw(w, uniform01(seed, id_col))


STRATEGIES = ("greedy", "sample", "top_k")


def strategy(mode, logits, legal, temperature: float = 0.6, k: int = 3, seed: int = 42,
             id_col="row_id") -> Column:
    """choose greedy / sample / top_k per row (``mode`` is a string or a
    column); an unknown mode raises."""
    if isinstance(mode, str):
        if mode not in STRATEGIES:
            raise ValueError(f"unknown mode {mode!r}, expected one of {STRATEGIES}")
        mode = F.lit(mode)
    return (F.when(mode == "greedy", greedy_legal(logits, legal))
             .when(mode == "sample", sample_legal(logits, legal, temperature, seed, id_col))
             .when(mode == "top_k", sample_topk(logits, legal, k, temperature, seed, id_col))
             .otherwise(F.raise_error(F.concat(F.lit(f"unknown mode, expected one of {STRATEGIES}: "), mode)).cast("int")))


def topk_ids(logits, k: int) -> Column:
    """Top-k ids by raw logit (specials excluded, no legal mask)."""
    return F.transform(F.slice(F.sort_array(scored(logits), asc=False), 1, k), lambda s: s["id"])


def topk_accuracy(df: DataFrame, logits: str, target: Column, klass=lambda i: i, k: int = 5) -> DataFrame:
    """Share of rows whose target is the top-1 / within the top-k."""
    top = F.transform(topk_ids(logits, k), klass)
    return df.agg(F.count("*").alias("n"),
                  F.round(F.avg((F.get(top, 0) == target).cast("double")), 6).alias("top1_acc"),
                  F.round(F.avg(F.array_contains(top, target).cast("double")), 6).alias("topk_acc"))


def low_confidence(df: DataFrame, logits: str, cutoff: float = 0.05, keep=()) -> DataFrame:
    """The rows whose top-1 probability is under ``cutoff``, with that probability (``p1``)."""
    p1 = F.array_max(F.transform(probabilities(logits), lambda x: x["p"]))
    return df.withColumn("p1", p1).where(F.col("p1") < cutoff).select(*keep, "p1")


def illegal_and_confidence(df: DataFrame, logits: str, legal: str, cutoff: float = 0.05) -> DataFrame:
    """Share of raw top-1 ids outside the legal set; rows whose top-1
    probability is under ``cutoff``."""
    top1 = F.get(topk_ids(logits, 1), 0)
    p1 = F.array_max(F.transform(probabilities(logits), lambda x: x["p"]))
    return df.agg(F.count("*").alias("n"),
                  F.round(F.avg((~F.array_contains(legal, top1)).cast("double")), 6).alias("illegal_rate"),
                  F.count_if(p1 < cutoff).alias("n_low_conf"))


def parity_join(a: DataFrame, b: DataFrame, keys, value: str = "v") -> DataFrame:
    """Align two result sets position by position (full outer equi-join);
    a side missing on either end is a failure row (``matched`` false)."""
    j = a.withColumnRenamed(value, "a").join(b.withColumnRenamed(value, "b"), list(keys), "full_outer")
    return j.withColumn("matched", F.col("a").isNotNull() & F.col("b").isNotNull())


def parity_summary(pairs: DataFrame, group, vector, atol: float = 1e-4, rtol: float = 1e-4) -> DataFrame:
    """Max |a-b|; allclose = all |a-b| <= atol + rtol*|b|; equal top-1 of
    every vector (argmax position per ``vector``, ties to the higher position);
    pass = allclose or top-1."""
    diff = F.abs(F.col("a") - F.col("b"))
    return (pairs.groupBy(*group, *vector)
                 .agg(F.max(diff).alias("_d"),
                      F.bool_and(F.coalesce(diff <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("b")), F.lit(False)))
                       .alias("_close"),
                      (F.max_by("pos", F.struct("a", "pos")) == F.max_by("pos", F.struct("b", "pos"))).alias("_top1"))
                 .groupBy(*group)
                 .agg(F.round(F.max("_d"), 6).alias("max_abs_diff"), F.bool_and("_close").alias("allclose"),
                      F.bool_and("_top1").alias("top1_match"))
                 .withColumn("pass", F.col("allclose") | F.col("top1_match")))


def linear_scorer(n_out: int):
    """K2 model factory for ``predict_batch_udf``: a fixed linear map whose
    weights are built once per Python worker inside the factory."""
    def make_predict_fn():
        import numpy as np
        i = np.arange(n_out)[:, None]
        j = np.arange(64)[None, :]
        w = (((i * 7 + j * 13) % 17) - 8) / 8.0

        def predict(x):
            return (np.asarray(x, dtype=np.float64) @ w.T).astype(np.float64)
        return predict
    return make_predict_fn


#: Rows of one length that a scorer gets at a time.
PREFIX_ROWS = 1024


def score_prefixes(df: DataFrame, ids_col: str, make_scorer, n_out: int, max_len: int,
                   out_col: str = "logits", reason_col: str = "reason") -> DataFrame:
    """K2: next-token logits of token-id prefixes of different lengths, without padding.

    ``make_scorer()`` is called once per task and returns ``ids [rows, n] int64 -> logits [rows, n_out]`` (those of
    the last position).  Rows are ranged by prefix length, so a task sees few lengths and a common length is spread
    over many tasks; an Arrow batch is cut wherever the length changes and after ``PREFIX_ROWS`` rows, so every call gets
    one rectangular block.  Special ids are masked with minus infinity.  Every row stays: a NULL or empty prefix
    (``empty``; a game without moves is ``[BOS]``), one with a NULL id (``unknown_token``) or of more than ``max_len``
    ids (``too_long``) has NULL logits and that reason."""
    import pyarrow as pa

    ids = F.col(ids_col)
    reason = (F.when(ids.isNull() | (F.size(ids) == 0), F.lit("empty"))
               .when(F.exists(ids, lambda x: x.isNull()), F.lit("unknown_token"))
               .when(F.size(ids) > max_len, F.lit("too_long")))
    told = df.withColumn(reason_col, reason).withColumn(
        "_run", F.when(F.col(reason_col).isNull(), F.size(ids)).otherwise(F.lit(0)))
    ranged = (told.withColumn("_tie", F.monotonically_increasing_id())
                  .repartitionByRange("_run", "_tie").sortWithinPartitions("_run").drop("_tie"))
    schema = T.StructType([*told.drop("_run").schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def scored_batches(batches):
        import numpy as np
        scorer = make_scorer()
        for batch in batches:
            runs = batch.column("_run").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
            for lo, hi in zip(cuts, cuts[1:]):
                for a in range(lo, hi, PREFIX_ROWS):
                    part = batch.slice(a, min(PREFIX_ROWS, hi - a))
                    rest = pa.RecordBatch.from_arrays(
                        [part.column(c) for c in part.schema.names if c != "_run"],
                        [c for c in part.schema.names if c != "_run"])
                    if runs[a] == 0:
                        logits = pa.nulls(len(part), pa.list_(pa.float64()))
                    else:
                        block = part.column(ids_col).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                        out = np.array(scorer(block.reshape(len(part), runs[a])), dtype=np.float64)
                        if out.shape != (len(part), n_out):
                            raise ValueError(f"scorer: {out.shape} instead of {(len(part), n_out)}")
                        out[:, :N_SPECIAL] = -np.inf
                        ends = np.arange(len(part) + 1, dtype=np.int32) * n_out
                        logits = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays([*rest.columns, logits], [*rest.schema.names, out_col])

    return ranged.mapInArrow(scored_batches, schema)


def prefix_scorer(n_out: int):
    """Model factory for ``score_prefixes``: a fixed integer map over ids and positions, in eighths."""
    def make_scorer():
        import numpy as np
        v = np.arange(n_out)[None, None, :] * 13

        def score(ids):
            terms = ids[:, :, None] * 7 + np.arange(ids.shape[1])[None, :, None] * 3 + v
            return ((terms % 17) - 8).sum(axis=1) / 8.0
        return score
    return make_scorer


def legal_semijoin(scored_long: DataFrame, legal_long: DataFrame, keys=("row_id", "token_id")) -> DataFrame:
    """C5 in exploded form: keep (row, token) pairs present in the legal set
    (``left_semi`` on both keys; the in-row form is ``array_contains``)."""
    return scored_long.join(legal_long.select(*keys), list(keys), "left_semi")
