"""Registered queries: scoring, sampling and evaluation over ``embeddings``
(a 64-wide logit vector per row; legal ids = positions with ``pos % 10 <> label``)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators.scoring import (greedy_legal, illegal_and_confidence, low_confidence, legal_semijoin, linear_scorer,
                                       parity_join, parity_summary, sample_legal, sample_topk,
                                       scored, strategy, topk_accuracy, topk_legal)
from seqlake.plans.registry import register, table

SEED = 42
K_TOP, T_TOP = 5, 1.0        # inference defaults
K_BOT, T_BOT = 3, 0.6        # bot defaults
N_OUT = 16


def scoring_rows(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    legal = F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i % 10 != F.col("label"))
    return emb.select("vec_id", "label", F.col("embedding").alias("logits"), legal.alias("legal"))


SQL_E = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS logit,
                unnest(range(0, len(embedding)))::INTEGER AS id FROM embeddings),
s AS (SELECT *, id % 10 <> label AS legal FROM e WHERE id >= 4)"""


def sql_probs(t: float) -> str:
    return f"""pr AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY vec_id)) / {t}) AS w FROM s),
pp AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM pr)"""


def sql_u(col: str = "vec_id") -> str:
    return f"(('0x' || substr(md5('{SEED}:' || {col}), 1, 8))::BIGINT / 4294967296.0)"


@register("greedy_legal", f"""
WITH {SQL_E}
SELECT vec_id, first(id ORDER BY logit DESC, id DESC) FILTER (WHERE legal) AS token_id FROM s GROUP BY vec_id
""")
def q_greedy_legal(spark, sf_dir):
    r = scoring_rows(spark, sf_dir)
    return r.select("vec_id", greedy_legal("logits", "legal").alias("token_id"))


SQL_TOPK = f"""{SQL_E}, {sql_probs(T_TOP)},
tk AS (SELECT vec_id, id, p, logit, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, id DESC) AS rnk
       FROM pp WHERE legal)"""


@register("topk_legal", f"""
WITH {SQL_TOPK}
SELECT vec_id, rnk::INTEGER AS rnk, id AS token_id, round(p, 6) AS p FROM tk WHERE rnk <= {K_TOP}
""")
def q_topk_legal(spark, sf_dir):
    r = scoring_rows(spark, sf_dir)
    top = r.select("vec_id", F.posexplode(topk_legal("logits", "legal", K_TOP, T_TOP)).alias("rnk", "c"))
    return top.select("vec_id", (F.col("rnk") + 1).alias("rnk"), F.col("c.id").alias("token_id"),
                      F.round("c.p", 6).alias("p"))


@register("sample_legal", f"""
WITH {SQL_E}, {sql_probs(T_BOT)},
c AS (SELECT vec_id, id, w, sum(w) OVER (PARTITION BY vec_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS cum,
             sum(w) OVER (PARTITION BY vec_id) AS tot FROM pr WHERE legal)
SELECT vec_id, min(id) FILTER (WHERE cum > {sql_u()} * tot) AS token_id FROM c GROUP BY vec_id
""")
def q_sample_legal(spark, sf_dir):
    r = scoring_rows(spark, sf_dir)
    return r.select("vec_id", sample_legal("logits", "legal", T_BOT, SEED, "vec_id").alias("token_id"))


SQL_TOPK_BOT = f"""{SQL_E}, {sql_probs(T_BOT)},
tk AS (SELECT vec_id, id, p, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, id DESC) AS rnk
       FROM pp WHERE legal),
c AS (SELECT vec_id, id, rnk, sum(p) OVER (PARTITION BY vec_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS cum,
             sum(p) OVER (PARTITION BY vec_id) AS tot FROM tk WHERE rnk <= {K_BOT}),
pick AS (SELECT vec_id, arg_min(id, rnk) FILTER (WHERE cum > {sql_u()} * tot) AS token_id FROM c GROUP BY vec_id)"""


@register("sample_topk", f"WITH {SQL_TOPK_BOT} SELECT vec_id, token_id FROM pick")
def q_sample_topk(spark, sf_dir):
    r = scoring_rows(spark, sf_dir)
    return r.select("vec_id", sample_topk("logits", "legal", K_BOT, T_BOT, SEED, "vec_id").alias("token_id"))


@register("strategy", f"""
WITH {SQL_TOPK_BOT},
g AS (SELECT vec_id, first(id ORDER BY logit DESC, id DESC) FILTER (WHERE legal) AS gid FROM s GROUP BY vec_id),
c2 AS (SELECT vec_id, id, w, sum(w) OVER (PARTITION BY vec_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS cum,
              sum(w) OVER (PARTITION BY vec_id) AS tot FROM pr WHERE legal),
smp AS (SELECT vec_id, min(id) FILTER (WHERE cum > {sql_u()} * tot) AS sid FROM c2 GROUP BY vec_id)
SELECT e.vec_id, CASE e.label % 3 WHEN 0 THEN 'greedy' WHEN 1 THEN 'sample' ELSE 'top_k' END AS mode,
       CASE e.label % 3 WHEN 0 THEN g.gid WHEN 1 THEN smp.sid ELSE pick.token_id END AS token_id
FROM embeddings e JOIN g USING (vec_id) JOIN smp USING (vec_id) JOIN pick USING (vec_id)
""")
def q_strategy(spark, sf_dir):
    r = scoring_rows(spark, sf_dir)
    mode = (F.when(F.col("label") % 3 == 0, F.lit("greedy"))
             .when(F.col("label") % 3 == 1, F.lit("sample")).otherwise(F.lit("top_k")))
    r = r.withColumn("mode", mode)
    return r.select("vec_id", "mode",
                    strategy(F.col("mode"), "logits", "legal", T_BOT, K_BOT, SEED, "vec_id").alias("token_id"))


@register("legal_semijoin", f"""
WITH {SQL_E}
SELECT vec_id, id AS token_id FROM s WHERE logit > 0 AND legal
""")
def q_legal_semijoin(spark, sf_dir):
    r = scoring_rows(spark, sf_dir)
    cands = r.select("vec_id", F.explode(scored("logits")).alias("s")).where(F.col("s.logit") > 0) \
             .select("vec_id", F.col("s.id").alias("token_id"))
    legal = r.select("vec_id", F.explode("legal").alias("token_id"))
    return legal_semijoin(cands, legal, ["vec_id", "token_id"])


@register("topk_accuracy", f"""
WITH {SQL_E},
t AS (SELECT vec_id, label, id % 10 AS cls, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, id DESC) AS rnk FROM s)
SELECT count(DISTINCT vec_id) AS n,
       round(count(*) FILTER (WHERE rnk = 1 AND cls = label) / count(DISTINCT vec_id), 6) AS top1_acc,
       round(count(DISTINCT vec_id) FILTER (WHERE rnk <= 5 AND cls = label) / count(DISTINCT vec_id), 6) AS topk_acc
FROM t
""")
def q_topk_accuracy(spark, sf_dir):
    r = scoring_rows(spark, sf_dir)
    return topk_accuracy(r, "logits", F.col("label"), klass=lambda i: i % 10, k=5)


@register("illegal_rate", f"""
WITH {SQL_E}, {sql_probs(1.0)},
t AS (SELECT vec_id, first(legal ORDER BY logit DESC, id DESC) AS legal1, max(p) AS p1 FROM pp GROUP BY vec_id)
SELECT count(*) AS n, round(avg(CASE WHEN legal1 THEN 0.0 ELSE 1.0 END), 6) AS illegal_rate,
       count(*) FILTER (WHERE p1 < 0.05) AS n_low_conf FROM t
""")
def q_illegal_rate(spark, sf_dir):
    return illegal_and_confidence(scoring_rows(spark, sf_dir), "logits", "legal", 0.05)


@register("low_confidence", f"""
WITH {SQL_E}, {sql_probs(1.0)},
t AS (SELECT vec_id, max(p) AS p1 FROM pp GROUP BY vec_id)
SELECT vec_id, round(p1, 6) AS p1 FROM t WHERE p1 < 0.0225
""")
def q_low_confidence(spark, sf_dir):
    low = low_confidence(scoring_rows(spark, sf_dir), "logits", 0.0225, ["vec_id"])
    return low.withColumn("p1", F.round("p1", 6))


def _pairs(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    a = emb.select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")) \
           .withColumn("v", F.col("v").cast("double"))
    # each side lacks some positions of the other
    one = (F.col("vec_id") * 7 + F.col("pos")) % 97
    b = a.where(one != 3).withColumn("v", F.round("v", 2))
    return parity_join(a.where(one != 5), b, ["vec_id", "pos", "label"])


SQL_PAIRS = """a AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS a FROM embeddings),
pairs AS (SELECT vec_id, label, pos, CASE WHEN (vec_id * 7 + pos) % 97 <> 5 THEN a END AS a,
                 CASE WHEN (vec_id * 7 + pos) % 97 <> 3 THEN round(a, 2) END AS b FROM a)"""


@register("parity_join", f"""
WITH {SQL_PAIRS}
SELECT vec_id, count(*) AS n_pairs, count(*) FILTER (a IS NULL OR b IS NULL) AS n_unmatched, round(max(abs(a - b)), 6) AS max_abs_diff
FROM pairs GROUP BY vec_id
""")
def q_parity_join(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.groupBy("vec_id").agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("matched")).alias("n_unmatched"),
                                   F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("max_abs_diff"))


@register("parity_summary", f"""
WITH {SQL_PAIRS}
SELECT label, round(max(d), 6) AS max_abs_diff, bool_and(close) AS allclose, bool_and(top1) AS top1_match,
       bool_and(close) OR bool_and(top1) AS pass
FROM (SELECT label, vec_id, max(abs(a - b)) AS d, bool_and(coalesce(abs(a - b) <= 1e-4 + 1e-4 * abs(b), false)) AS close,
             list(pos ORDER BY a DESC NULLS LAST, pos DESC)[1] = list(pos ORDER BY b DESC NULLS LAST, pos DESC)[1] AS top1
      FROM pairs GROUP BY label, vec_id) GROUP BY label
""")
def q_parity_summary(spark, sf_dir):
    return parity_summary(_pairs(spark, sf_dir), ["label"], ["vec_id"])


@register("batch_scorer", f"""
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS j FROM embeddings),
o AS (SELECT vec_id, i, sum(v * ((((i * 7 + j * 13) % 17) - 8) / 8.0)) AS logit
      FROM x, range({N_OUT}) r(i) GROUP BY vec_id, i)
SELECT vec_id, arg_max(i, (logit, i))::INTEGER AS top_id, round(max(logit), 4) AS top_logit FROM o GROUP BY vec_id
""")
def q_batch_scorer(spark, sf_dir):
    from pyspark.ml.functions import predict_batch_udf
    score = predict_batch_udf(linear_scorer(N_OUT), return_type=T.ArrayType(T.DoubleType()),
                              batch_size=1024, input_tensor_shapes=[[64]])
    emb = table(spark, sf_dir, "embeddings")
    out = emb.select("vec_id", score(F.col("embedding")).alias("logits"))
    best = F.array_max(F.transform("logits", lambda x, i: F.struct(x.alias("l"), i.alias("i"))))
    return out.select("vec_id", best["i"].alias("top_id"), F.round(best["l"], 4).alias("top_logit"))
