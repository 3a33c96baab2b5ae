"""Registered queries: corpus statistics and training metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.operators.events import ts_micros
from seqlake.operators.filters import corpus_filter
from seqlake.operators.ordered import running_sum
from seqlake.operators.stats import (accuracy_by_phase, book_agreement, category_distribution,
                                     completeness_by_period, key_drift, ply_index, rating_histogram,
                                     running_weighted_avg, throughput_log, token_weighted_loss)
from seqlake.plans.corpus_plans import GAME_CFG, SQL_COND, SQL_GAMES, games
from seqlake.plans.registry import register, table
from seqlake.plans.standins import SQL_DOC_TOKENS, doc_tokens

LOG_EVERY = 50


def metrics(spark, sf_dir):
    """Step metrics stand-in: epoch = return flag, step = order, rank = line number,
    loss = mean discount, tokens = quantity (aggregated first: keys repeat)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_returnflag").alias("epoch"), F.col("l_orderkey").alias("step"),
                       F.col("l_linenumber").alias("rank"))
              .agg(F.avg("l_discount").alias("loss"), F.sum("l_quantity").alias("n_tokens")))


SQL_METRICS = """m AS (SELECT l_returnflag AS epoch, l_orderkey AS step, l_linenumber AS rank,
                  avg(l_discount) AS loss, sum(l_quantity) AS n_tokens FROM lineitem GROUP BY 1, 2, 3)"""


@register("rating_histogram", f"""
WITH {SQL_GAMES}, f AS (SELECT * FROM games WHERE {SQL_COND}),
r AS (SELECT CAST(WhiteElo AS INTEGER) AS rating FROM f UNION ALL SELECT CAST(BlackElo AS INTEGER) FROM f)
SELECT (floor(rating / 100) * 100)::BIGINT AS bucket, count(*) AS n FROM r GROUP BY 1
""")
def q_rating_histogram(spark, sf_dir):
    f = corpus_filter(games(spark, sf_dir), GAME_CFG, project=None)
    f = f.select(F.col("WhiteElo").cast("int").alias("w"), F.col("BlackElo").cast("int").alias("b"))
    return rating_histogram(f, ["w", "b"], 100)


@register("category_distribution", f"""
WITH {SQL_GAMES}
SELECT Termination, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM games GROUP BY 1
""")
def q_category_distribution(spark, sf_dir):
    return category_distribution(games(spark, sf_dir), "Termination")


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_SQL_FILLED = ", ".join(f"round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}_filled" for c in LINE_COLUMNS)


@register("completeness_by_period", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, {_SQL_FILLED}
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def q_completeness_by_period(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = completeness_by_period(j, "o_orderdate", LINE_COLUMNS, "month")
    return out.withColumn("period", F.date_format("period", "yyyy-MM"))


@register("token_weighted_loss", f"""
WITH {SQL_METRICS}
SELECT epoch, round(CASE WHEN sum(n_tokens) > 0 THEN sum(loss * n_tokens) / sum(n_tokens) ELSE 0.0 END, 6) AS weighted_loss,
       sum(n_tokens)::BIGINT AS n_tokens
FROM m GROUP BY epoch
""")
def q_token_weighted_loss(spark, sf_dir):
    return token_weighted_loss(metrics(spark, sf_dir), ["epoch"], "loss", "n_tokens")


@register("running_weighted_avg", f"""
WITH {SQL_METRICS},
s AS (SELECT epoch, step, sum(loss * n_tokens) AS ln, sum(n_tokens) AS n FROM m GROUP BY 1, 2)
SELECT epoch, step,
       round(sum(ln) OVER w / sum(n) OVER w, 6) AS running_loss
FROM s WINDOW w AS (PARTITION BY epoch ORDER BY step ROWS UNBOUNDED PRECEDING)
""")
def q_running_weighted_avg(spark, sf_dir):
    """Per step (summed over ranks), Σloss·n / Σn since the epoch start."""
    per_step = (metrics(spark, sf_dir).groupBy("epoch", "step")
                .agg(F.sum(F.col("loss") * F.col("n_tokens")).alias("ln"), F.sum("n_tokens").alias("n")))
    return running_weighted_avg(per_step).select("epoch", "step", "running_loss")


@register("throughput_log", f"""
WITH ev AS (SELECT event_type AS epoch, value AS loss, json_extract(props, '$.k')::INTEGER AS n_tokens,
                   epoch_us(ts) / 1000000.0 AS ts_s,
                   row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events),
g AS (SELECT epoch, floor((step - 1) / {LOG_EVERY})::BIGINT AS log_window, sum(n_tokens)::BIGINT AS tokens,
             sum(loss * n_tokens) AS ln, min(ts_s) AS t0, max(ts_s) AS t1, max(step) AS last_step,
             round(arg_max(loss, step), 6) AS last_loss FROM ev GROUP BY 1, 2),
f AS (SELECT *, t1 - coalesce(lag(t1) OVER (PARTITION BY epoch ORDER BY log_window), t0) AS dt
      FROM g WHERE last_step = (log_window + 1) * {LOG_EVERY})
SELECT epoch, log_window, tokens, last_step, last_loss,
       round(tokens * 1 / nullif(dt, 0.0), 6) AS tok_per_s,
       round(ln / nullif(tokens, 0), 6) AS window_loss,
       round(sum(ln) OVER w / nullif(sum(tokens) OVER w, 0), 6) AS running_loss
FROM f WINDOW w AS (PARTITION BY epoch ORDER BY log_window ROWS UNBOUNDED PRECEDING)
""")
def q_throughput_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    m = ev.select(F.col("event_type").alias("epoch"), "event_id", F.col("value").alias("loss"),
                  F.from_json("props", "k int")["k"].alias("n_tokens"),
                  (ts_micros("ts") / 1e6).alias("ts_s"), ts_micros("ts").alias("ts_us"))
    m = running_sum(m, {"step": F.lit(1).cast("bigint")}, ["ts_us", "event_id"], ["epoch"])
    return throughput_log(m, LOG_EVERY).select("epoch", "log_window", "tokens", "last_step", "last_loss", "tok_per_s",
                                               "window_loss", "running_loss")


@register("accuracy_by_phase", f"""
WITH dt AS ({SQL_DOC_TOKENS}),
p AS (SELECT unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS ply FROM dt)
SELECT CASE WHEN (ply + 1) // 2 <= 10 THEN 'opening' WHEN (ply + 1) // 2 <= 25 THEN 'middlegame' ELSE 'endgame' END AS phase,
       count(*) AS n, round(avg(CASE WHEN length(token) % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM p GROUP BY 1
""")
def q_accuracy_by_phase(spark, sf_dir):
    """Plies = token positions of every text, so that all three phases occur; a token of even length counts as hit."""
    p = doc_tokens(spark, sf_dir).select(F.posexplode("tokens").alias("pos", "token"))
    return accuracy_by_phase(p.select((F.col("pos") + 1).alias("ply"), (F.length("token") % 2 == 0).alias("ok")), "ply", "ok")


@register("ply_index", """
SELECT conv_id, turn, (turn + 1)::BIGINT AS ply, ceil((turn + 1) / 2)::BIGINT AS full_move,
       CASE WHEN turn % 2 = 0 THEN 'white' ELSE 'black' END AS side_to_move
FROM conversations
""")
def q_ply_index(spark, sf_dir):
    """Moves played so far = turn; white to move iff that count is even."""
    c = table(spark, sf_dir, "conversations")
    return ply_index(c, "turn").select("conv_id", "turn", "ply", "full_move", "side_to_move")


@register("key_drift", """
WITH lk AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), ok AS (SELECT DISTINCT o_orderkey AS k FROM orders)
SELECT k AS o_orderkey, kind FROM (
  SELECT k, 'missing' AS kind FROM ok WHERE k NOT IN (SELECT k FROM lk)
  UNION ALL SELECT k, 'unexpected' FROM lk WHERE k NOT IN (SELECT k FROM ok))
WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
""")
def q_key_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    allow = o.where(F.col("o_orderstatus") == "P").select("o_orderkey")
    return key_drift(o.select("o_orderkey"), li, "o_orderkey", allow)


@register("book_agreement", f"""
WITH dt AS ({SQL_DOC_TOKENS}),
p AS (SELECT lang, array_to_string(tokens[1:3], ' ') AS pfx, tokens[4] AS nxt FROM dt WHERE len(tokens) >= 4),
book AS (SELECT DISTINCT md5(pfx) AS h, pfx, nxt FROM p WHERE lang = 'en')
SELECT p.lang, count(*) AS n, count(b.h) AS n_in_book, round(count(b.h) / count(*), 6) AS share
FROM p LEFT JOIN book b ON b.h = md5(p.pfx) AND b.pfx = p.pfx AND b.nxt = p.nxt GROUP BY p.lang
""")
def q_book_agreement(spark, sf_dir):
    """Share of (prefix -> next move) predictions found in the opening book
    (book = English openings); join on a prefix hash plus full equality."""
    dt = doc_tokens(spark, sf_dir).where(F.size("tokens") >= 4)
    p = dt.select("lang", F.slice("tokens", 1, 3).alias("pfx"), F.get("tokens", 3).alias("nxt"))
    return book_agreement(p, p.where(F.col("lang") == "en"), "lang")
