"""Registered queries: event feed in batch form — sessions, admission,
candidates, carried state, lifecycle, cooldown, routing (SURVEY §2.11, B9, B10, E4, E5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.operators.events import (active_sessions, admission_decision, candidate_filter,
                                      carry_last, cooldown, game_deltas, game_lifecycle, route_events,
                                      ts_micros)
from seqlake.plans.registry import register, table

COOLDOWN_US = 6 * 3600 * 1_000_000      # stand-in for the bot's 120 s: 6 h between events
ACCEPT_VARIANTS = ["view", "click", "purchase", "signup"]
# Fixed stand-in routing: signup = challenge, view = gameStart, purchase = gameFinish.
FEED_ROUTES = {"signup": "challenge", "view": "gameStart", "purchase": "gameFinish"}


def feed(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", "event_type", ts_micros("ts").alias("ts_us"),
                     F.from_json("props", "k int")["k"].alias("k"))


SQL_EV = """ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us,
                   json_extract(props, '$.k')::INTEGER AS k FROM events)"""
SQL_DELTAS = f"""{SQL_EV},
st AS (SELECT user_id, k, min(ts_us) AS s FROM ev WHERE event_type = 'view' GROUP BY 1, 2),
en AS (SELECT st.user_id, st.k, min(ev.ts_us) AS e FROM st JOIN ev
         ON ev.user_id = st.user_id AND ev.k = st.k AND ev.event_type = 'purchase' AND ev.ts_us > st.s
       GROUP BY 1, 2),
d AS (SELECT user_id, k, s AS ts_us, 1 AS delta FROM st UNION ALL SELECT user_id, k, e, -1 FROM en)"""


def deltas(spark, sf_dir):
    f = feed(spark, sf_dir)
    return game_deltas(f.where(F.col("event_type") == "view"), f.where(F.col("event_type") == "purchase"),
                       "user_id", "k", "ts_us")


@register("active_sessions", f"""
WITH {SQL_DELTAS}
SELECT user_id, k, ts_us, delta,
       sum(delta) OVER (PARTITION BY user_id ORDER BY ts_us, k ROWS UNBOUNDED PRECEDING)::BIGINT AS active
FROM d
""")
def q_active_sessions(spark, sf_dir):
    return active_sessions(deltas(spark, sf_dir), "user_id", ["ts_us", "k"]).select(
        "user_id", "k", "ts_us", "delta", "active")


@register("admission_decision", f"""
WITH {SQL_DELTAS},
u AS (SELECT user_id, ts_us, 1 AS kind, k, -1 AS event_id, delta, NULL AS event_type FROM d
      UNION ALL SELECT user_id, ts_us, 0, k, event_id, 0, event_type FROM ev),
a AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts_us, kind, k, event_id ROWS UNBOUNDED PRECEDING) AS active FROM u)
SELECT event_id,
       CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'variant'
            WHEN k % 2 = 0 THEN 'rated' WHEN active >= 1 THEN 'later' ELSE '' END = '' AS accept,
       CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'variant'
            WHEN k % 2 = 0 THEN 'rated' WHEN active >= 1 THEN 'later' ELSE '' END AS reason
FROM a WHERE kind = 0
""")
def q_admission_decision(spark, sf_dir):
    f = feed(spark, sf_dir)
    d = deltas(spark, sf_dir).select("user_id", "ts_us", F.lit(1).alias("kind"), "k",
                                     F.lit(-1).cast("bigint").alias("event_id"), "delta",
                                     F.lit(None).cast("string").alias("event_type"))
    ch = f.select("user_id", "ts_us", F.lit(0).alias("kind"), "k", "event_id",
                  F.lit(0).alias("delta"), "event_type")
    act = active_sessions(d.unionByName(ch), "user_id", ["ts_us", "kind", "k", "event_id"])
    dec = admission_decision(F.col("event_type"), F.col("k") % 2 == 1, F.col("active"),
                             ACCEPT_VARIANTS, accept_rated=True, accept_casual=False, max_active=1)
    return act.where(F.col("kind") == 0).select("event_id", dec["accept"].alias("accept"),
                                                 dec["reason"].alias("reason"))


@register("candidate_filter", """
SELECT c_custkey FROM customer
WHERE c_custkey <> 0 AND NOT coalesce(c_acctbal < 0, false)
  AND c_custkey NOT IN (SELECT o_custkey FROM orders
                        WHERE epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(o_orderdate) < 2592000000000::BIGINT)
""")
def q_candidate_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", ts_micros("o_orderdate").alias("t"))
    now = orders.agg(F.max("t")).first()[0]       # one scalar: the clock of this run
    cool = orders.where(F.lit(now) - F.col("t") < F.lit(30 * 86400 * 1_000_000)) \
                 .select(F.col("o_custkey").alias("c_custkey"))
    cust = table(spark, sf_dir, "customer")
    return candidate_filter(cust, "c_custkey", 0, cool, disabled=F.col("c_acctbal") < 0).select("c_custkey")


@register("carry_state", f"""
WITH {SQL_EV},
c AS (SELECT event_id, user_id,
             last_value(CASE WHEN event_type = 'signup' THEN k % 2 END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS bit FROM ev)
SELECT event_id, user_id, CASE bit WHEN 0 THEN 'white' WHEN 1 THEN 'black' END AS color FROM c
""")
def q_carry_state(spark, sf_dir):
    f = feed(spark, sf_dir)
    out = carry_last(f, "user_id", ["ts_us", "event_id"],
                     F.when(F.col("event_type") == "signup", F.col("k") % 2), "bit")
    color = F.when(F.col("bit") == 0, F.lit("white")).when(F.col("bit") == 1, F.lit("black"))
    return out.select("event_id", "user_id", color.alias("color"))


# the last full-state or end event of each key so far, and whether it leaves the game open
SQL_LIFECYCLE = """c AS (
  SELECT *, last_value(CASE WHEN event_type = 'signup' THEN k % 2 END IGNORE NULLS) OVER w AS bit,
         last_value(CASE WHEN event_type = 'signup' THEN true WHEN event_type IN ('error', 'purchase') THEN false END IGNORE NULLS)
           OVER w AS live
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, CASE WHEN bit = 0 THEN 'white' ELSE 'black' END AS color FROM c
WHERE bit IS NOT NULL AND live AND event_type IN ('signup', 'view', 'click') AND bit = k % 2"""


@register("game_lifecycle", f"""
WITH {SQL_EV},
{SQL_LIFECYCLE}
""")
def q_game_lifecycle(spark, sf_dir):
    due = game_lifecycle(feed(spark, sf_dir), "user_id", ["ts_us", "event_id"], "event_type", "k", "ts_us",
                         "signup", ("view", "click"), ("error", "purchase"))
    return due.select("event_id", "user_id", "color")


@register("cooldown", f"""
WITH RECURSIVE {SQL_EV},
o AS (SELECT user_id, event_id, ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS rn FROM ev),
f(user_id, rn, event_id, last, emit) AS (
  SELECT user_id, rn, event_id, ts_us, true FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.rn, o.event_id,
         CASE WHEN o.ts_us - f.last >= {COOLDOWN_US} THEN o.ts_us ELSE f.last END,
         o.ts_us - f.last >= {COOLDOWN_US}
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT event_id, user_id FROM f WHERE emit
""")
def q_cooldown(spark, sf_dir):
    return cooldown(feed(spark, sf_dir), "user_id", "ts_us", "event_id", COOLDOWN_US).select("event_id", "user_id")


@register("route_events", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'challenge' WHEN 'view' THEN 'gameStart'
                                 WHEN 'purchase' THEN 'gameFinish' END AS route
FROM events WHERE event_type IN ('signup', 'view', 'purchase')
""")
def q_route_events(spark, sf_dir):
    return route_events(feed(spark, sf_dir), "event_type", FEED_ROUTES).select("event_id", "route")
