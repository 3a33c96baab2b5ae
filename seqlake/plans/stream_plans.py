"""Registered queries: Structured Streaming twins.

Each query lands ``events`` as three time-ordered slices in a fresh folder under
the shared checkpoint folder, drains the stream with ``availableNow`` and
returns the batch read of the sink, so it is compared with the same SQL as the
batch operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.plans.events_plans import COOLDOWN_US, FEED_ROUTES, SQL_DELTAS, SQL_EV
from seqlake.plans.registry import register, table
from seqlake.operators.events import ts_micros
from seqlake.session import scratch_dir
from seqlake.streaming.source import (land_in_order, land_slice, live_funnel, route_stream, run_available,
                                      slice_files, stream_corpus, stream_files)
from seqlake.streaming.state import (concurrency_stream, concurrency_stream_buffered, cooldown_stream,
                                    cooldown_stream_buffered, lifecycle_stream, lifecycle_stream_buffered)


def _landed(spark, sf_dir):
    root = scratch_dir(spark, "stream")
    ev = table(spark, sf_dir, "events")
    feed = ev.select("event_id", "user_id", "event_type", ts_micros("ts").alias("ts_us"),
                     F.from_json("props", "k int")["k"].alias("k"), "value")
    n_files = land_in_order(feed, f"{root}/src", "ts_us", 3)
    stream = stream_files(spark, f"{root}/src", feed.schema, files_per_trigger=n_files)      # a slice a batch
    return root, stream


def _sink_state(spark, root, df):
    out = f"{root}/out"
    run_available(df.writeStream.format("parquet").option("path", out).outputMode("append"), f"{root}/ck",
                  state_partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(out)


@register("stream_corpus", """
SELECT event_id, user_id, value FROM events WHERE value > 10
""")
def q_stream_corpus(spark, sf_dir):
    root, stream = _landed(spark, sf_dir)
    stream_corpus(stream, F.col("value") > 10, ["event_id", "user_id", "value"], f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out")


@register("route_events_stream", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'challenge' WHEN 'view' THEN 'gameStart'
                                 WHEN 'purchase' THEN 'gameFinish' END AS route
FROM events WHERE event_type IN ('signup', 'view', 'purchase')
""")
def q_route_events_stream(spark, sf_dir):
    root, stream = _landed(spark, sf_dir)
    route_stream(stream, "event_type", FEED_ROUTES, f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out").select("event_id", "route")


@register("live_funnel", """
SELECT event_type AS stem, count(*) AS n_rows, count(*) FILTER (WHERE value > 10) AS n_passed,
       count(*) FILTER (WHERE value > 10 AND json_extract(props, '$.k')::INTEGER >= 20) AS n_kept
FROM events GROUP BY 1
""")
def q_live_funnel(spark, sf_dir):
    root, stream = _landed(spark, sf_dir)
    live_funnel(stream.withColumnRenamed("event_type", "stem"), "stem", F.col("value") > 10, F.col("k") >= 20,
                f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out")


@register("cooldown_stream", f"""
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
def q_cooldown_stream(spark, sf_dir):
    root, stream = _landed(spark, sf_dir)
    out = cooldown_stream(stream, "user_id", "ts_us", "event_id", COOLDOWN_US)
    return _sink_state(spark, root, out).select("event_id", "user_id")


@register("live_concurrency", f"""
WITH {SQL_DELTAS}
SELECT user_id, k, ts_us, delta,
       sum(delta) OVER (PARTITION BY user_id ORDER BY ts_us, k ROWS UNBOUNDED PRECEDING)::BIGINT AS active
FROM d
""")
def q_live_concurrency(spark, sf_dir):
    root, stream = _landed(spark, sf_dir)
    # the stand-in's few game numbers come back all the time: a game is remembered for longer than the feed lasts
    out = concurrency_stream(stream, "user_id", "k", "ts_us", "event_type", "view", "purchase", ttl_us=10 ** 16)
    return _sink_state(spark, root, out).select("user_id", "k", "ts_us", "delta", "active")


@register("game_lifecycle_stream", f"""
WITH {SQL_EV},
c AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts_us * 2 + k % 2 END)
                  OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS enc,
                max(CASE WHEN event_type IN ('error', 'purchase') THEN ts_us END)
                  OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS ended FROM ev)
SELECT event_id, user_id, CASE WHEN enc % 2 = 0 THEN 'white' ELSE 'black' END AS color FROM c
WHERE enc IS NOT NULL AND (ended IS NULL OR ended < enc // 2)
  AND event_type IN ('signup', 'view', 'click')
  AND ((enc % 2 = 0 AND k % 2 = 0) OR (enc % 2 = 1 AND k % 2 = 1))
""")
def q_game_lifecycle_stream(spark, sf_dir):
    root, stream = _landed(spark, sf_dir)
    out = lifecycle_stream(stream, "user_id", "ts_us", "event_id", "event_type", "k",
                           "signup", ("view", "click"), ("error", "purchase"))
    return _sink_state(spark, root, out).select("event_id", "user_id", "color")


def _landed_scrambled(spark, sf_dir):
    """Events landing out of event-time order (slices 2, 0, 3, 1), then a clock
    record on key -1 that moves event time forward, as time passing does on a
    live feed, so every buffer is released at the end of the replay."""
    root = scratch_dir(spark, "stream-ooo")
    ev = table(spark, sf_dir, "events")
    feed = ev.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
                     ts_micros("ts").alias("ts_us"), F.from_json("props", "k int")["k"].alias("k"))
    lo, hi, rows = feed.agg(F.min("ts_us"), F.max("ts_us"), F.count("ts_us")).first()
    step = (hi - lo) // 4 + 1
    n_files = slice_files(spark, rows // 4)
    for i in (2, 0, 3, 1):
        land_slice(feed.where((F.col("ts_us") >= lo + i * step) & (F.col("ts_us") < lo + (i + 1) * step)),
                   f"{root}/src", n_files)
    clock = (spark.createDataFrame([(-1, -1, "clock", 0)], "event_id long, user_id long, event_type string, k int")
                  .withColumn("ts", F.lit("2100-01-01 00:00:00").cast("timestamp")))  # stream-control record
    clock.withColumn("ts_us", ts_micros("ts")).select(*feed.columns).write.mode("append").parquet(f"{root}/src")
    return root, stream_files(spark, f"{root}/src", feed.schema, files_per_trigger=n_files)   # a slice a batch


LATENESS = "31 days"   # more than the disorder of the scrambled landing


@register("cooldown_stream_buffered", f"""
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
def q_cooldown_stream_buffered(spark, sf_dir):
    """J4 with out-of-order files: rows wait in keyed state until the watermark passes them."""
    root, stream = _landed_scrambled(spark, sf_dir)
    out = cooldown_stream_buffered(stream, "user_id", "ts", "ts_us", "event_id", COOLDOWN_US, LATENESS)
    res = _sink_state(spark, root, out)
    return res.where((F.col("user_id") >= 0) & (F.col("status") == "emitted")).select("event_id", "user_id")


@register("live_concurrency_buffered", f"""
WITH {SQL_DELTAS}
SELECT user_id, k, ts_us, delta,
       sum(delta) OVER (PARTITION BY user_id ORDER BY ts_us, k ROWS UNBOUNDED PRECEDING)::BIGINT AS active
FROM d
""")
def q_live_concurrency_buffered(spark, sf_dir):
    """J5 with out-of-order files (event-time fold)."""
    root, stream = _landed_scrambled(spark, sf_dir)
    out = concurrency_stream_buffered(stream, "user_id", "k", "ts", "ts_us", "event_type", "view", "purchase",
                                      LATENESS)
    res = _sink_state(spark, root, out)
    return res.where((F.col("user_id") >= 0) & (F.col("status") == "ok")) \
              .select("user_id", "k", "ts_us", "delta", "active")


@register("game_lifecycle_buffered", f"""
WITH {SQL_EV},
c AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts_us * 2 + k % 2 END)
                  OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS enc,
                max(CASE WHEN event_type IN ('error', 'purchase') THEN ts_us END)
                  OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS ended FROM ev)
SELECT event_id, user_id, CASE WHEN enc % 2 = 0 THEN 'white' ELSE 'black' END AS color FROM c
WHERE enc IS NOT NULL AND (ended IS NULL OR ended < enc // 2)
  AND event_type IN ('signup', 'view', 'click')
  AND ((enc % 2 = 0 AND k % 2 = 0) OR (enc % 2 = 1 AND k % 2 = 1))
""")
def q_game_lifecycle_buffered(spark, sf_dir):
    """J3 with out-of-order files (event-time fold)."""
    root, stream = _landed_scrambled(spark, sf_dir)
    out = lifecycle_stream_buffered(stream, "user_id", "ts", "ts_us", "event_id", "event_type", "k",
                                    "signup", ("view", "click"), ("error", "purchase"), LATENESS)
    res = _sink_state(spark, root, out)
    return res.where((F.col("user_id") >= 0) & (F.col("status") == "due")).select("event_id", "user_id", "color")
