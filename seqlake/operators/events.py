"""Event-feed operators in batch form.

The streaming twins live in ``seqlake.streaming``; both are checked against the
same SQL.  Running state per key (open games, colour, last emission) never
gathers a key into one task: running counts use the block-parallel segmented
scan, the cooldown fold uses the same pinned blocks with a per-block carry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators.ordered import BLOCK, pin_blocks, running_sum

# Routing of feed event types and the decline reasons.
DECLINE_VARIANT, DECLINE_CASUAL, DECLINE_RATED, DECLINE_LATER = "variant", "casual", "rated", "later"


def ts_micros(c) -> Column:
    """TIMESTAMP_NTZ -> microseconds since 1970-01-01 00:00, independent of the
    session time zone (a wall-clock difference, no zone conversion)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            col.cast("timestamp_ntz"))


def route_events(df: DataFrame, type_col: str, mapping: dict) -> DataFrame:
    """J2 (batch): tag each event with its route; unknown types are ignored."""
    expr = None
    for src, route in mapping.items():
        expr = F.when(F.col(type_col) == src, F.lit(route)) if expr is None \
            else expr.when(F.col(type_col) == src, F.lit(route))
    return df.withColumn("route", expr).where(F.col("route").isNotNull())


def game_deltas(starts: DataFrame, ends: DataFrame, owner: str, game: str, ts: str) -> DataFrame:
    """E4 input: +1 at each game's first start event, -1 at its first end event
    after the start (set semantics: a repeated start counts once)."""
    first_start = starts.groupBy(owner, game).agg(F.min(ts).alias("_s"))
    first_end = (ends.select(owner, game, F.col(ts).alias("_e"))
                     .join(first_start, [owner, game])
                     .where(F.col("_e") > F.col("_s"))
                     .groupBy(owner, game).agg(F.min("_e").alias("_e")))
    plus = first_start.select(owner, game, F.col("_s").alias(ts), F.lit(1).alias("delta"))
    minus = first_end.select(owner, game, F.col("_e").alias(ts), F.lit(-1).alias("delta"))
    return plus.unionByName(minus)


def active_sessions(deltas: DataFrame, owner: str, order_cols, max_active: int | None = None) -> DataFrame:
    """Open games per owner after each delta (running sum in time order);
    ``open_slots = max_active - active`` when a limit is given."""
    out = running_sum(deltas, {"active": F.col("delta").cast("bigint")}, order_cols, [owner])
    if max_active is not None:
        out = out.withColumn("open_slots", F.lit(max_active) - F.col("active"))
    return out


def admission_decision(variant: Column, rated: Column, active: Column, accept_variants,
                       accept_rated: bool = True, accept_casual: bool = True,
                       max_active: int = 1) -> Column:
    """Ordered rules -> struct(accept, reason).  Missing variant = standard,
    missing rated = false; reason '' when accepted."""
    v = F.coalesce(variant, F.lit("standard"))
    r = F.coalesce(rated, F.lit(False))
    reason = (F.when(~v.isin(*accept_variants), F.lit(DECLINE_VARIANT))
               .when(r & F.lit(not accept_rated), F.lit(DECLINE_CASUAL))
               .when(~r & F.lit(not accept_casual), F.lit(DECLINE_RATED))
               .when(F.coalesce(active, F.lit(0)) >= max_active, F.lit(DECLINE_LATER))
               .otherwise(F.lit("")))
    return F.struct((reason == "").alias("accept"), reason.alias("reason"))


def candidate_filter(cands: DataFrame, id_col: str, my_id, cooldown: DataFrame,
                     disabled: Column | None = None) -> DataFrame:
    """Not self, not cooling down (anti join), not disabled (missing = false)."""
    out = cands.where(F.col(id_col) != F.lit(my_id))
    if disabled is not None:
        out = out.where(~F.coalesce(disabled, F.lit(False)))
    return out.join(cooldown.select(id_col).distinct(), id_col, "left_anti")


def anti_join_cooldown(cands: DataFrame, cooling: DataFrame, id_col: str) -> DataFrame:
    """C4: candidates not in the cooldown set (``left_anti``)."""
    return cands.join(cooling.select(id_col).distinct(), id_col, "left_anti")


def _tagged(order_cols, value: Column) -> Column:
    """``(order, value)``: its running maximum is the last one seen, ties on the time settled by the later columns."""
    return F.struct(F.struct(*[F.col(c) for c in order_cols]).alias("o"), value.alias("v"))


def carry_last(df: DataFrame, key: str, order_cols, value: Column, name: str = "carried") -> DataFrame:
    """E5: the last non-null ``value`` seen so far per key, in order; NULL until set.

    ``last(x, ignoreNulls)`` over a per-key window, expressed as a running max
    of ``(order columns, value)`` so the block-parallel scan applies."""
    out = running_sum(df, {"_last": F.when(value.isNotNull(), _tagged(order_cols, value))}, order_cols, [key], how="max")
    return out.withColumn(name, F.col("_last.v")).drop("_last")


def game_lifecycle(df: DataFrame, key: str, order_cols, type_col: str, moves: str, ts_us: str,
                   full_type: str, state_types, end_types) -> DataFrame:
    """J3 (batch): the latest full-state event fixes the colour (white iff its
    move count is even); an end event after it closes the game; every full or
    state event of a live game where it is our move is a "turn due" row.
    Two block-parallel running maxima carry the state, so a hot key is split."""
    full = F.when(F.col(type_col) == full_type, _tagged(order_cols, (F.col(moves) % 2).cast("int")))
    end = F.when(F.col(type_col).isin(*end_types), F.struct(*[F.col(c) for c in order_cols]))
    s = running_sum(df, {"_full": full, "_end": end}, order_cols, [key], how="max")
    white = F.col("_full.v") == 0
    live = F.col("_full").isNotNull() & (F.col("_end").isNull() | (F.col("_end") < F.col("_full.o")))
    due = live & F.col(type_col).isin(full_type, *state_types) & ((F.col(moves) % 2 == 0) == white)
    return (s.where(due).withColumn("color", F.when(white, F.lit("white")).otherwise(F.lit("black")))
             .drop("_full", "_end"))


# -- J4 cooldown: exact fold, block-parallel ------------------------------------

#: Head rows (possible entries of blocks that a key runs into) that the driver takes; more are joined in Spark.
HEAD_ROWS = 100_000


def _next(t: np.ndarray, gap: int) -> np.ndarray:
    """For each event the first one at least ``gap`` later (``n``, the end, follows itself)."""
    n = len(t)
    return np.append(np.maximum(np.searchsorted(t, t + gap, side="left"), np.arange(1, n + 1)), n)


def _exits(t: np.ndarray, gap: int) -> np.ndarray:
    """Time of the last emission if each event is emitted, by doubling the pointers."""
    nxt, last = _next(t, gap), np.arange(len(t) + 1)
    last = np.where(nxt == len(t), last, nxt)
    while (last[last] != last).any():
        last = last[last]
    return t[last[:-1]]


def _emitted(t: np.ndarray, gap: int, first: int) -> np.ndarray:
    """Indexes of the events emitted from ``first`` on: twice as many each time."""
    jump, reach = _next(t, gap), np.array([first])
    while reach[-1] != len(t):
        reach, jump = np.unique(np.concatenate([reach, jump[reach]])), jump[jump]
    return reach[:-1]


def _per_block(work):
    """``work(block, frame)`` over whole blocks of a partition."""
    def fn(batches):
        frames: dict[int, list] = {}
        for pdf in batches:
            for blk, part in pdf.groupby(BLOCK, sort=False):
                frames.setdefault(int(blk), []).append(part)
        for blk, parts in frames.items():
            yield work(blk, pd.concat(parts))
    return fn


def _head(t: np.ndarray, gap: int) -> np.ndarray:
    """Events that can be a block's first emission of a key that runs into it."""
    return t[:int(np.searchsorted(t, t[0] + gap, side="left")) + 1]


def _cool_summary(gap: int, key: str, ts: str):
    def work(blk, pdf):
        keys, t = pdf[key].to_numpy(), pdf[ts].to_numpy().astype(np.int64)
        first, last = keys[0], keys[-1]
        head, tail = t[keys == first], t[keys == last]
        return pd.DataFrame({BLOCK: [blk], "first_key": [first], "last_key": [last], "single": [bool(first == last)],
                             "n_head": [len(_head(head, gap))], "head_exit": [int(_exits(head, gap)[0])],
                             "tail_exit": [int(_exits(tail, gap)[0])], "tail_start": [int(tail[0])]})
    return _per_block(work)


def _cool_portals(gap: int, key: str, ts: str, continuing: set):
    """The head rows of blocks that their first key continues into: time and last emission from there."""
    def work(blk, pdf):
        keys, t = pdf[key].to_numpy(), pdf[ts].to_numpy().astype(np.int64)
        own = t[keys == keys[0]] if blk in continuing else t[:0]
        n = len(_head(own, gap)) if len(own) else 0
        return pd.DataFrame({BLOCK: np.full(n, blk, np.int32), key: keys[:n], "t": own[:n],
                             "exit": _exits(own, gap)[:n] if n else own[:n]}).drop_duplicates("t")
    return _per_block(work)


def _cool_pass_b(gap: int, key: str, ts: str, entries: dict):
    """``entries``: for blocks that a key continues into, the time of its first emission there (None: it has none)."""
    def work(blk, pdf):
        keys, t = pdf[key].to_numpy(), pdf[ts].to_numpy().astype(np.int64)
        emit = np.zeros(len(pdf), dtype=bool)
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            seg, first = t[a:b], 0
            if a == 0 and blk in entries:
                first = b - a if entries[blk] is None else int(np.searchsorted(seg, entries[blk], side="left"))
            emit[a + _emitted(seg, gap, first)] = True
        return pdf.assign(emitted=emit)
    return _per_block(work)


def _walk(summary, portals: dict, gap: int) -> dict:
    """Entries of continuing blocks, block after block, from the heads that the driver holds."""
    entries, prev_key, prev_exit = {}, None, None
    for r in summary:
        exit_ = r["head_exit"]
        if prev_key is not None and r["first_key"] == prev_key:
            t, exits = portals[r[BLOCK]]
            j = int(np.searchsorted(t, prev_exit + gap, side="left"))
            entries[r[BLOCK]] = int(t[j]) if j < len(t) else None
            exit_ = int(exits[j]) if j < len(t) else prev_exit
        prev_exit = exit_ if r["single"] else r["tail_exit"]
        prev_key = r["last_key"]
    return entries


def _lifted(spark, pinned: DataFrame, portals: DataFrame, summary, continuing: set, key: str, ts: str, gap: int) -> dict:
    """The same entries by binary lifting in Spark, for heads of any size; one row per block reaches the driver.

    Every possible first emission points to the next event of its key that is late enough for its block's last
    emission; what is reached from the keys' starts is found by doubling these pointers."""
    kt = pinned.schema[key].dataType.simpleString()
    spanning = [(r["first_key"],) for r in summary if r[BLOCK] in continuing]           # at most one a block
    keys = F.broadcast(spark.createDataFrame(spanning, f"{key} {kt}").distinct())
    starts, before = [], None
    for r, after in zip(summary, [*summary[1:], None]):
        fresh = not r["single"] or r[BLOCK] not in continuing
        if fresh and after is not None and after[BLOCK] in continuing:
            starts.append((r[BLOCK], r["last_key"], r["tail_start"], r["tail_exit"]))
    portals = portals.select(BLOCK, key, "t", "exit").unionByName(
        spark.createDataFrame(starts, f"{BLOCK} int, {key} {kt}, t long, exit long"))
    # the earliest event at or after exit + gap: a running maximum over falling times, events before questions
    events = pinned.join(keys, key).select(
        key, (-F.col(ts)).alias("at"), F.lit(0).alias("asks"), F.struct((-F.col(ts)).alias("t"), (-F.col(BLOCK)).alias("b")).alias("met"),
        F.lit(None).cast("int").alias("from_b"), F.lit(None).cast("bigint").alias("from_t"))
    asks = portals.select(key, (-(F.col("exit") + gap)).alias("at"), F.lit(1).alias("asks"),
                          F.lit(None).cast("struct<t:bigint,b:int>").alias("met"), F.col(BLOCK).alias("from_b"), F.col("t").alias("from_t"))
    found = running_sum(events.union(asks), {"hit": "met"}, ["at", "asks", "from_b", "from_t"], [key], how="max")
    here, there = [key, "from_b", "from_t"], [key, "to_b", "to_t"]
    jump = found.where("asks = 1 AND hit IS NOT NULL").select(
        *here, (-F.col("hit.b")).alias("to_b"), (-F.col("hit.t")).alias("to_t")).checkpoint()
    first = spark.createDataFrame([x[:3] for x in starts], f"from_b int, {key} {kt}, from_t long").select(*here)
    # a block in which a key starts may be one that another key runs into: only places jumped to are entries
    reached = first.join(jump, here).select(*there).checkpoint()
    for _ in range(max(1, len(summary).bit_length())):
        again = reached.toDF(*here).join(jump, here).select(*there)
        reached = reached.union(again).distinct().checkpoint()
        then = jump.toDF(*there, "b", "t")
        jump = jump.join(then, there).select(*here, F.col("b").alias("to_b"), F.col("t").alias("to_t")).checkpoint()
    first = {r.b: r.t for r in reached.groupBy(F.col("to_b").alias("b")).agg(F.max("to_t").alias("t")).collect()}
    return {b: first.get(b) for b in continuing}


def cooldown(df: DataFrame, key: str, ts_us: str, id_col: str, gap_us: int | None = None,
             n_blocks: int | None = None, seconds: float = 120, head_rows: int = HEAD_ROWS) -> DataFrame:
    """J4 (batch): keep an event only if at least ``gap_us`` (default: ``seconds``,
    120 s as in the reference) has passed since the key's last *emitted* event.

    Exact sequential semantics in parallel: rows are range-blocked by (key, ts,
    id) and pinned; a key continuing from an earlier block is affected only in
    its first ``gap`` of time.  Only such blocks tell which events can be their
    first emission and where the chain from each ends.  Few of those are walked
    through on the driver; where a key has very many events within one gap, the
    same entries come from binary lifting in Spark, one row per block.  Pass B
    then replays each block from its entry.
    """
    if gap_us is None:
        gap_us = int(seconds * 1_000_000)
    # events without a key belong to nobody and are never held back
    nobody = df.select(key, ts_us, id_col).where(F.col(key).isNull())
    base = df.select(key, ts_us, id_col).where(F.col(key).isNotNull())
    pinned = pin_blocks(base, [F.col(key), F.col(ts_us), F.col(id_col)], n_blocks)
    kt = pinned.schema[key].dataType
    schema = T.StructType([T.StructField(BLOCK, T.IntegerType()), T.StructField("first_key", kt), T.StructField("last_key", kt),
                           T.StructField("single", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_head", "head_exit", "tail_exit", "tail_start")]])
    summary = sorted(pinned.mapInPandas(_cool_summary(gap_us, key, ts_us), schema).collect(), key=lambda r: r[BLOCK])
    continuing = {y[BLOCK] for x, y in zip(summary, summary[1:]) if x["last_key"] == y["first_key"]}
    entries = {}
    if continuing:
        heads = T.StructType([T.StructField(BLOCK, T.IntegerType()), T.StructField(key, kt),
                              T.StructField("t", T.LongType()), T.StructField("exit", T.LongType())])
        portals = pinned.mapInPandas(_cool_portals(gap_us, key, ts_us, continuing), heads)
        if sum(r["n_head"] for r in summary if r[BLOCK] in continuing) <= head_rows:
            held: dict[int, list] = {}
            for r in portals.collect():      # a checked number of rows
                held.setdefault(r[BLOCK], []).append((r["t"], r["exit"]))
            entries = _walk(summary, {b: np.array(sorted(v)).T for b, v in held.items()}, gap_us)
        else:
            entries = _lifted(df.sparkSession, pinned, portals, summary, continuing, key, ts_us, gap_us)
    out_schema = T.StructType([*pinned.schema.fields, T.StructField("emitted", T.BooleanType())])
    flagged = pinned.mapInPandas(_cool_pass_b(gap_us, key, ts_us, entries), out_schema)
    return flagged.where("emitted").drop(BLOCK, "emitted").unionByName(nobody)
