"""Keyed-state stream operators (J3 lifecycle, J4 cooldown, J5 live concurrency):
rows of a key are processed in event-time order inside each micro-batch.

J3 and J5 keep their state in Spark's own types (``transformWithState``): one map
entry per game, so a batch reads and writes only the games that it holds, and a
game that has finished leaves the state, at once where nothing depends on it any
more (J3), else a time to live after its end, by the clock of the key's own events
(J5, where its end must not count twice).
``applyInPandasWithState`` serves J4, whose state is one number, and the buffered
forms for out-of-order arrival."""

from __future__ import annotations

import json
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

#: How long a finished game is remembered (J5), in microseconds: longer than it may be reported again.
FINISHED_TTL = 24 * 3600 * 1_000_000
#: Games of a key's state that are scanned rather than asked for, for each game of a batch.
SCAN_PER_GAME = 16
#: Groups of keys that the buffered forms fold together: a group's rows wait in one value of the state store.
KEY_GROUPS = 256


def _rows(pdfs) -> pd.DataFrame:
    frames = list(pdfs)
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame()


def cooldown_stream(stream: DataFrame, key: str, ts_us: str, id_col: str, gap_us: int) -> DataFrame:
    """Emit an event only if ``gap_us`` has passed since the key's last
    emitted event; state = last emission time."""
    def fn(k, pdfs, state):
        pdf = _rows(pdfs).sort_values([ts_us, id_col])
        last = state.get[0] if state.exists else None
        keep = []
        for t, i in zip(pdf[ts_us].tolist(), pdf[id_col].tolist()):
            if last is None or t - last >= gap_us:
                keep.append(i)
                last = t
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({id_col: keep, key: [k[0]] * len(keep)})
    return stream.groupBy(key).applyInPandasWithState(
        fn, f"{id_col} long, {key} long", "last long", "append", GroupStateTimeout.NoTimeout)


class _Concurrency(StatefulProcessor):
    """Open games, finished games (until they expire), their number and the oldest end, per key."""

    def __init__(self, key, game, ts_us, type_col, start_type, end_type, ttl_us, game_type):
        self.names = key, game, ts_us, type_col
        self.types = start_type, end_type
        self.ttl_us, self.game_type = ttl_us, game_type

    def init(self, handle):
        self.open = handle.getMapState("open", f"game {self.game_type}", "since long")
        self.done = handle.getMapState("done", f"game {self.game_type}", "at long")
        self.counts = handle.getValueState("counts", "active long, oldest long")

    def _known(self, state, games, may_hold):
        """Those of ``games`` that a map holds: one scan of a short map, else asked one by one."""
        if not may_hold:
            return set()
        scan = state.iterator()
        held = {g[0] for g, _ in islice(scan, SCAN_PER_GAME * len(games) + 1)}
        if len(held) <= SCAN_PER_GAME * len(games):
            return held
        return {g for g in games if state.containsKey((g,))}

    def handleInputRows(self, key, rows, timer_values):
        key_col, game, ts_us, type_col = self.names
        start, end = self.types
        whole = self.game_type in ("tinyint", "smallint", "int", "bigint")
        events = []
        for pdf in rows:
            events += zip(pdf[ts_us].tolist(), [int(g) if whole and g is not None else g for g in pdf[game].tolist()],
                          pdf[type_col].tolist())
        events = sorted((e for e in events if e[2] in self.types), key=lambda e: (e[0], e[1] is None, e[1]))
        if not events:
            return
        before = self.counts.get() or (0, None)
        active, oldest = before
        games = {g for _, g, _ in events}
        known = dict.fromkeys(self._known(self.done, games, oldest is not None), "done")
        known.update(dict.fromkeys(self._known(self.open, games, active > 0), "open"))
        now_is: dict = {}           # games of this batch that changed: what they are, and since when
        out = []
        for t, g, typ in events:
            was = now_is[g][0] if g in now_is else known.get(g)
            if typ == start and was is None:
                now_is[g] = "open", t
                active += 1
                out.append((g, t, 1, active))
            elif typ == end and was == "open":
                now_is[g] = "done", t
                oldest = t if oldest is None else min(oldest, t)
                active -= 1
                out.append((g, t, -1, active))
        for g, (state, t) in now_is.items():
            if state == "done" and known.get(g) == "open":
                self.open.removeKey((g,))
            (self.open if state == "open" else self.done).updateValue((g,), (t,))
        now = events[-1][0]
        if oldest is not None and oldest + self.ttl_us <= now:
            ends = {g[0]: at[0] for g, at in self.done.iterator()}
            for g, at in ends.items():
                if at + self.ttl_us <= now:
                    self.done.removeKey((g,))
            oldest = min((at for at in ends.values() if at + self.ttl_us > now), default=None)
        if (active, oldest) != tuple(before):
            self.counts.update((active, oldest))
        if out:
            g, t, delta, count = zip(*out)
            yield pd.DataFrame({key_col: [key[0]] * len(out), game: g, ts_us: t, "delta": delta, "active": count})

    def close(self):
        pass


def concurrency_stream(stream: DataFrame, key: str, game: str, ts_us: str, type_col: str,
                       start_type: str, end_type: str, ttl_us: int = FINISHED_TTL) -> DataFrame:
    """E4 kept current on a stream — +1 at a game's first start, -1 at its
    first end after the start; emits (key, game, ts, delta, active).  A finished
    game leaves the state with the first batch that reaches ``ttl_us`` past its
    end, and would count as new after that."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    counted = stream.where(F.col(type_col).isin(start_type, end_type))     # the other events change nothing
    # as text, so that a NULL beside them does not turn whole numbers into floats
    counted = counted.withColumns({c: F.col(c).cast("string") for c in (key, game)})
    out = counted.groupBy(key).transformWithStateInPandas(
        _Concurrency(key, game, ts_us, type_col, start_type, end_type, ttl_us, kinds[game]),
        f"{key} string, {game} {kinds[game]}, {ts_us} long, delta int, active long", "append", "None")
    return out.withColumn(key, F.col(key).cast(kinds[key]))


class _Lifecycle(StatefulProcessor):
    """Our colour in a live game; a game that has ended has no state."""

    def __init__(self, key, ts_us, id_col, type_col, moves, full_type, state_types, end_types):
        self.names = key, ts_us, id_col, type_col, moves
        self.full, self.state_types, self.end_types = full_type, tuple(state_types), tuple(end_types)

    def init(self, handle):
        self.color = handle.getValueState("color", "color string")

    def handleInputRows(self, key, rows, timer_values):
        key_col, ts_us, id_col, type_col, moves = self.names
        pdf = _rows(rows).sort_values([ts_us, id_col])
        before = color = self.color.get()[0] if self.color.exists() else None
        out = []
        for i, typ, m in zip(pdf[id_col].tolist(), pdf[type_col].tolist(), pdf[moves].tolist()):
            if typ == self.full:
                color = "white" if m % 2 == 0 else "black"
            elif typ in self.end_types:
                color = None
                continue
            elif typ not in self.state_types:
                continue
            if color is not None and ((m % 2 == 0) == (color == "white")):
                out.append((i, key[0], color))
        if color is None:
            self.color.clear()
        elif color != before:
            self.color.update((color,))
        yield pd.DataFrame(out, columns=[id_col, key_col, "color"])

    def close(self):
        pass


def lifecycle_stream(stream: DataFrame, key: str, ts_us: str, id_col: str, type_col: str, moves: str,
                     full_type: str, state_types, end_types) -> DataFrame:
    """The full-state event fixes our colour (white iff its move count is
    even); an end event closes the game and drops its state; every later state
    event of a live game where it is our move emits a "turn due" row."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).transformWithStateInPandas(
        _Lifecycle(key, ts_us, id_col, type_col, moves, full_type, state_types, end_types),
        f"{id_col} {kinds[id_col]}, {key} {kinds[key]}, color string", "append", "None")


#: The one NaN of folded rows, as of states read back from JSON: a NULL number is equal to itself then.
_NAN = json.loads("NaN")


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> list[pd.DataFrame]:
    """The frames of any number of ``_packed`` strings, one behind the other."""
    source, frames = pa.BufferReader(packed), []
    while source.tell() < len(packed):
        frames.append(pa.ipc.open_stream(source).read_all().to_pandas())
    return frames


def _values(column: pd.Series) -> list:
    return [_NAN if x != x else x for x in column.tolist()]


def event_time_fold(stream: DataFrame, key: str, ts_col: str, ts_us: str, order_col: str,
                    value_cols, lateness: str, step, init: dict, out_schema: str) -> DataFrame:
    """Fold each key's rows in event-time order although files may arrive out of order.

    Rows wait in keyed state until the watermark (max event time - ``lateness``)
    has passed them, then ``step(state, row) -> list[tuple]`` is applied to them
    in (ts, ``order_col``) order; ``row`` is a dict of ``ts_us``, ``order_col`` and
    ``value_cols``.  A row older than what was already released cannot be folded
    in order: it is emitted through ``step``'s caller as a ``late`` row
    (``("late", row)`` is passed to ``step`` so it can route it to A13).  Rows
    that wait are revisited by an event-time timeout when the watermark moves,
    without new rows.

    The stream is grouped by ``KEY_GROUPS`` groups of keys, so that a visit's cost
    is shared by many keys.  Rows that arrive are appended to the group's state as
    Arrow data and read back only when some are due; the keys' own states (JSON
    objects, sets become lists) are kept beside them."""
    cols = list(dict.fromkeys([key, ts_us, order_col, *value_cols]))
    names = [f.split()[0] for f in out_schema.split(",")]

    def fn(_, pdfs, state):
        packed, first, folded = state.get if state.exists else (b"", None, "[]")
        packed, states = bytes(packed), {k: st for k, st in json.loads(folded)}
        out = []
        if not state.hasTimedOut:
            for pdf in pdfs:
                pdf = pdf[cols]
                if states:
                    kept = []
                    for row in zip(*[_values(pdf[c]) for c in cols]):
                        r = dict(zip(cols, row))
                        st = states.get(row[0])
                        late = st is not None and [r[ts_us], r[order_col]] <= st["upto"]
                        kept.append(not late)
                        if late:
                            out.extend(step(st["s"], r, row[0], late=True))
                    pdf = pdf[kept]
                if len(pdf):
                    packed += _packed(pdf)
                    least = pdf[ts_us].min()
                    if least == least:
                        first = int(least) if first is None else min(first, int(least))
        wm_us = state.getCurrentWatermarkMs() * 1000
        if first is not None and first <= wm_us:
            rows = pd.concat(_unpacked(packed), ignore_index=True)
            due = rows[ts_us] <= wm_us
            wait = rows[~due]
            packed = _packed(wait) if len(wait) else b""
            first = wait[ts_us].min() if len(wait) else None
            first = None if first is None or first != first else int(first)
            # stable: equal times in their order of arrival
            ready = rows[due].sort_values([ts_us, order_col] if order_col != ts_us else ts_us, kind="stable")
            for row in zip(*[_values(ready[c]) for c in cols]):
                r = dict(zip(cols, row))
                st = states.get(row[0])
                if st is None:
                    st = states[row[0]] = {"s": dict(init)}
                out.extend(step(st["s"], r, row[0], late=False))
                st["upto"] = [r[ts_us], r[order_col]]
        state.update((packed, first, json.dumps(list(states.items()), default=sorted)))
        if first is not None:
            state.setTimeoutTimestamp(first // 1000 + 1)
        yield pd.DataFrame(out, columns=names)
    # keys that are NULL lie in a group of their own, so that the others stay whole numbers
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)))
    return (stream.withWatermark(ts_col, lateness).withColumn("_group", group).groupBy("_group")
                  .applyInPandasWithState(fn, out_schema, "rows binary, first long, folded string", "append",
                                          GroupStateTimeout.EventTimeTimeout))


def cooldown_stream_buffered(stream: DataFrame, key: str, ts_col: str, ts_us: str, id_col: str,
                             gap_us: int, lateness: str) -> DataFrame:
    """J4 for out-of-order arrival (``event_time_fold``): status 'emitted' rows
    pass the cooldown; rows later than the lateness bound come out as 'late'."""
    def step(s, r, k, late):
        if late:
            return [(r[id_col], k, "late")]
        if s.get("last") is None or r[ts_us] - s["last"] >= gap_us:
            s["last"] = r[ts_us]
            return [(r[id_col], k, "emitted")]
        return []
    return event_time_fold(stream, key, ts_col, ts_us, id_col, [], lateness, step, {},
                           f"{id_col} long, {key} long, status string")


def concurrency_stream_buffered(stream: DataFrame, key: str, game: str, ts_col: str, ts_us: str,
                                type_col: str, start_type: str, end_type: str, lateness: str) -> DataFrame:
    """J5 for out-of-order arrival: E4's running open-game count per key; late
    rows are reported with ``delta = 0`` and status 'late'."""
    def step(s, r, k, late):
        if late:
            return [(k, r[game], r[ts_us], 0, s.get("active", 0), "late")]
        for name in ("open", "closed"):
            if not isinstance(s.get(name), set):      # a list, after it was stored
                s[name] = set(s.get(name, []))
        opened, closed = s["open"], s["closed"]
        res = []
        if r[type_col] == start_type and r[game] not in opened and r[game] not in closed:
            opened.add(r[game])
            s["active"] = s.get("active", 0) + 1
            res.append((k, r[game], r[ts_us], 1, s["active"], "ok"))
        elif r[type_col] == end_type and r[game] in opened:
            opened.discard(r[game])
            closed.add(r[game])
            s["active"] = s.get("active", 0) - 1
            res.append((k, r[game], r[ts_us], -1, s["active"], "ok"))
        return res
    return event_time_fold(stream, key, ts_col, ts_us, ts_us, [game, type_col], lateness, step, {},
                           f"{key} long, {game} int, {ts_us} long, delta int, active long, status string")


def lifecycle_stream_buffered(stream: DataFrame, key: str, ts_col: str, ts_us: str, id_col: str,
                              type_col: str, moves: str, full_type: str, state_types, end_types,
                              lateness: str) -> DataFrame:
    """J3 for out-of-order arrival: turn-due rows (status 'due'); late rows are
    reported with status 'late'."""
    def step(s, r, k, late):
        if late:
            return [(r[id_col], k, s.get("color"), "late")]
        typ, m = r[type_col], r[moves]
        if typ == full_type:
            s["color"], s["live"] = ("white" if m % 2 == 0 else "black"), True
        elif typ in end_types:
            s["live"] = False
            return []
        elif typ not in state_types:
            return []
        c = s.get("color")
        if s.get("live") and c is not None and ((m % 2 == 0) == (c == "white")):
            return [(r[id_col], k, c, "due")]
        return []
    return event_time_fold(stream, key, ts_col, ts_us, id_col, [type_col, moves], lateness, step, {},
                           f"{id_col} long, {key} long, color string, status string")
