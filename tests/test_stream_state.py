"""State of the keyed streams: finished games leave it; equal times are settled by the event id."""

from pyspark.sql import functions as F

from seqlake.session import scratch_dir
from seqlake.streaming.source import run_available, stream_files
from seqlake.streaming.state import concurrency_stream, lifecycle_stream


class Feed:
    """A folder that files land in, one after another, and a query over it that goes on from its checkpoint."""

    def __init__(self, spark, schema, build):
        self.spark, self.schema, self.build, self.root = spark, schema, build, scratch_dir(spark, "state")

    def land(self, rows):
        df = self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        out = self.build(stream_files(self.spark, f"{self.root}/in", df.schema))
        run_available(out.writeStream.format("parquet").option("path", f"{self.root}/out").outputMode("append"),
                      f"{self.root}/ck", state_partitions=2)
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.root}/out").collect())

    def state(self, name):
        return (self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.root}/ck")).collect()


def test_finished_games_expire(spark):
    feed = Feed(spark, "user long, game int, t long, kind string",
                lambda s: concurrency_stream(s, "user", "game", "t", "kind", "start", "end", ttl_us=100))
    got = feed.land([(1, 7, 0, "start"), (1, 7, 10, "end"), (1, 8, 20, "start"), (2, 7, 5, "start"), (1, 7, 30, "start")])
    assert got == [(1, 7, 0, 1, 1), (1, 7, 10, -1, 0), (1, 8, 20, 1, 1), (2, 7, 5, 1, 1)]
    assert len(feed.state("done")) == 1 and len(feed.state("open")) == 2
    got = feed.land([(1, 7, 109, "start"), (1, 9, 111, "start")])         # still remembered, then forgotten
    assert len(got) == 5 and (1, 9, 111, 1, 2) in got and feed.state("done") == []
    got = feed.land([(1, 7, 120, "start"), (2, 7, 120, "start"), (1, 8, 130, "end")])
    assert (1, 7, 120, 1, 3) in got and (1, 8, 130, -1, 2) in got and len(got) == 7    # user 2's game is still open
    assert len(feed.state("done")) == 1


def test_ended_games_have_no_state_and_ties(spark):
    rows = [("u", 5, 1, "full", 1), ("u", 5, 2, "full", 0), ("u", 5, 3, "move", 2), ("u", 6, 4, "end", 0), ("u", 6, 5, "move", 2),
            ("v", 1, 6, "end", 0), ("v", 1, 7, "full", 1), ("v", 1, 8, "move", 3)]
    feed = Feed(spark, "k string, t long, i long, typ string, m long",
                lambda s: lifecycle_stream(s, "k", "t", "i", "typ", "m", "full", ("move",), ("end",)))
    due = feed.land(list(reversed(rows)))
    assert due == [(1, "u", "black"), (2, "u", "white"), (3, "u", "white"), (7, "v", "black"), (8, "v", "black")]
    assert len(feed.state("color")) == 1                    # v's game; u's has ended
    assert len(feed.land([("v", 9, 9, "end", 0)])) == len(due) and feed.state("color") == []
    assert feed.spark.read.parquet(f"{feed.root}/out").where(F.col("i") == 9).count() == 0


def test_a_slice_of_many_files_is_one_batch(spark, monkeypatch):
    """Slices land as a fixed number of files, also when rows are few, and a batch takes one slice."""
    from seqlake.streaming import source
    monkeypatch.setattr(source, "ROWS_PER_FILE", 2)
    df = spark.createDataFrame([(i, i) for i in range(24)] + [(99, 1000)], "id long, t long")
    root = scratch_dir(spark, "slices")
    n = source.land_in_order(df, f"{root}/in", "t", 4)          # the last slice but one has no row at all
    assert n > 1 and len(spark.read.parquet(f"{root}/in").inputFiles()) == 4 * n
    seen = []
    stream = stream_files(spark, f"{root}/in", df.schema, files_per_trigger=n)
    run_available(stream.writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.t for r in b.collect()))), f"{root}/ck")
    assert seen == [list(range(24)), [], [], [1000]]


def test_buffered_fold_by_groups_of_keys(spark, monkeypatch):
    """Many keys share a group: each is folded in its own order, its states kept between visits."""
    from seqlake.streaming import state
    monkeypatch.setattr(state, "KEY_GROUPS", 2)
    feed = Feed(spark, "user long, game int, ts timestamp, t long, kind string",
                lambda s: state.concurrency_stream_buffered(s, "user", "game", "ts", "t", "kind", "start", "end", "10 seconds"))

    def at(user, game, second, kind):
        import datetime
        return user, game, datetime.datetime.fromtimestamp(second), second * 1_000_000, kind
    first = [at(u, 7, 100 + u, "start") for u in range(9)] + [at(u, 6, 101 + u, "start") for u in range(9)]
    assert feed.land(first + [at(50, 1, 105, "end")]) == []
    feed.land([at(u, 7, 103 + u, "end") for u in range(9)] + [at(0, 8, 102, "start")])
    assert feed.land([at(-1, 0, 200, "clock")])
    rows = sorted(((u, t // 1_000_000, g, d, a, s) for u, g, t, d, a, s in
                  (tuple(r) for r in spark.read.parquet(f"{feed.root}/out").collect()) if u >= 0), key=lambda r: r[:2])
    want = [(0, 100, 7, 1, 1, "ok"), (0, 101, 6, 1, 2, "ok"), (0, 102, 8, 1, 3, "ok"), (0, 103, 7, -1, 2, "ok")]
    assert [r for r in rows if r[0] == 0] == want
    assert [r for r in rows if r[0] == 3] == [(3, 103, 7, 1, 1, "ok"), (3, 104, 6, 1, 2, "ok"), (3, 106, 7, -1, 1, "ok")]
