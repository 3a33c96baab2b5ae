"""Next-fit by successor pointers, bucketed packing as a stream, gathering from the bucketed token store."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators.nextfit import compose, fit, fit_table
from seqlake.operators.packing import gather_chunks, pack_bucketed, pack_exact
from seqlake.session import scratch_dir
from seqlake.sources.tokens import GAME_KEY, stored_games, write_bucketed


def one_by_one(lens, limit, fill=0, items=0, chunk=0):
    out = []
    for n in lens:
        if fill > 0 and fill + n > limit:
            fill, items, chunk = 0, 0, chunk + 1
        out.append((chunk, items))
        fill, items = fill + n, items + 1
    return out, (fill, items, chunk)


def lengths(rng, limit):
    kind = rng.randint(0, 3)
    n = rng.randint(0, 200)
    return [{0: rng.randint(1, limit), 1: 1, 2: limit, 3: rng.choice([1, limit // 2, limit // 2 + 1, limit])}[kind] for _ in range(n)]


def test_placing_and_tables_equal_the_rule():
    rng = random.Random(5)
    for _ in range(300):
        limit = rng.choice([1, 2, 7, 40, 257])
        lens = lengths(rng, limit)
        entry = rng.randint(0, limit)
        state = (entry, rng.randint(1, 5) if entry else 0, rng.randint(0, 9))
        chunk, pos, end = fit(np.array(lens, np.int64), limit, *state)
        want, after = one_by_one(lens, limit, *state)
        assert list(zip(chunk.tolist(), pos.tolist())) == want and end == after
        cut = rng.randint(0, len(lens))
        parts = [np.array(lens[:cut], np.int64), np.array(lens[cut:], np.int64)]
        whole = compose(fit_table(parts[0], limit), fit_table(parts[1], limit), len(parts[1]))
        for cur in range(limit + 1):
            (exit_, items, closed) = one_by_one(lens, limit, cur, 0, 0)[1]
            got = whole[:, cur].tolist()
            assert got[:2] == [exit_, closed] and (closed == 0 or got[2] == items)


def sequential(rows, limit):
    """rows: (key, id, len) in order."""
    return {i: x for (_, i, _), x in zip(rows, one_by_one([n for *_, n in rows], limit)[0])}


def test_blocks_cut_by_arrow_batches(spark):
    """Blocks and buckets that many batches cut; the bucket count follows from the rows."""
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "gid long, len int").repartition(6)
    key = {r.gid: r.k for r in df.select("gid", F.md5(F.concat_ws(":", F.lit("42"), F.col("gid").cast("string"))).alias("k")).collect()}
    ordered = sorted((key[i], i, n) for i, n in rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
        for blocks in (1, 5):
            got = {r.gid: (r.chunk_id, r.pos) for r in pack_exact(df, ["gid"], chunk_len=100, n_blocks=blocks).collect()}
            assert got == sequential(ordered, 100)
        for n in (None, 4):
            got = pack_bucketed(df, ["gid"], n, chunk_len=100).collect()
            assert len(got) == 3000 and len({r.bucket for r in got}) == (n or 1)
            for b in {r.bucket for r in got}:
                own = {r.gid: (r.chunk_no, r.pos) for r in got if r.bucket == b}
                assert own == sequential([x for x in ordered if x[1] in own], 100)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_lengths_that_fit_no_chunk_raise(spark):
    for bad in (0, 101, None):
        df = spark.createDataFrame([(1, 50), (2, bad)], "gid long, len int")
        with pytest.raises(ValueError, match="within 1..100"):
            pack_exact(df, ["gid"], chunk_len=100)
        with pytest.raises(Exception, match="length outside"):
            pack_bucketed(df, ["gid"], 2, chunk_len=100).collect()


def test_gather_from_bucketed_store(spark):
    """Repeated games, shared ids and NULL ids are kept; the store is read where it lies."""
    rng = random.Random(7)
    games = [(i, [rng.randint(4, 99) for _ in range(rng.randint(1, 30))]) for i in range(200)]
    games += games[:20] + games[:5] + [(7, [1, 2, 3]), (None, [9, 9]), (None, [9, 9]), (None, [8])]
    df = spark.createDataFrame(games, "doc_id long, ids array<int>").withColumn("len", F.size("ids"))
    store = write_bucketed(df, "test_store", scratch_dir(spark, "store"), "doc_id", n_buckets=8)
    again = stored_games(store, "doc_id").join(store.select(*GAME_KEY, "ids"), GAME_KEY)
    assert sorted(str((r.doc_id, r.ids)) for r in again.collect()) == sorted(str(g) for g in games)
    packing = pack_exact(stored_games(store, "doc_id"), ["doc_id"], chunk_len=40)
    chunks = gather_chunks(packing, store, GAME_KEY)
    got = chunks.collect()
    assert sum(r.n_games for r in got) == len(games) and max(len(r.tokens) for r in got) <= 40
    lens = {(r.chunk_id, r.pos): (r.doc_id, r.len) for r in packing.collect()}
    for r in got:
        members = [lens[r.chunk_id, p] for p in range(r.n_games)]
        at = 0
        for doc, n in members:
            assert (doc, list(r.tokens[at:at + n])) in games
            at += n
        assert at == len(r.tokens)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        narrow = packing.select(*GAME_KEY, "chunk_id", "pos").checkpoint()
        plan = gather_chunks(narrow, store, GAME_KEY)._jdf.queryExecution().executedPlan().toString().split("\n")
        join = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line)
        exchanges = [line for line in plan[join:] if "Exchange" in line]
        assert len(exchanges) == 1 and "ids" not in "".join(exchanges), plan     # the packing's narrow rows
        assert any("Bucketed: true" in line for line in plan)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    spark.sql("DROP TABLE test_store")


def test_long_labels_move_arrays_not_positions(spark, tmp_path):
    from seqlake.plans import queries
    docs = spark.createDataFrame([(i, "a b c " * (i + 1), "s", "en") for i in range(5)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["shift_labels_long"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [next(i for i, line in enumerate(plan) if name in line) for name in ("Window [", "Generate posexplode(ids")]
    assert not any("Exchange" in line for line in plan[at[0]:at[1]])
    assert out.count() == sum(3 * (i + 1) + 1 for i in range(5))
