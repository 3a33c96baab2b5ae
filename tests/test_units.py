"""Hand-written rows of the game schema (FIXTURES.md §2) and operator edge cases."""

import pytest
from pyspark.sql import functions as F

from seqlake.operators.convert import clean_movetext
from seqlake.operators.encode import encode
from seqlake.operators.filters import (CorpusConfig, base_seconds, corpus_filter, max_length_filter,
                                       min_length_filter, rating_filter)
from seqlake.operators.packing import pack_exact
from seqlake.operators.scoring import strategy
from seqlake.operators.vocab import move_vocabulary
from seqlake.session import scratch_dir
from seqlake.sources.tokens import check_manifest, packing_manifest, write_manifest

GAME = "movetext string, WhiteElo string, BlackElo string, TimeControl string"


def _games(spark, rows):
    return spark.createDataFrame(rows, GAME)


def test_time_control_cases(spark):
    rows = [("m", "2300", "2300", tc) for tc in
            ["180+2", "179+0", "-", None, "", "+5", "abc", " 180 +1", "99999999999+1", "180+2+3",
             "180.5+2", "1e3+0", "0x1F"]]
    got = {r.TimeControl: r.b for r in _games(spark, rows).select(
        "TimeControl", base_seconds("TimeControl").alias("b")).collect()}
    assert got["180+2"] == 180 and got[" 180 +1"] == 180 and got["180+2+3"] == 180
    assert got["179+0"] == 179
    for bad in ["-", None, "", "+5", "abc", "99999999999+1", "180.5+2", "1e3+0", "0x1F"]:
        assert got[bad] is None, bad


def test_corpus_filter_boundaries(spark):
    rows = [("keep", "2201", "2300", "180+2"), ("rating_eq", "2200", "2300", "180+2"),
            ("below_base", "2300", "2300", "179+0"), ("null_rating", None, "2300", "180+0"),
            ("padded", "2300", "2300", " 180 +1")]
    kept = {r.movetext for r in corpus_filter(_games(spark, rows), CorpusConfig()).collect()}
    assert kept == {"keep", "padded"}


def test_strict_rating_raises_lenient_drops(spark):
    rows = [("a", "?", "2300", "180+0"), ("b", "2300", "2300", "180+0")]
    df = _games(spark, rows)
    with pytest.raises(Exception):
        rating_filter(df, 2200, mode="strict").collect()
    assert [r.movetext for r in rating_filter(df, 2200, mode="lenient").collect()] == ["b"]


def test_length_boundaries(spark):
    df = spark.createDataFrame([(19, ["x"] * 19), (20, ["x"] * 20)], "n int, tokens array<string>")
    assert [r.n for r in min_length_filter(df, "tokens", 20).collect()] == [20]
    enc = spark.createDataFrame([(257,), (258,)], "len int")
    assert [r.len for r in max_length_filter(enc, "len", 257).collect()] == [257]


def test_unknown_token_rejects_whole_game(spark):
    vocab = spark.createDataFrame([("e2e4", 10), ("e7e5", 11)], "token string, id int")
    seqs = spark.createDataFrame([(1, ["e2e4", "e7e5"]), (2, ["e2e4", "zz"]), (3, [])],
                                 "gid long, tokens array<string>")
    out = {r.gid: (r.ids, r.reject_reason) for r in
           encode(seqs, "gid", "tokens", vocab, keep_rejects=True).collect()}
    assert out[1] == ([1, 10, 11, 2], None)
    assert out[2] == (None, "unknown_token")
    assert out[3] == (None, "empty")
    with pytest.raises(Exception):
        encode(seqs.where("gid = 2"), "gid", "tokens", vocab, on_unknown="error").collect()


def test_move_vocabulary(spark):
    v = move_vocabulary(spark)
    rows = sorted(v.collect(), key=lambda r: r.id)
    assert len(rows) == 1972
    assert [r.token for r in rows[:5]] == ["PAD", "BOS", "EOS", "MASK", "a1a2"]
    assert rows[-1].token == "h8h7"
    toks = [r.token for r in rows[4:]]
    assert toks == sorted(toks)
    assert sum(1 for t in toks if len(t) == 5) == 176


def test_packing_fixture(spark):
    lens = [100, 100, 100, 257, 3, 254, 1]
    df = spark.createDataFrame([(i, n, f"{i:04d}") for i, n in enumerate(lens)], "gid long, len int, k string")
    out = pack_exact(df, ["gid"], "len", 257, key_col="k", n_blocks=3)
    got = [r.chunk_id for r in out.orderBy("gid").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4]


def test_manifest_guard(spark):
    path = scratch_dir(spark, "manifest-test")
    df = spark.createDataFrame([("a",), ("b",)], "shard string")
    write_manifest(packing_manifest(df, 257, 42), path)
    assert check_manifest(spark, path, 256).first().shards == ["a", "b"]
    with pytest.raises(ValueError):
        check_manifest(spark, path, 512)


def test_unknown_strategy_raises(spark):
    with pytest.raises(ValueError):
        strategy("beam", "logits", "legal")


@pytest.mark.parametrize("text,expected,reason", [
    ("1. e4 {best by test} e5 2. Nf3 $1 (2. f4 exf4 (2... d5)) Nc6 3. Bb5!? a6 1-0",
     ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"], None),
    ("1. e4 ; a comment\n e5 *", ["e4", "e5"], None),
    ("", None, "empty"),
    ("1. e4 (", None, "unbalanced"),
])
def test_clean_movetext(spark, text, expected, reason):
    from seqlake.operators.convert import clean_movetext_df
    df = spark.createDataFrame([(text,)], "m string")
    r = df.select(clean_movetext("m").alias("c")).first().c
    assert r.tokens == expected and r.reject_reason == reason
    staged = clean_movetext_df(df, "m").first()
    assert staged.tokens == expected and staged.reject_reason == reason


def test_corrupt_file_is_reported(spark):
    import os
    from seqlake.sources.corpus import list_corpus, missing_files, scan_tolerant
    root = scratch_dir(spark, "corrupt")
    spark.range(10).write.parquet(f"{root}/good")
    local = root.replace("file:", "", 1)
    os.makedirs(f"{local}/bad", exist_ok=True)
    with open(f"{local}/bad/part-0.parquet", "wb") as fh:
        fh.write(b"not a parquet file")
    files = sorted([f"{root}/bad/part-0.parquet"] +
                   [f for f in list_corpus(spark, f"{root}/good")])
    seen = scan_tolerant(spark, files, "id long")
    assert seen.count() == 10
    miss = [r.path for r in missing_files(spark, files, seen).collect()]
    assert len(miss) == 1 and miss[0].endswith("bad/part-0.parquet")


def test_quarantine_files_plans_every_listed_file(spark):
    import os

    from seqlake.plans.corpus_plans import q_quarantine_files
    root = scratch_dir(spark, "quarantine")
    local = root.replace("file:", "", 1)
    for name, col in (("lineitem", "id"), ("orders", "text"), ("region", "id")):
        spark.range(3).select(F.col("id").cast("string" if col == "text" else "long").alias(col)).coalesce(1) \
            .write.parquet(f"{root}/{name}")
    with open(f"{local}/customer.parquet", "wb") as fh:
        fh.write(b"not a parquet file")
    got = [tuple(r) for r in q_quarantine_files(spark, root).collect()]
    assert got == [("customer.parquet", 0, 0)]


def test_buffered_cooldown_stream_handles_out_of_order_files(spark):
    """Files land in scrambled time order; with a lateness bound covering the
    disorder the buffered stream equals the batch fold.  A final clock row (a
    separate key) moves event time forward so every buffer is released."""
    from seqlake.operators.events import cooldown, ts_micros
    from seqlake.streaming.source import run_available, stream_files
    from seqlake.streaming.state import cooldown_stream_buffered
    gap = 6 * 3600 * 1_000_000
    ev = (spark.read.parquet("/root/testdata/sf0.001/events.parquet")
          .select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                  ts_micros("ts").alias("ts_us")))
    root = scratch_dir(spark, "buffered")
    lo, hi = ev.agg(F.min("ts_us"), F.max("ts_us")).first()
    step = (hi - lo) // 4 + 1
    for i in [1, 0, 3, 2]:   # out of order, each slice spans a quarter of the time range
        ev.where((F.col("ts_us") >= lo + i * step) & (F.col("ts_us") < lo + (i + 1) * step)) \
          .coalesce(1).write.mode("append").parquet(f"{root}/src")
    clock = spark.createDataFrame([(-1, -1)], "event_id long, user_id long") \
        .withColumn("ts", F.lit("2100-01-01 00:00:00").cast("timestamp")).withColumn("ts_us", ts_micros("ts"))
    clock.write.mode("append").parquet(f"{root}/src")
    stream = stream_files(spark, f"{root}/src", ev.schema, files_per_trigger=1)
    out = cooldown_stream_buffered(stream, "user_id", "ts", "ts_us", "event_id", gap, "30 days")
    run_available(out.writeStream.format("parquet").option("path", f"{root}/out").outputMode("append"),
                  f"{root}/ck")
    got = spark.read.parquet(f"{root}/out").where("user_id >= 0")
    assert got.where("status = 'late'").count() == 0
    emitted = {r.event_id for r in got.where("status = 'emitted'").collect()}
    batch = {r.event_id for r in cooldown(ev, "user_id", "ts_us", "event_id", gap).collect()}
    assert emitted == batch


def test_decode_ids_move_vocabulary(spark):
    from seqlake.operators.vocab import decode_ids, fixed_tokens
    v = fixed_tokens(spark)
    df = spark.createDataFrame([([1, 4, 1971, 0, 5000],)], "ids array<int>")
    got = df.select(decode_ids("ids", v, drop_pad=True).alias("t")).first().t
    assert got == ["BOS", "a1a2", "h8h7", "?"]


def test_prepare_end_to_end(spark):
    from seqlake.prepare import prepare
    root = scratch_dir(spark, "prepare")
    long_game = " ".join(f"{i}. e4 e5" for i in range(1, 12))       # 22 plies
    rows = [(long_game, "2300", "2400", "180+2"),                   # kept
            (long_game, "2200", "2400", "180+2"),                   # rating not > 2200
            ("1. e4 e5 1-0", "2300", "2400", "300+0"),              # too short
            (long_game, "?", "2400", "180+0")]                      # malformed rating (lenient: dropped)
    import os

    import pandas as pd
    local = root.replace("file:", "", 1)
    os.makedirs(f"{local}/in/train", exist_ok=True)
    pd.DataFrame(rows, columns=["movetext", "WhiteElo", "BlackElo", "TimeControl"]) \
      .to_parquet(f"{local}/in/train/part0_0000.parquet", index=False)
    totals = prepare(spark, f"{root}/in", f"{root}/out")
    assert (totals["rows"], totals["passed"], totals["kept"]) == (4, 2, 1)
    lines = spark.read.text(f"{root}/out").collect()
    assert len(lines) == 1 and lines[0].value.split() == ["e4", "e5"] * 11
    assert lines[0].stem == "train_part0_0000"


def test_prepare_leaves_a_partly_read_file_pending(spark):
    """A file damaged in its second row group gives no lines, is reported and is read again once it is whole."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    from seqlake.prepare import prepare, read_manifest, read_prepared, unfinished_sources
    root = scratch_dir(spark, "damaged")
    local = root.replace("file:", "", 1)
    game = " ".join(f"{i}. e4 e5" for i in range(1, 12))
    names = ("movetext", "WhiteElo", "BlackElo", "TimeControl")
    for part, n in (("good", 5), ("torn", 8)):
        os.makedirs(f"{local}/in/{part}")
        cols = [[f"{game} {i}. a{i}" for i in range(n)], ["2300"] * n, ["2400"] * n, ["180+2"] * n]
        pq.write_table(pa.table(dict(zip(names, cols))), f"{local}/in/{part}/file.parquet", row_group_size=4,
                       use_dictionary=False, compression="gzip")
    torn = f"{local}/in/torn/file.parquet"
    with open(torn, "rb") as f:
        whole = f.read()
    column = pq.read_metadata(torn).row_group(1).column(0)
    at, size = column.data_page_offset, column.total_compressed_size
    with open(torn, "wb") as f:
        f.write(whole[:at] + b"\xff" * size + whole[at + size:])

    def manifest():
        return {r.stem: (r.rows, r.passed, r.kept, r.expected) for r in read_manifest(spark, f"{root}/out").collect()}
    totals = prepare(spark, f"{root}/in", f"{root}/out")
    assert manifest()["good_file"] == (5, 5, 5, 5) and manifest()["torn_file"][2:] == (0, 8)
    assert totals["kept"] == 5 and {r.stem for r in read_prepared(spark, f"{root}/out").collect()} == {"good_file"}
    assert [r.stem for r in unfinished_sources(spark, f"{root}/out").collect()] == ["torn_file"]
    with open(torn, "wb") as f:
        f.write(whole)
    assert prepare(spark, f"{root}/in", f"{root}/out") == {"rows": 8, "passed": 8, "kept": 8}
    assert manifest() == {"good_file": (5, 5, 5, 5), "torn_file": (8, 8, 8, 8)}
    assert unfinished_sources(spark, f"{root}/out").count() == 0 and read_prepared(spark, f"{root}/out").count() == 13


def test_prepare_stream_matches_batch(spark):
    import os

    import pandas as pd
    from seqlake.prepare import prepare, prepare_stream
    root = scratch_dir(spark, "prepare-stream")
    local = root.replace("file:", "", 1)
    game = " ".join(f"{i}. d4 d5" for i in range(1, 12))
    for j, rating in enumerate(["2300", "2100", "2500"]):
        os.makedirs(f"{local}/in/src{j}", exist_ok=True)
        pd.DataFrame([(game, rating, "2400", "600+5")],
                     columns=["movetext", "WhiteElo", "BlackElo", "TimeControl"]) \
          .to_parquet(f"{local}/in/src{j}/part0.parquet", index=False)
    prepare(spark, f"{root}/in", f"{root}/batch")
    prepare_stream(spark, f"{root}/in", f"{root}/stream", f"{root}/ck")
    b = sorted((r.stem, r.value) for r in spark.read.text(f"{root}/batch").collect())
    s = sorted((r.stem, r.value) for r in spark.read.text(f"{root}/stream").collect())
    assert b == s and [x[0] for x in b] == ["src0_part0", "src2_part0"]


def test_fixed_move_ids_equal_join_path(spark):
    from seqlake.operators.encode import lookup_ids
    from seqlake.operators.vocab import fixed_move_ids, move_id_table
    v = move_vocabulary(spark)
    toks = [["e2e4", "e7e8q", "a7b8n", "h8h7", "zz", "e2e9", "a1a1", "e7e8k"]]
    df = spark.createDataFrame([(1, toks[0])], "k long, tokens array<string>")
    arith = df.select(fixed_move_ids("tokens", move_id_table(v)).alias("ids")).first().ids
    joined = lookup_ids(df, "k", "tokens", v).first().ids
    assert arith == joined
    assert arith[3] == 1971 and arith[4:] == [None, None, None, None]


def test_encode_carry_equals_join_back(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    seqs = spark.createDataFrame([(1, "s1", ["a", "b", "a"]), (2, "s2", ["b", "x"]), (3, "s1", [])],
                                 "k long, shard string, tokens array<string>")
    a = {(r.k, r.shard, tuple(r.ids or ()), r.reject_reason)
         for r in encode(seqs, "k", "tokens", vocab, keep_rejects=True).collect()}
    b = {(r.k, r.shard, tuple(r.ids or ()), r.reject_reason)
         for r in encode(seqs, "k", "tokens", vocab, keep_rejects=True, carry=["shard"]).collect()}
    assert a == b and len(a) == 3


# -- cases of the round-1 verdict ------------------------------------------------------------

def test_nested_variations_of_any_depth(spark):
    from seqlake.operators.convert import clean_movetext_df
    rows = [("deep", "e4 " + "(a " * 30 + "b" + " c)" * 30 + " e5"), ("open", "e4 (a (b) e5"), ("close", "e4 a) (b e5"),
            ("crossed", "e4 ) ( e5"), ("none", "e4 e5"), ("all", "(a)"), ("two", "e4(a)e5(b(c)d)Nf3")]
    got = {r.k: (r.tokens, r.reject_reason) for r in clean_movetext_df(
        spark.createDataFrame(rows, "k string, t string"), "t").collect()}
    assert got == {"deep": (["e4", "e5"], None), "open": (None, "unbalanced"), "close": (None, "unbalanced"),
                   "crossed": (None, "unbalanced"), "none": (["e4", "e5"], None), "all": (None, "empty"),
                   "two": (["e4", "e5", "Nf3"], None)}


def test_ndjson_bad_lines(spark):
    from seqlake.sources.text import parse_ndjson
    lines = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ("not json",), ('{"a": ',), ("[1]",), (" ",), ('{"a": null}',), ('{}',)],
                                  "value string")
    got = parse_ndjson(lines, "a int, b struct<c: string>", keep_bad=True).collect()
    assert sorted((r.a, r.reject_reason) for r in got if r.a) == [(1, None)]
    assert sum(r.reject_reason == "bad_json" for r in got) == 3 and len(got) == 6
    assert parse_ndjson(lines, "a int").count() == 3


def test_running_sum_nulls_and_decimals(spark):
    from decimal import Decimal
    from seqlake.operators.ordered import running_sum
    rows = [(i, None if i % 2 else i, Decimal(i) / 4) for i in range(40)] + [(100, None, None)]
    df = spark.createDataFrame(rows, "i long, v long, d decimal(10,2)")
    for n in (1, 5, 9):
        got = {r.i: (r.a, r.b) for r in running_sum(df, {"a": "v", "b": "d"}, ["i"], n_blocks=n).collect()}
        v, d = 0, Decimal(0)
        for i, x, y in rows:
            v, d = v + (x or 0), d + (y or 0)
            assert got[i] == (v, d), (n, i)
    late = spark.createDataFrame([(i, None if i < 30 else 1) for i in range(40)], "i long, v long")
    got = {r.i: r.a for r in running_sum(late, {"a": "v"}, ["i"], n_blocks=6).collect()}
    assert all(got[i] is None for i in range(30)) and got[39] == 10


def test_parity_is_per_vector(spark):
    from seqlake.operators.scoring import parity_summary
    rows = [("g", 1, p, v, w) for p, (v, w) in enumerate([(1.0, 1.0), (5.0, 5.0)])] + \
           [("g", 2, p, v, w) for p, (v, w) in enumerate([(3.0, 2.0), (2.0, 3.0)])]
    r = parity_summary(spark.createDataFrame(rows, "label string, vec int, pos int, a double, b double"), ["label"], ["vec"]).first()
    assert not r.top1_match and not r["pass"] and r.max_abs_diff == 1.0


def test_throughput_log_windows(spark):
    from seqlake.operators.stats import throughput_log
    rows = [("e", s, float(s), 10, 100.0 + 2 * s) for s in range(1, 6)]
    got = throughput_log(spark.createDataFrame(rows, "epoch string, step long, loss double, n_tokens long, ts_s double"), 2).collect()
    got = {r.log_window: (r.tokens, r.tok_per_s, r.last_loss) for r in got}
    assert got == {0: (20, 10.0, 2.0), 1: (20, 5.0, 4.0)}   # since the previous log; the half window 5 is not logged


def test_sampling_edge_temperatures(spark):
    from seqlake.operators.scoring import greedy_legal, sample_legal
    df = spark.createDataFrame([(1, [0.0] * 4 + [900.0, 1.0, 5.0], [5, 6])], "row_id int, logits array<double>, legal array<int>")
    r = df.select(greedy_legal("logits", "legal").alias("g"), sample_legal("logits", "legal", 0.0, 1, "row_id").alias("t0"),
                  sample_legal("logits", "legal", 0.01, 1, "row_id").alias("t1")).first()
    assert (r.g, r.t0, r.t1) == (6, 6, 6)


def test_shard_ranks_of_a_short_table(spark):
    from seqlake.operators.split import shard_ranks
    got = shard_ranks(spark.createDataFrame([(i,) for i in range(3)], "idx long"), "idx", 8).collect()
    assert sorted((r["rank"], r.idx) for r in got) == [(p, p % 3) for p in range(8)]
    assert shard_ranks(spark.createDataFrame([], "idx long"), "idx", 4).count() == 0


def test_date_split_keeps_rows_without_date(spark):
    from seqlake.operators.split import date_split
    df = spark.sql("SELECT id, CASE WHEN id % 5 > 0 THEN date_add(DATE'2020-01-01', CAST(id AS INT)) END AS d FROM range(40)")
    got = date_split(df, "d").collect()
    assert len(got) == 40 and all((r.split is None) == (r.d is None) for r in got)


def test_lookup_keeps_rows_that_share_a_key(spark):
    from seqlake.operators.encode import lookup_ids
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    rows = [(1, ["a"], "x"), (1, ["b"], "x"), (1, ["b"], "x"), (None, ["a", "z"], "y"), (2, [], "z"), (3, None, "w")]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, c string")
    want = sorted(map(str, [(1, [4]), (1, [5]), (1, [5]), (None, [4, None]), (2, None), (3, None)]))
    norm = lambda d: sorted(str((r.k, r.ids or None)) for r in d.collect())
    assert norm(lookup_ids(df, "k", "tokens", vocab)) == want
    assert norm(lookup_ids(df, "k", "tokens", vocab, carry=["c"])) == want


def test_cooldown_null_keys(spark):
    from seqlake.operators.events import cooldown
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 2), (2 ** 60, 1, 3), (2 ** 60 + 1, 2, 4), (2 ** 60, 3, 5)],
                               "k long, t long, i long")
    assert sorted(r.i for r in cooldown(df, "k", "t", "i", gap_us=100).collect()) == [1, 2, 3, 4]


def test_listing_opens_no_file(spark):
    from seqlake.sources.corpus import list_corpus, scan_tolerant
    root = scratch_dir(spark, "listing")
    spark.range(3).coalesce(1).write.parquet(f"{root}/good")
    spark.createDataFrame([("junk",)], "value string").coalesce(1).write.text(f"{root}/t")
    import glob
    import os
    os.makedirs(f"{root}/bad".replace("file:", ""), exist_ok=True)
    junk = glob.glob(f"{root}/t/part*".replace("file:", ""))[0]
    with open(junk, "rb") as a, open(f"{root}/bad/x.parquet".replace("file:", ""), "wb") as b:
        b.write(a.read())
    files = list_corpus(spark, root)
    assert len(files) == 2
    assert scan_tolerant(spark, files, "id long").count() == 3


def test_prepare_filters_before_it_converts(spark):
    from seqlake.operators.filters import CorpusConfig
    from seqlake.prepare import games_of, kept_games
    root = scratch_dir(spark, "plan")
    spark.createDataFrame([("e4", "2300", "2300", "180+2")], "movetext string, WhiteElo string, BlackElo string, TimeControl string") \
        .write.parquet(root)
    for converter in (None, str.split):
        plan = kept_games(games_of(spark, [root]), CorpusConfig(), converter)._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.split("\n")
        rating = max(i for i, line in enumerate(lines) if "Filter" in line and "WhiteElo" in line)
        work = next(i for i, line in enumerate(lines) if ("regexp_replace(movetext" in line or "MapInPandas" in line))
        assert work < rating, plan   # the plan prints parents first


def test_carried_state_with_equal_times(spark):
    """The later event id wins, in the batch form as in the stream."""
    from seqlake.operators.events import carry_last, game_lifecycle
    rows = [("u", 5, 1, "full", 1), ("u", 5, 2, "full", 0), ("u", 5, 3, "move", 2), ("u", 6, 4, "end", 0), ("u", 6, 5, "move", 2),
            ("v", 1, 6, "end", 0), ("v", 1, 7, "full", 1), ("v", 1, 8, "move", 3)]
    df = spark.createDataFrame(rows, "k string, t long, i long, typ string, m long")
    for n in (None, 5):
        got = {r.i: r.c for r in carry_last(df, "k", ["t", "i"], F.when(F.col("typ") == "full", F.col("m")), "c").collect()}
        assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: None, 7: 1, 8: 1}
    due = game_lifecycle(df, "k", ["t", "i"], "typ", "m", "t", "full", ("move",), ("end",)).collect()
    assert sorted((r.i, r.color) for r in due) == [(1, "black"), (2, "white"), (3, "white"), (7, "black"), (8, "black")]
