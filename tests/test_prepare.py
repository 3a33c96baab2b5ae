"""Corpus preparation: reasons, damaged files, the stream against the batch form."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seqlake.operators.filters import FILTER_REASONS, CorpusConfig, corpus_condition, corpus_reject_reason
from seqlake.prepare import prepare, prepare_stream, read_manifest, read_prepared, read_rejects, unfinished_sources
from seqlake.session import scratch_dir
from pyspark.sql import functions as F

GAME = " ".join(f"{i}. e4 e5" for i in range(1, 12))
NAMES = ("movetext", "WhiteElo", "BlackElo", "TimeControl")
ROWS = [  # (game, reason)
    ((GAME, "2300", "2400", "180+2"), None),
    ((GAME, None, "2400", "180+2"), "rating_missing"),
    ((GAME, "2300", "?", "180+2"), "rating_malformed"),
    ((GAME, "2200", "2400", "180+2"), "rating_low"),
    ((GAME, "2300", "2400", "-"), "time_control"),
    ((GAME, "2300", "2400", None), "time_control"),
    ((GAME, "2300", "2400", "179+9"), "time_short"),
    ((None, "2300", "2400", "300+0"), "empty"),
    (("", "2300", "2400", "300+0"), "empty"),
    ((GAME + " (", "2300", "2400", "300+0"), "unbalanced"),
    (("1. e4 e5 1-0", "2300", "2400", "300+0"), "too_short"),
    ((GAME, "2300", "2400", "300+0"), None),
    ((GAME, "2300", "2400", "300+0"), None),
]


def write(path, rows, **kw):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    cols = {n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(NAMES)}
    pq.write_table(pa.table(cols), path, **kw)


def tear(path):
    """Overwrite the pages of the second row group; returns the whole file."""
    with open(path, "rb") as f:
        whole = f.read()
    c = pq.read_metadata(path).row_group(1).column(0)
    at, size = c.data_page_offset, c.total_compressed_size
    with open(path, "wb") as f:
        f.write(whole[:at] + b"\xff" * size + whole[at + size:])
    return whole


@pytest.fixture
def corpus(spark):
    root = scratch_dir(spark, "prepare").replace("file:", "", 1)
    games = [g for g, _ in ROWS]
    write(f"{root}/in/good/a.parquet", games)
    write(f"{root}/in/good/b.parquet", games[:1] * 3)
    write(f"{root}/in/none/c.parquet", games[1:5])
    write(f"{root}/in/zero/d.parquet", [])
    os.makedirs(f"{root}/in/broken")
    with open(f"{root}/in/broken/e.parquet", "w") as f:
        f.write("this is no Parquet file")
    write(f"{root}/in/torn/f.parquet", [(f"{GAME} {i}. a{i}", "2300", "2400", "180+2") for i in range(8)],
          row_group_size=4, use_dictionary=False, compression="gzip")
    whole = tear(f"{root}/in/torn/f.parquet")
    return root, whole


def state(spark, out):
    rejects = sorted((r.stem, -1 if r.row is None else r.row, r.reason) for r in read_rejects(spark, out).collect())
    manifest = sorted((r.stem, r.rows if r.stem != "torn_f" else None, r.kept, r.expected) for r in read_manifest(spark, out).collect())
    lines = sorted((r.stem, r.value) for r in read_prepared(spark, out).collect())
    return rejects, [str(m) for m in manifest], lines


def test_reason_is_null_where_the_condition_holds(spark):
    cfg = CorpusConfig(allowed_terminations=("Normal",))
    df = spark.createDataFrame([(*g, t) for g, _ in ROWS for t in ("Normal", "Time", None)],
                               ", ".join(f"{n} string" for n in (*NAMES, "Termination")))
    got = df.select(F.coalesce(corpus_condition(cfg, "lenient"), F.lit(False)).alias("ok"),
                    corpus_reject_reason(cfg).alias("why")).collect()
    assert all(r.ok == (r.why is None) for r in got) and {r.why for r in got} == {None, *FILTER_REASONS}


def test_reasons_and_damaged_files(spark, corpus):
    root, whole = corpus
    totals = prepare(spark, f"{root}/in", f"{root}/out")
    rejects, manifest, lines = state(spark, f"{root}/out")
    assert rejects == sorted(
        [("good_a", i, why) for i, (_, why) in enumerate(ROWS) if why] + [("none_c", i, ROWS[i + 1][1]) for i in range(4)]
        + [("broken_e", -1, "unreadable"), ("torn_f", -1, "partly_read"), ("zero_d", -1, "unreadable")])
    assert [x[0] for x in lines] == ["good_a"] * 3 + ["good_b"] * 3 and totals["kept"] == 6
    assert "('good_a', 13, 3, 13)" in manifest and "('broken_e', 0, 0, None)" in manifest
    assert {r.stem for r in unfinished_sources(spark, f"{root}/out").collect()} == {"broken_e", "torn_f", "zero_d"}
    # a file mended later is no reject any more; finished sources are left alone
    with open(f"{root}/in/torn/f.parquet", "wb") as f:
        f.write(whole)
    assert prepare(spark, f"{root}/in", f"{root}/out")["kept"] == 8
    rejects, _, lines = state(spark, f"{root}/out")
    assert not any(s == "torn_f" for s, _, _ in rejects) and sum(s == "torn_f" for s, _ in lines) == 8


def test_stream_over_damaged_files_equals_batch(spark, corpus):
    """One file a batch: the stream ends normally and leaves what the batch form leaves; a rerun finds nothing new."""
    root, _ = corpus
    prepare(spark, f"{root}/in", f"{root}/batch")
    totals = prepare_stream(spark, f"{root}/in", f"{root}/stream", f"{root}/checkpoint")
    assert state(spark, f"{root}/stream") == state(spark, f"{root}/batch") and totals["kept"] == 6
    assert prepare_stream(spark, f"{root}/in", f"{root}/stream", f"{root}/checkpoint") == {"rows": 0, "passed": 0, "kept": 0}
    write(f"{root}/in/late/g.parquet", [ROWS[0][0]])
    assert prepare_stream(spark, f"{root}/in", f"{root}/stream", f"{root}/checkpoint") == {"rows": 1, "passed": 1, "kept": 1}
    # a lost checkpoint replays every file: sources that are done are not read again
    assert prepare_stream(spark, f"{root}/in", f"{root}/stream", f"{root}/other", files_per_trigger=3)["kept"] == 0
    assert len(state(spark, f"{root}/stream")[2]) == 7


def test_converter_and_strict_mode(spark, corpus):
    root, _ = corpus

    def converter(text):
        if "(" in text:
            raise ValueError("no game")
        return [t for t in text.split() if not t.endswith(".")] or None
    prepare(spark, f"{root}/in", f"{root}/out", converter=converter)
    why = {r.row: r.reason for r in read_rejects(spark, f"{root}/out").collect() if r.stem == "good_a"}
    expected = {i: {"unbalanced": "converter_error"}.get(w, w) for i, (_, w) in enumerate(ROWS) if w}
    expected[8] = "unparseable"
    assert why == expected
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast|malformed"):
        prepare(spark, f"{root}/in", f"{root}/strict", mode="strict")


def test_damaged_inputs_build_the_games_once(spark, tmp_path, monkeypatch):
    """The torn file is made from the rows that were written, not from a second join of orders and lines."""
    from seqlake.plans import corpus_plans
    from seqlake.prepare import GAME_SCHEMA
    built = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            built.add(b.num_rows)
            yield b
    games = spark.createDataFrame([(f"1. e4 e5 {i}", "2300", "2300", "180+2", "P" if i % 3 else "F") for i in range(60)],
                                  f"{GAME_SCHEMA}, part string")
    monkeypatch.setattr(corpus_plans, "rejected_games", lambda *_: games.mapInArrow(counted, games.schema))
    corpus_plans.damaged_inputs(spark, "", str(tmp_path))
    assert built.value == 60
    assert spark.read.parquet(f"{tmp_path}/in/torn/file.parquet").count() == 40
