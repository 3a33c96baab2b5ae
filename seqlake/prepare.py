"""Corpus preparation, the reference's top-level data job:

scan (A1, unreadable files skipped) -> corpus filter (B3) -> conversion of the
games that pass (H1 or a converter plug-in, H2) -> minimum length (B4) -> one text
line per game, one folder per source stem (A6), and one row per game that is left
out, with its file, its place there and the reason (A13) -> a manifest row per
source (D1), by which a later run skips what is done (A4).

Every game is judged once; lines, rejects and totals come from that one landed
table, and no output of an earlier run is read.  The streaming form takes the
*files* as its records: a micro-batch is a list of files, prepared as a batch run
would, so a damaged file is an entry in the accounts and not the end of the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions.text import join_ws
from seqlake.operators.convert import clean_movetext_df, convert_games
from seqlake.operators.filters import FILTER_REASONS, CorpusConfig, corpus_condition, corpus_reject_reason
from seqlake.session import scratch_dir
from seqlake.sources.corpus import list_corpus, pending_inputs, scan_tolerant, source_stem, spread_narrow_scan
from seqlake.streaming.source import run_available, stream_listing

GAME_SCHEMA = "movetext string, WhiteElo string, BlackElo string, TimeControl string"
MANIFEST = "_manifest"   # a leading underscore hides it from readers of the lines
REJECTS = "_rejects"
#: ``expected`` is the row count of the source's footer; NULL: the footer gave none (unreadable, or no rows).
MANIFEST_SCHEMA = "stem string, rows long, passed long, kept long, expected long"


#: ``row`` counts from 0 within the file; NULL: the reason holds for the file as a whole.
REJECT_SCHEMA = "path string, row long, reason string, stem string"
UNREADABLE, PARTLY_READ = "unreadable", "partly_read"


def games_of(spark: SparkSession, files: list[str]) -> DataFrame:
    """The games of ``files`` with their path and source stem; unreadable files give no row."""
    path = F.col("_metadata.file_path")
    return scan_tolerant(spark, files, GAME_SCHEMA).withColumns({"path": path, "stem": source_stem(path)})


def kept_games(games: DataFrame, cfg: CorpusConfig, converter=None, mode: str = "lenient") -> DataFrame:
    """Filter first, on the plain columns; convert only what passes; then the length."""
    return _converted(games.where(F.coalesce(corpus_condition(cfg, mode), F.lit(False))), cfg, converter)


def _converted(passed: DataFrame, cfg: CorpusConfig, converter=None) -> DataFrame:
    conv = (clean_movetext_df(passed, "movetext") if converter is None
            else convert_games(passed, "movetext", converter))
    return conv.where(F.coalesce(F.size("tokens"), F.lit(0)) >= cfg.min_plies)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """One row per source seen by any run: ``stem, rows, passed, kept, expected``."""
    if not _exists(spark, f"{out}/{MANIFEST}"):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{out}/{MANIFEST}")
    return rows.groupBy("stem").agg(*[F.max(c).alias(c) for c in ("rows", "passed", "kept", "expected")])


def unfinished_sources(spark: SparkSession, out: str) -> DataFrame:
    """Manifest rows of sources not read to their end by any run: fewer rows than their footer tells, or none."""
    return read_manifest(spark, out).where("expected IS NULL OR rows <> expected")


def read_prepared(spark: SparkSession, out: str) -> DataFrame:
    """``(value, stem)``: every line written so far."""
    lines = spark.read.text(out)
    if "stem" not in lines.columns:   # no source had output
        lines = lines.where(F.lit(False)).withColumn("stem", F.lit(None))
    return lines.select("value", F.col("stem").cast("string").alias("stem"))


def read_rejects(spark: SparkSession, out: str) -> DataFrame:
    """``path, row, reason, stem``: every game left out so far and why; files that gave nothing, while that holds."""
    if not _exists(spark, f"{out}/{REJECTS}"):
        return spark.createDataFrame([], REJECT_SCHEMA)
    rows = spark.read.schema(REJECT_SCHEMA).parquet(f"{out}/{REJECTS}")
    # a file that has been read to its end since is no reject any more
    mended = read_manifest(spark, out).where("rows = expected").select("stem")
    return rows.where("row IS NOT NULL").unionByName(rows.where("row IS NULL").join(mended, "stem", "left_anti"))


def judged_games(games: DataFrame, cfg: CorpusConfig, converter=None, mode: str = "lenient") -> DataFrame:
    """``path, row, reason, value``: one row per game of ``games`` (with ``path`` and ``row``), kept ones with their line."""
    reason = corpus_reject_reason(cfg, mode)
    first = games.select("path", "row", reason.alias("reason"), F.when(reason.isNull(), F.col("movetext")).alias("movetext"))
    if converter is None:
        conv = clean_movetext_df(first, "movetext")
        out_of = None
    else:
        where = scratch_dir(games.sparkSession, "games")       # read by the distinct texts and by the join back
        first.write.parquet(where)
        first = games.sparkSession.read.schema(first.schema).parquet(where)
        out_of = first.where("reason IS NOT NULL")
        conv = convert_games(first.where("reason IS NULL"), "movetext", converter)
    short = F.when(F.coalesce(F.size("tokens"), F.lit(0)) < cfg.min_plies, F.lit("too_short"))
    conv = conv.select("path", "row", F.coalesce("reason", "reject_reason", short).alias("reason"), "tokens")
    conv = conv.select("path", "row", "reason", F.when(F.col("reason").isNull(), join_ws("tokens")).alias("value"))
    return conv if out_of is None else conv.union(out_of.select("path", "row", "reason", F.lit(None).cast("string")))


def _prepare_files(spark: SparkSession, files: list[str], out: str, cfg: CorpusConfig, converter, mode: str) -> dict:
    """Prepare the pending ones of ``files``; this call's totals."""
    none = {"rows": 0, "passed": 0, "kept": 0}
    if not files:
        return none
    planned = spark.createDataFrame([(f,) for f in files], "path string").withColumn("stem", source_stem("path"))
    pending = pending_inputs(planned, read_manifest(spark, out)).select("path", "stem").collect()   # a row per file
    if not pending:
        return none
    games = games_of(spark, [r.path for r in pending])
    where = scratch_dir(spark, "judged")
    # few files, as in a batch of the stream, are read by few tasks: the games are judged by all
    placed = spread_narrow_scan(games.withColumn("row", F.col("_metadata.row_index")))
    judged_games(placed, cfg, converter, mode).write.parquet(where)
    judged = spark.read.schema("path string, row long, reason string, value string").parquet(where)
    reason = F.col("reason")
    seen = judged.groupBy("path").agg(
        F.count("*").alias("rows"), F.count_if(~F.coalesce(reason.isin(*FILTER_REASONS), F.lit(False))).alias("passed"),
        F.count_if(reason.isNull()).alias("kept"))
    expected = games.groupBy("path").agg(F.count("*").alias("expected"))   # footers only: no column is read for it
    found = seen.join(expected, "path", "full").withColumn("stem", source_stem("path")).checkpoint()   # a row per file
    done = spark.createDataFrame([(r.stem,) for r in pending], "stem string").distinct().join(
        found.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("rows", "passed", "kept", "expected")]), "stem", "left")
    whole = F.col("rows").eqNullSafe(F.col("expected")) & F.col("rows").isNotNull()
    done = done.withColumn("whole", whole).select(
        "stem", "whole", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("rows", "passed")],
        F.when(whole, F.col("kept")).otherwise(0).cast("bigint").alias("kept"), "expected").checkpoint()
    # a row per file, as the listing that the driver holds
    finished = F.broadcast(found.join(done.where("whole"), "stem").select("path", "stem"))
    told = judged.join(finished, "path")
    # sources side by side in few files; a source with very many games is split over several
    (told.where("reason IS NULL").select("stem", "value")
         .hint("rebalance", "stem").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("stem").text(out))
    torn = done.where("NOT whole").select(
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("row"),
        F.when(F.col("expected").isNull(), UNREADABLE).otherwise(PARTLY_READ).alias("reason"), "stem")
    (told.where("reason IS NOT NULL").select("path", "row", "reason", "stem").union(torn)
         .hint("rebalance", "stem").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("stem").parquet(f"{out}/{REJECTS}"))
    done.drop("whole").write.mode("append").parquet(f"{out}/{MANIFEST}")
    return done.agg(*[F.sum(c).alias(c) for c in none]).first().asDict()


def prepare(spark: SparkSession, path: str, out: str, cfg: CorpusConfig = CorpusConfig(),
            converter: Callable[[str | None], list | None] | None = None,
            limit_files: int | None = None, mode: str = "lenient") -> dict:
    """Batch corpus preparation; returns this run's totals ``{rows, passed, kept}``.

    A source whose manifest row shows output is skipped; one without output, or
    unreadable before, is tried again and replaces only its own folder.  An
    unreadable file is reported with (0, 0, 0).  A source is written only if the
    converting read saw as many rows as its footer tells: a tolerant read ends a
    damaged file at the first error.  One that it read in part has the rows it
    saw, nothing kept, and stays pending (``unfinished_sources``).  Games left
    out are listed with their reason (``read_rejects``), as are such files.
    ``mode="lenient"`` rejects malformed ratings; ``"strict"`` keeps the reference's
    failing cast."""
    return _prepare_files(spark, list_corpus(spark, path, limit_files), out, cfg, converter, mode)


def prepare_stream(spark: SparkSession, path: str, out: str, checkpoint: str,
                   cfg: CorpusConfig = CorpusConfig(), files_per_trigger: int = 1,
                   timeout_s: int | None = None, converter: Callable[[str | None], list | None] | None = None,
                   mode: str = "lenient") -> dict:
    """Streaming form (A5): each file landing under ``path`` is prepared as it
    arrives, with the lines, rejects and manifest rows of the batch form; returns
    the totals of this run.

    The stream's records are file names, and only the batch job opens the files:
    an unreadable or damaged one is reported and stays pending for a later
    ``prepare``, the stream goes on.  The checkpoint makes reruns skip files seen.
    A batch that is replayed after a failure replaces its sources' folders, and
    sources that it had finished are not read again."""
    totals = {"rows": 0, "passed": 0, "kept": 0}

    def sink(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r.path for r in batch.select("path").collect())     # a batch of files, by files_per_trigger
        for name, n in _prepare_files(spark, files, out, cfg, converter, mode).items():
            totals[name] += n
    run_available(stream_listing(spark, path, files_per_trigger).writeStream.foreachBatch(sink), checkpoint, timeout_s)
    return totals
