"""Registered queries: scans, corpus filters and the funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.operators.filters import (INT_TEXT, CorpusConfig, base_seconds, corpus_condition,
                                       corpus_filter, min_length_filter, rating_filter,
                                       termination_filter, threshold_sweep, time_control_filter)
from seqlake.operators.stats import funnel
from seqlake.plans.registry import register, table
from seqlake.plans.standins import SQL_DOC_TOKENS, doc_tokens
from seqlake.prepare import GAME_SCHEMA, prepare, prepare_stream, read_manifest, read_prepared, read_rejects
from seqlake.session import scratch_dir
from seqlake.sources.corpus import (count_scan, list_corpus, missing_files, pending_inputs, quarantine,
                                    rows_per_file, scan_corpus, scan_tolerant, shard_pairs, source_stem)

# Stand-in thresholds: customer numbers and order prices replace ratings, the
# order priority "3-MEDIUM" replaces a time control "180+2", line items are plies.
GAME_CFG = CorpusConfig(min_rating=300, min_base_seconds=2, min_plies=3, tc_separator="-")
SWEEP = [100, 300, 700, 1000, 1400]


def games(spark, sf_dir):
    """Game relation: (game_id, WhiteElo, BlackElo, TimeControl, Termination, game_date, n_plies)."""
    orders = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    plies = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.count("*").alias("n_plies")))
    return (orders.join(cust, orders.o_custkey == cust.c_custkey)
                  .join(plies, orders.o_orderkey == plies.l_orderkey, "left")
                  .select(F.col("o_orderkey").alias("game_id"),
                          F.split_part("c_name", F.lit("#"), F.lit(2)).alias("WhiteElo"),
                          F.floor(F.col("o_totalprice") / 100).cast("bigint").cast("string").alias("BlackElo"),
                          F.col("o_orderpriority").alias("TimeControl"),
                          F.col("o_orderstatus").alias("Termination"),
                          F.col("o_orderdate").alias("game_date"),
                          F.coalesce("n_plies", F.lit(0)).alias("n_plies")))


SQL_GAMES = """
games AS (
  SELECT o.o_orderkey AS game_id, split_part(c.c_name, '#', 2) AS WhiteElo,
         CAST(CAST(floor(o.o_totalprice / 100) AS BIGINT) AS VARCHAR) AS BlackElo,
         o.o_orderpriority AS TimeControl, o.o_orderstatus AS Termination,
         o.o_orderdate AS game_date, coalesce(l.n, 0) AS n_plies
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey)
"""

SQL_BASE = (f"CASE WHEN regexp_matches(split_part(coalesce(TimeControl, '-'), '-', 1), '{INT_TEXT}') "
            "THEN TRY_CAST(trim(split_part(coalesce(TimeControl, '-'), '-', 1)) AS INTEGER) END")
SQL_COND = (f"{SQL_BASE} >= {GAME_CFG.min_base_seconds} AND CAST(WhiteElo AS INTEGER) > {GAME_CFG.min_rating} "
            f"AND CAST(BlackElo AS INTEGER) > {GAME_CFG.min_rating}")

TABLE_NAMES = ("benchmark conversations customer documents embeddings events labels lineitem "
               "nation orders pages part region supplier").split()


@register("scan_corpus", "\nUNION ALL\n".join(
    f"SELECT '{t}.parquet' AS file_name, count(*) AS n_rows FROM {t}" for t in TABLE_NAMES))
def q_scan_corpus(spark, sf_dir):
    return rows_per_file(scan_corpus(spark, sf_dir))


@register("count_scan", "SELECT count(*) AS n_rows FROM lineitem")
def q_count_scan(spark, sf_dir):
    return count_scan(table(spark, sf_dir, "lineitem", spread=False))   # answered from footers


@register("source_stem", """
SELECT regexp_extract(p, '([^/]+)/([^/]+)\\.parquet$', 1) || '_' || regexp_extract(p, '([^/]+)/([^/]+)\\.parquet$', 2) AS stem,
       count(*) AS n_docs
FROM (SELECT '/corpus/' || lang || '/' || source || '.parquet' AS p FROM documents) GROUP BY 1
""")
def q_source_stem(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    paths = docs.select(F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit(".parquet")).alias("p"))
    return paths.groupBy(source_stem("p").alias("stem")).agg(F.count("*").alias("n_docs"))


@register("pending_inputs", """
SELECT o_orderkey AS stem FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 25) > 0)
""")
def q_pending_inputs(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stem"))
    done = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("stem"))
            .agg(F.count_if(F.col("l_quantity") > 25).alias("kept")))   # 0: processed without output, tried again
    return pending_inputs(files, done)


@register("quarantine", """
SELECT source, CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'empty'
                    WHEN strlen(text) <> length(text) THEN 'non_ascii' END AS reject_reason,
       count(*) AS n
FROM documents GROUP BY ALL
""")
def q_quarantine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    checked = quarantine(docs, [
        ("empty", F.col("text").isNull() | (F.length(F.trim("text")) == 0)),
        ("non_ascii", F.octet_length("text") != F.length("text")),
    ])
    return checked.groupBy("source", "reject_reason").agg(F.count("*").alias("n"))


@register("shard_pairs", """
SELECT name, (row_number() OVER (ORDER BY name) - 1)::BIGINT AS shard_idx
FROM (SELECT DISTINCT n_name AS name FROM nation
      WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0))
""")
def q_shard_pairs(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    idx_files = nation.select(F.col("n_name").alias("name"))
    sup = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0)
    bin_files = nation.join(sup, nation.n_nationkey == sup.s_nationkey, "left_semi") \
                      .select(F.col("n_name").alias("name"))
    return shard_pairs(idx_files, bin_files).select("name", "shard_idx")


@register("rating_filter", f"""
WITH {SQL_GAMES}
SELECT game_id FROM games
WHERE CAST(WhiteElo AS INTEGER) > {GAME_CFG.min_rating} AND CAST(BlackElo AS INTEGER) > {GAME_CFG.min_rating}
""")
def q_rating_filter(spark, sf_dir):
    return rating_filter(games(spark, sf_dir), GAME_CFG.min_rating).select("game_id")


@register("time_control_filter", f"""
WITH {SQL_GAMES}
SELECT game_id, {SQL_BASE} AS base_seconds FROM games WHERE {SQL_BASE} >= {GAME_CFG.min_base_seconds}
""")
def q_time_control_filter(spark, sf_dir):
    g = time_control_filter(games(spark, sf_dir), GAME_CFG.min_base_seconds, sep="-")
    return g.select("game_id", base_seconds("TimeControl", "-").alias("base_seconds"))


@register("corpus_filter", f"""
WITH {SQL_GAMES}
SELECT game_id, n_plies FROM games WHERE {SQL_COND}
""")
def q_corpus_filter(spark, sf_dir):
    return corpus_filter(games(spark, sf_dir), GAME_CFG, project=("game_id", "n_plies"))


@register("min_length_filter", f"""
SELECT doc_id, len(tokens)::INTEGER AS n_tokens FROM ({SQL_DOC_TOKENS}) WHERE len(tokens) >= 20
""")
def q_min_length_filter(spark, sf_dir):
    return (min_length_filter(doc_tokens(spark, sf_dir), "tokens", 20)
            .select("doc_id", F.size("tokens").alias("n_tokens")))


@register("termination_filter", f"""
WITH {SQL_GAMES}
SELECT game_id, Termination FROM games WHERE Termination IN ('F', 'O')
""")
def q_termination_filter(spark, sf_dir):
    return termination_filter(games(spark, sf_dir), ["F", "O"]).select("game_id", "Termination")


@register("threshold_sweep", f"""
WITH {SQL_GAMES}
SELECT t AS threshold, count(*) FILTER (WHERE TRY_CAST(WhiteElo AS INTEGER) > t AND TRY_CAST(BlackElo AS INTEGER) > t) AS n_kept
FROM games, (SELECT unnest({SWEEP}) AS t) GROUP BY t
""")
def q_threshold_sweep(spark, sf_dir):
    return threshold_sweep(games(spark, sf_dir), SWEEP)


@register("funnel", f"""
WITH {SQL_GAMES}
SELECT Termination AS stem, count(*) AS n_rows,
       count(*) FILTER (WHERE {SQL_COND}) AS n_passed,
       count(*) FILTER (WHERE {SQL_COND} AND n_plies >= {GAME_CFG.min_plies}) AS n_kept,
       grouping(Termination) = 1 AS is_total
FROM games GROUP BY ROLLUP (Termination)
""")
def q_funnel(spark, sf_dir):
    g = games(spark, sf_dir)
    passed = corpus_condition(GAME_CFG)
    return funnel(g.withColumnRenamed("Termination", "stem"), "stem", passed,
                  F.col("n_plies") >= GAME_CFG.min_plies)


@register("quarantine_files", """
SELECT CAST(NULL AS VARCHAR) AS file_name, 0::BIGINT AS n_rows_filtered, 0::BIGINT AS n_rows_kept
FROM (SELECT count(*) AS n FROM lineitem UNION ALL SELECT count(*) FROM orders
      UNION ALL SELECT count(*) FROM documents UNION ALL SELECT count(*) FROM events) t
WHERE t.n = 0
""")
def q_quarantine_files(spark, sf_dir):
    """A13 file level: of the planned corpus files, those that produced no rows
    are reported as (0 filtered, 0 kept).  All driver files are readable, so the
    expected answer is empty; the scan still reads every planned file."""
    planned = list_corpus(spark, sf_dir)
    seen = scan_tolerant(spark, planned, "_none string")   # files of many schemas: only their rows are seen
    miss = missing_files(spark, planned, seen)
    return miss.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
                       F.lit(0).cast("bigint").alias("n_rows_filtered"), F.lit(0).cast("bigint").alias("n_rows_kept"))


PREPARE_CFG = CorpusConfig(min_plies=8)
_GAME_TEXT = "1. e4 {a (comment} e5! (a (b (c)) d) $3 "


def prepare_games(spark, sf_dir):
    """Game rows from orders: decorated movetext (as long as the order has lines), ratings and clocks of all kinds."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").cast("int").alias("n"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("k"))
    return o.select(
        F.concat(F.repeat(F.lit(_GAME_TEXT), F.col("n")), F.when(F.col("k") % 17 == 0, "(").otherwise("1-0")).alias("movetext"),
        F.when(F.col("k") % 11 == 0, "?").otherwise((2000 + F.col("k") % 1500).cast("string")).alias("WhiteElo"),
        (2000 + F.col("o_custkey") % 1500).cast("string").alias("BlackElo"),
        F.when(F.col("k") % 13 == 0, "-").otherwise(F.concat((F.col("k") % 700).cast("string"), F.lit("+2"))).alias("TimeControl"),
        F.col("o_orderstatus").alias("part"))


@register("prepare", """
WITH g AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS part, n
           FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
f AS (SELECT *, k % 11 <> 0 AND 2000 + k % 1500 > 2200 AND 2000 + c % 1500 > 2200 AND k % 13 <> 0 AND k % 700 >= 180 AS passed
      FROM g)
SELECT 'part=' || part AS folder, count(*) AS rows, count(*) FILTER (passed) AS passed,
       count(*) FILTER (passed AND k % 17 <> 0 AND 2 * n >= 8) AS kept,
       coalesce(sum(2 * n) FILTER (passed AND k % 17 <> 0 AND 2 * n >= 8), 0)::BIGINT AS n_tokens
FROM f GROUP BY part UNION ALL SELECT 'broken', 0, 0, 0, 0
""")
def q_prepare(spark, sf_dir):
    """The whole job over game files written from the tables, one of them unreadable; the second run finds it all done
    but the unreadable file."""
    root = scratch_dir(spark, "prepare")
    prepare_games(spark, sf_dir).write.partitionBy("part").parquet(f"{root}/in")
    spark.createDataFrame([("this is no Parquet file",)], "value string").coalesce(1).write.text(f"{root}/broken")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = fs.Path(f"{root}/broken")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = [f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("part-")][0]
    files.mkdirs(fs.Path(f"{root}/in/broken"))
    files.rename(part, fs.Path(f"{root}/in/broken/file.parquet"))
    prepare(spark, f"{root}/in", f"{root}/out", PREPARE_CFG)
    again = prepare(spark, f"{root}/in", f"{root}/out", PREPARE_CFG)
    if again["kept"]:   # only sources without output are tried again
        raise AssertionError("finished sources were read again")
    folder = F.regexp_extract("stem", "^([^_]+)_", 1).alias("folder")
    totals = read_manifest(spark, f"{root}/out").groupBy(folder).agg(*[F.sum(c).alias(c) for c in ("rows", "passed", "kept")])
    tokens = read_prepared(spark, f"{root}/out").groupBy(folder).agg(F.sum(F.size(F.split("value", " "))).cast("bigint").alias("n_tokens"))
    return totals.join(tokens, "folder", "left").select("folder", "rows", "passed", "kept",
                                                        F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))


def rejected_games(spark, sf_dir):
    """Game rows from orders, as in ``prepare_games``, with every reason to be left out among them."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").cast("int").alias("n"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("k"))
    k = F.col("k")
    return o.select(
        F.when(k % 23 != 0, F.concat(F.repeat(F.lit(_GAME_TEXT), F.col("n")), F.when(k % 17 == 0, "(").otherwise("1-0")))
         .alias("movetext"),
        F.when(k % 19 != 0, F.when(k % 11 == 0, "?").otherwise((2000 + k % 1500).cast("string"))).alias("WhiteElo"),
        (2000 + F.col("o_custkey") % 1500).cast("string").alias("BlackElo"),
        F.when(k % 29 != 0, F.when(k % 13 == 0, "-").otherwise(F.concat((k % 700).cast("string"), F.lit("+2")))).alias("TimeControl"),
        F.col("o_orderstatus").alias("part"))


def _files(spark, path):
    """The file system of a path, the path, and its part files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, where, [f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("part-")]


def damaged_inputs(spark, sf_dir, root):
    """Game files under ``root/in``: a folder per order status, one file that is no Parquet file, and one with a whole
    footer (status P again) whose pages are overwritten from their middle on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    g = rejected_games(spark, sf_dir)
    g.hint("rebalance", "part").write.partitionBy("part").parquet(f"{root}/in")
    spark.createDataFrame([("this is no Parquet file",)], "value string").coalesce(1).write.text(f"{root}/broken")
    # as written just now: the orders are joined to their lines once
    written = spark.read.schema(f"{GAME_SCHEMA}, part string").parquet(f"{root}/in")
    written.where("part = 'P'").drop("part").repartition(1).write.parquet(f"{root}/torn")
    for name in ("broken", "torn"):
        files, _, parts = _files(spark, f"{root}/{name}")
        target = path(f"{root}/in/{name}/file.parquet")
        files.mkdirs(target.getParent())
        if name == "broken":
            files.rename(parts[0], target)
            continue
        raw = bytearray(spark.read.format("binaryFile").load(parts[0].toString()).first().content)
        pages = len(raw) - 8 - int.from_bytes(raw[-8:-4], "little")
        raw[4 + pages // 2:pages] = b"\xff" * (pages - 4 - pages // 2)
        out = files.create(target)
        out.write(raw)
        out.close()


SQL_REJECTED = f"""
r AS (SELECT part, n, CASE
        WHEN k % 19 = 0 THEN 'rating_missing' WHEN k % 11 = 0 THEN 'rating_malformed'
        WHEN 2000 + k % 1500 <= 2200 OR 2000 + c % 1500 <= 2200 THEN 'rating_low'
        WHEN k % 29 = 0 OR k % 13 = 0 THEN 'time_control' WHEN k % 700 < 180 THEN 'time_short'
        WHEN k % 23 = 0 THEN 'empty' WHEN k % 17 = 0 THEN 'unbalanced' WHEN 2 * n < {PREPARE_CFG.min_plies} THEN 'too_short' END AS reason
      FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS part, n
            FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey))"""


def _folder():
    return F.regexp_extract("stem", "^([^_]+)_", 1).alias("folder")


@register("prepare_rejects", f"""
WITH {SQL_REJECTED}
SELECT 'part=' || part AS folder, reason, count(*) AS n_games, 0::BIGINT AS n_files FROM r WHERE reason IS NOT NULL GROUP BY part, reason
UNION ALL SELECT 'broken', 'unreadable', 0, 1
UNION ALL SELECT 'torn', 'partly_read', 0, 1
""")
def q_prepare_rejects(spark, sf_dir):
    """Every game that ``prepare`` leaves out, by its place in its file, with the reason; damaged files among them."""
    root = scratch_dir(spark, "rejects")
    damaged_inputs(spark, sf_dir, root)
    prepare(spark, f"{root}/in", f"{root}/out", PREPARE_CFG)
    return read_rejects(spark, f"{root}/out").groupBy(_folder(), "reason").agg(
        F.count_distinct("path", "row").alias("n_games"), F.count_if(F.col("row").isNull()).alias("n_files"))


@register("prepare_stream", f"""
WITH {SQL_REJECTED}
SELECT 'part=' || part AS folder, 'done' AS state, count(*) AS expected, count(*) AS rows,
       count(*) FILTER (reason IS NULL OR reason IN ('empty', 'unbalanced', 'too_short')) AS passed,
       count(*) FILTER (reason IS NULL) AS kept, coalesce(sum(2 * n) FILTER (reason IS NULL), 0)::BIGINT AS n_tokens,
       count(*) FILTER (reason IS NOT NULL) AS rejected
FROM r GROUP BY part
UNION ALL SELECT 'broken', 'pending', 0, 0, 0, 0, 0, 0
UNION ALL SELECT 'torn', 'pending', count(*), 0, 0, 0, 0, 0 FROM r WHERE part = 'P'
""")
def q_prepare_stream(spark, sf_dir):
    """The same files as a stream, two a batch; damaged ones stay pending and the stream goes on."""
    root = scratch_dir(spark, "stream")
    damaged_inputs(spark, sf_dir, root)
    prepare_stream(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", PREPARE_CFG, files_per_trigger=2)
    whole = F.col("rows").eqNullSafe(F.col("expected"))
    sources = read_manifest(spark, f"{root}/out").withColumns({"folder": _folder(), "state": F.when(whole, "done").otherwise("pending")})
    sums = sources.groupBy("folder", "state").agg(
        F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"),
        *[F.sum(F.when(whole, F.col(c)).otherwise(0)).alias(c) for c in ("rows", "passed", "kept")])
    lines = read_prepared(spark, f"{root}/out").groupBy(_folder()).agg(
        F.sum(F.size(F.split("value", " "))).cast("bigint").alias("n_tokens"))
    rejects = read_rejects(spark, f"{root}/out").groupBy(_folder()).agg(F.count("row").alias("rejected"))
    return sums.join(lines, "folder", "left").join(rejects, "folder", "left").na.fill(0, ["n_tokens", "rejected"])
