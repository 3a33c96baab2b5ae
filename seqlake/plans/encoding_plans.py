"""Registered queries: vocabulary, encoding, decoding, token store and text
round trips (SURVEY order 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.operators.encode import (encode_fixed, all_known, decode_join, encode, lookup_ids, reject_unknown,
                                     strict_encode, vocab_lookup)
from seqlake.operators.filters import max_length_filter, min_length_filter
from seqlake.operators.scoring import prefix_scorer, score_prefixes
from seqlake.operators.stats import encode_totals, length_stats, token_frequency
from seqlake.operators.vocab import (LINE_DIRECTIONS, KNIGHT_JUMPS, MOVE_PATTERN, PROMOTIONS, fixed_move_ids,
                                     learned_vocabulary, move_id_table,
                                     BOS, N_SPECIAL, fixed_tokens, move_vocabulary, seen_vocab, sketched_vocab, token_sketches)
from seqlake.operators.convert import convert_games, vocabulary_converter
from seqlake.plans.packing_plans import encoded_games, packed
from seqlake.plans.registry import register, table
from seqlake.plans.standins import CHUNK_LEN, SEED, doc_tokens, sql_tokens
from seqlake.session import landed, scratch_dir
from seqlake.sources.text import parse_ndjson, read_lines, write_lines
from seqlake.sources.tokens import (check_manifest, number_games, packing_manifest, read_tokens,
                                    read_vocab, write_manifest, write_tokens, write_vocab)


def ids_text(c):
    """Arrays are compared as text: ids joined by one space, NULL as '?'."""
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("?"))), " ")


def en_vocab(spark, sf_dir):
    """Vocabulary with unknowns: learned from the English documents only."""
    return learned_vocabulary(table(spark, sf_dir, "documents").where(F.col("lang") == "en"))


SQL_DT = f"dt AS (SELECT doc_id, source AS shard, lang, {sql_tokens('text')} AS tokens FROM documents)"
SQL_EN_VOCAB = """vocab AS (
  SELECT token, (row_number() OVER (ORDER BY token) + 3)::INTEGER AS id
  FROM (SELECT DISTINCT unnest(tokens) AS token FROM dt WHERE lang = 'en'))"""
SQL_ALL_VOCAB = """vocab AS (
  SELECT token, (row_number() OVER (ORDER BY token) + 3)::INTEGER AS id
  FROM (SELECT DISTINCT unnest(tokens) AS token FROM dt))"""
SQL_LOOKED = """el AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM dt),
lk AS (
  SELECT el.doc_id, count(v.id) AS n_known,
         string_agg(coalesce(v.id::VARCHAR, '?'), ' ' ORDER BY el.pos) AS ids_text
  FROM el LEFT JOIN vocab v ON v.token = el.token GROUP BY el.doc_id),
looked AS (
  SELECT dt.doc_id, dt.shard, len(dt.tokens) AS n_tok, coalesce(lk.n_known, 0) AS n_known,
         coalesce(lk.ids_text, '') AS ids_text
  FROM dt LEFT JOIN lk ON lk.doc_id = dt.doc_id)"""
SQL_SPECIALS = "SELECT * FROM (VALUES ('PAD', 0), ('BOS', 1), ('EOS', 2), ('MASK', 3)) s(token, id)"


def _sql_moves() -> str:
    offs = [(df * d, dr * d) for df, dr in LINE_DIRECTIONS for d in range(1, 8)] + KNIGHT_JUMPS
    vals = ", ".join(f"({a}, {b})" for a, b in offs)
    promos = ", ".join(f"('{p}')" for p in PROMOTIONS)
    return f"""
sq AS (SELECT (i % 8)::INTEGER AS f, (i // 8)::INTEGER AS r FROM range(64) t(i)),
offs AS (SELECT * FROM (VALUES {vals}) o(df, dr)),
moves AS (
  SELECT DISTINCT chr(97 + f) || (r + 1) || chr(97 + f + df) || (r + dr + 1) AS token
  FROM sq, offs WHERE f + df BETWEEN 0 AND 7 AND r + dr BETWEEN 0 AND 7
  UNION
  SELECT chr(97 + f) || (r + 1) || chr(97 + f + d) || (CASE WHEN r = 6 THEN 8 ELSE 1 END) || p
  FROM sq, (SELECT unnest([-1, 0, 1]) AS d), (VALUES {promos}) pr(p)
  WHERE r IN (1, 6) AND f + d BETWEEN 0 AND 7),
mvocab AS (
  {SQL_SPECIALS}
  UNION ALL
  SELECT token, (row_number() OVER (ORDER BY token) + 3)::INTEGER FROM moves)"""


@register("move_vocabulary", f"""
WITH {SQL_DT}, {_sql_moves()},
freq AS (SELECT unnest(tokens) AS token, count(*) AS n FROM dt GROUP BY 1)
SELECT m.token, m.id, coalesce(f.n, 0)::BIGINT AS n_seen FROM mvocab m LEFT JOIN freq f USING (token)
""")
def q_move_vocabulary(spark, sf_dir):
    tokens = doc_tokens(spark, sf_dir).select(F.explode("tokens").alias("token"))
    return seen_vocab(tokens, move_vocabulary(spark))


@register("assign_ids", f"""
WITH {SQL_DT}, {SQL_ALL_VOCAB}
{SQL_SPECIALS} UNION ALL SELECT token, id FROM vocab
""")
def q_assign_ids(spark, sf_dir):
    return learned_vocabulary(table(spark, sf_dir, "documents"))


@register("vocab_lookup", f"""
WITH {SQL_DT}, {SQL_EN_VOCAB}, {SQL_LOOKED}
SELECT doc_id, ids_text FROM looked
""")
def q_vocab_lookup(spark, sf_dir):
    looked = vocab_lookup(doc_tokens(spark, sf_dir), "doc_id", "tokens", en_vocab(spark, sf_dir))
    return looked.select("doc_id", ids_text("ids").alias("ids_text"))


@register("reject_unknown", f"""
WITH {SQL_DT}, {SQL_EN_VOCAB}, {SQL_LOOKED}
SELECT doc_id, CASE WHEN n_tok = 0 THEN 'empty' WHEN n_known < n_tok THEN 'unknown_token' END AS reject_reason
FROM looked
""")
def q_reject_unknown(spark, sf_dir):
    out = reject_unknown(doc_tokens(spark, sf_dir), "doc_id", "tokens", en_vocab(spark, sf_dir))
    return out.select("doc_id", "reject_reason")


@register("encode", f"""
WITH {SQL_DT}, {SQL_EN_VOCAB}, {SQL_LOOKED}
SELECT doc_id, (n_tok + 2)::INTEGER AS len, '1 ' || ids_text || ' 2' AS ids_text
FROM looked WHERE n_tok > 0 AND n_known = n_tok
""")
def q_encode(spark, sf_dir):
    out = encode(doc_tokens(spark, sf_dir), "doc_id", "tokens", en_vocab(spark, sf_dir), carry=[])
    return out.select("doc_id", "len", ids_text("ids").alias("ids_text"))


@register("strict_encode", f"""
WITH {SQL_DT}, {SQL_EN_VOCAB}, {SQL_LOOKED}
SELECT doc_id, '1 ' || ids_text AS ids_text FROM looked WHERE n_tok > 0 AND n_known = n_tok
""")
def q_strict_encode(spark, sf_dir):
    """Serving encode (error on unknown) over the games that B7 accepts."""
    vocab = en_vocab(spark, sf_dir)
    docs = doc_tokens(spark, sf_dir)
    good = lookup_ids(docs, "doc_id", "tokens", vocab, "_chk").where(all_known("_chk")).drop("_chk")
    good = landed(good.select("doc_id", "tokens"), "known")       # the second lookup reads it more than once
    out = strict_encode(good, "doc_id", "tokens", vocab)
    return out.select("doc_id", ids_text("ids").alias("ids_text"))


@register("decode_ids", f"""
WITH {SQL_DT}, {SQL_EN_VOCAB},
el AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM dt)
SELECT dt.doc_id,
       count(el.pos) AS n_tokens,
       md5(coalesce(string_agg(CASE WHEN v.id IS NULL THEN '?' ELSE el.token END, ' ' ORDER BY el.pos), '')) AS decoded_md5
FROM dt LEFT JOIN el ON el.doc_id = dt.doc_id LEFT JOIN vocab v ON v.token = el.token
GROUP BY dt.doc_id
""")
def q_decode_ids(spark, sf_dir):
    """ids (C1, unknown = NULL) -> tokens, unknown -> '?'; a digest of every text's whole decoding."""
    vocab = en_vocab(spark, sf_dir)
    looked = landed(lookup_ids(doc_tokens(spark, sf_dir), "doc_id", "tokens", vocab, carry=[]), "looked")
    dec = decode_join(looked, "doc_id", "ids", vocab)
    return dec.select("doc_id", F.size("decoded").cast("bigint").alias("n_tokens"),
                      F.md5(F.array_join("decoded", " ")).alias("decoded_md5"))


SQL_FULL = f"""{SQL_DT}, {SQL_ALL_VOCAB}, {SQL_LOOKED},
enc AS (SELECT doc_id, shard, (n_tok + 2)::INTEGER AS len, '1 ' || ids_text || ' 2' AS ids_text
        FROM looked WHERE n_tok > 0),
numbered AS (
  SELECT shard, doc_id, len, ids_text,
         (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::INTEGER AS game_no,
         (sum(len) OVER (PARTITION BY shard ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS "end"
  FROM enc)"""


@register("max_length_filter", f"""
WITH {SQL_FULL}
SELECT doc_id, len FROM enc WHERE len <= {CHUNK_LEN}
""")
def q_max_length_filter(spark, sf_dir):
    return max_length_filter(encoded_games(spark, sf_dir), "len", CHUNK_LEN).select("doc_id", "len")


@register("length_stats", f"""
WITH {SQL_FULL}
SELECT count(len) AS n, round(avg(len), 6) AS mean_len, quantile_cont(len, 0.5)::DOUBLE AS median_len FROM enc
""")
def q_length_stats(spark, sf_dir):
    return length_stats(encoded_games(spark, sf_dir), "len")


@register("token_frequency", f"""
WITH {SQL_DT}
SELECT unnest(tokens) AS token, count(*) AS n FROM dt GROUP BY 1
""")
def q_token_frequency(spark, sf_dir):
    return token_frequency(doc_tokens(spark, sf_dir), "tokens")


@register("seen_vocab", f"""
WITH {SQL_DT}, {SQL_EN_VOCAB},
seen AS (SELECT DISTINCT unnest(tokens) AS token FROM dt WHERE len(tokens) >= 20)
SELECT (SELECT count(*) FROM seen) AS n_distinct_seen, count(*) AS n_vocab,
       count(s.token) AS n_vocab_seen, round(count(s.token) / count(*), 6) AS coverage
FROM vocab v LEFT JOIN seen s USING (token)
""")
def q_seen_vocab(spark, sf_dir):
    filt = min_length_filter(doc_tokens(spark, sf_dir), "tokens", 20)
    toks = filt.select(F.explode("tokens").alias("token"))
    vocab = en_vocab(spark, sf_dir).where(F.col("id") >= 4)
    cov = seen_vocab(toks, vocab)
    n_seen = toks.distinct().agg(F.count("*").alias("n_distinct_seen"))
    summ = cov.agg(F.count("*").alias("n_vocab"), F.count_if(F.col("n_seen") > 0).alias("n_vocab_seen"))
    one = F.lit(1).alias("_one")
    return (n_seen.select("*", one).join(F.broadcast(summ.select("*", one)), "_one").drop("_one")
                  .withColumn("coverage", F.round(F.col("n_vocab_seen") / F.col("n_vocab"), 6)))


@register("encode_totals", f"""
WITH {SQL_DT}, {SQL_EN_VOCAB}, {SQL_LOOKED}
SELECT shard, count(*) FILTER (WHERE n_tok > 0 AND n_known = n_tok) AS n_games,
       count(*) FILTER (WHERE NOT (n_tok > 0 AND n_known = n_tok)) AS n_skipped,
       coalesce(sum(n_tok + 2) FILTER (WHERE n_tok > 0 AND n_known = n_tok), 0)::BIGINT AS n_tokens,
       grouping(shard) = 1 AS is_total,
       2 * coalesce(sum(n_tok + 2) FILTER (WHERE n_tok > 0 AND n_known = n_tok), 0)::BIGINT AS n_bytes
FROM looked GROUP BY ROLLUP (shard)
""")
def q_encode_totals(spark, sf_dir):
    enc = encode(doc_tokens(spark, sf_dir), "doc_id", "tokens", en_vocab(spark, sf_dir), keep_rejects=True)
    return encode_totals(enc, "shard", "len", skipped=F.col("reject_reason").isNotNull())


@register("running_offsets", f"""
WITH {SQL_FULL}
SELECT shard, doc_id, game_no, "end" - len AS start, "end" FROM numbered
""")
def q_running_offsets(spark, sf_dir):
    games = encoded_games(spark, sf_dir).select("shard", "doc_id", "len")     # no token takes part in the numbering
    return number_games(games).select("shard", "doc_id", "game_no", "start", "end")


def _store(spark, sf_dir):
    path = scratch_dir(spark, "tokens")
    enc = landed(encoded_games(spark, sf_dir), "encoded")     # read for the range bounds, then for the blocks
    games = number_games(enc).withColumnRenamed("ids", "tokens")
    write_tokens(games, path)
    return path


@register("write_tokens", f"""
WITH {SQL_FULL}
SELECT shard, game_no, len, "end" - len AS start, "end", ids_text FROM numbered
""")
def q_write_tokens(spark, sf_dir):
    store = read_tokens(spark, _store(spark, sf_dir))
    return store.select("shard", "game_no", "len", "start", "end", ids_text("tokens").alias("ids_text"))


@register("read_tokens", f"""
WITH {SQL_FULL}
SELECT shard, game_no, len, "end" - len AS start, "end", ids_text FROM numbered WHERE shard = 'src3'
""")
def q_read_tokens(spark, sf_dir):
    store = read_tokens(spark, _store(spark, sf_dir), shard="src3")
    return store.select("shard", "game_no", "len", "start", "end", ids_text("tokens").alias("ids_text"))


@register("read_vocab", f"""
WITH {SQL_DT}, {SQL_EN_VOCAB}
SELECT id, token FROM ({SQL_SPECIALS} UNION ALL SELECT token, id FROM vocab)
""")
def q_read_vocab(spark, sf_dir):
    path = scratch_dir(spark, "vocab")
    write_vocab(en_vocab(spark, sf_dir), path)
    return read_vocab(spark, path).select("id", "token")


@register("packing_manifest", f"""
SELECT {CHUNK_LEN} AS chunk_len, {SEED}::BIGINT AS seed, string_agg(DISTINCT source, ',' ORDER BY source) AS shards
FROM documents WHERE len({sql_tokens('text')}) BETWEEN 1 AND {CHUNK_LEN - 2}
""")
def q_packing_manifest(spark, sf_dir):
    path = scratch_dir(spark, "manifest")
    write_manifest(packing_manifest(packed(spark, sf_dir), CHUNK_LEN, SEED), path)
    m = check_manifest(spark, path, CHUNK_LEN - 1)
    return m.select("chunk_len", "seed", F.array_join("shards", ",").alias("shards"))


@register("write_lines", f"""
WITH {SQL_DT}
SELECT shard AS stem, array_to_string(tokens, ' ') AS value FROM dt WHERE len(tokens) > 0
""")
def q_write_lines(spark, sf_dir):
    path = scratch_dir(spark, "lines")
    write_lines(doc_tokens(spark, sf_dir).withColumnRenamed("shard", "stem"), path, "tokens", "stem")
    return read_lines(spark, path).select("stem", "value")


@register("read_lines", """
SELECT value FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) WHERE length(value) > 0
""")
def q_read_lines(spark, sf_dir):
    path = scratch_dir(spark, "raw")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return read_lines(spark, path)


@register("parse_ndjson", """
SELECT event_id, user_id, event_type, json_extract(props, '$.k')::INTEGER AS k FROM events
""")
def q_parse_ndjson(spark, sf_dir):
    path = scratch_dir(spark, "ndjson")
    ev = table(spark, sf_dir, "events")
    (ev.select(F.to_json(F.struct("event_id", "user_id", "event_type",
                                  F.from_json("props", "k int").alias("props"))).alias("value"))
       .write.text(path))
    schema = "event_id bigint, user_id bigint, event_type string, props struct<k: int>"
    parsed = parse_ndjson(spark.read.text(path), schema)
    return parsed.select("event_id", "user_id", "event_type", F.col("props.k").alias("k"))


@register("move_lookup_paths", f"""
WITH {SQL_DT}, t AS (SELECT unnest(tokens) AS token FROM dt)
SELECT count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(token, '{MOVE_PATTERN}')) AS n_move_like,
       0::BIGINT AS n_disagree
FROM t
""")
def q_move_lookup_paths(spark, sf_dir):
    """The arithmetic-index path and the join path agree on every token of
    the corpus (moves get their id, anything else NULL)."""
    vocab = move_vocabulary(spark)
    docs = doc_tokens(spark, sf_dir)
    joined = lookup_ids(docs, "doc_id", "tokens", vocab, "ids_join")
    both = joined.withColumn("ids_arith", fixed_move_ids("tokens", move_id_table(vocab)))
    differ = F.size(F.filter(F.zip_with("ids_join", "ids_arith", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    like = F.size(F.filter("tokens", lambda t: F.regexp_like(t, F.lit(MOVE_PATTERN))))
    return both.agg(F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
                    F.sum(like).cast("bigint").alias("n_move_like"),
                    F.sum(differ).cast("bigint").alias("n_disagree"))


def move_games(spark, sf_dir):
    """Coordinate moves made from every text: token i of length L becomes a move along its file (always in the
    vocabulary); one-letter tokens at every fifth place become a move to their own square, long tokens stay words."""
    sq = lambda f, r: F.concat(F.char(F.lit(97) + f), F.char(F.lit(49) + r))

    def move(t, i):
        n = F.length(t)
        f, r = (i + n) % 8, (i * 3) % 8
        up = F.when((n == 1) & (i % 5 == 0), 0).otherwise(1 + n % 7)
        return F.when(n > 14, t).otherwise(F.concat(sq(f, r), sq(f, (r + up) % 8)))
    return doc_tokens(spark, sf_dir).select("doc_id", F.transform("tokens", move).alias("tokens"))


@register("encode_moves", f"""
WITH {SQL_DT}, {_sql_moves()},
t AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM dt),
m AS (SELECT doc_id, i, CASE WHEN length(token) > 14 THEN token ELSE
             chr((97 + (i + length(token)) % 8)::INTEGER) || chr((49 + (i * 3) % 8)::INTEGER) || chr((97 + (i + length(token)) % 8)::INTEGER)
             || chr((49 + ((i * 3) % 8 + CASE WHEN length(token) = 1 AND i % 5 = 0 THEN 0 ELSE 1 + length(token) % 7 END) % 8)::INTEGER)
             END AS token FROM t),
e AS (SELECT doc_id, count(*) AS n, count(v.id) AS known, string_agg(v.id::VARCHAR, ' ' ORDER BY i) AS ids
      FROM m LEFT JOIN mvocab v ON v.token = m.token AND v.id >= 4 GROUP BY doc_id),
r AS (SELECT dt.doc_id, CASE WHEN e.n IS NULL THEN 'empty' WHEN known < e.n THEN 'unknown_token' END AS reject_reason, e.n, e.ids
      FROM dt LEFT JOIN e ON e.doc_id = dt.doc_id)
SELECT doc_id, reject_reason, CASE WHEN reject_reason IS NULL THEN (n + 2)::INTEGER END AS len,
       CASE WHEN reject_reason IS NULL THEN md5('1 ' || ids || ' 2') END AS ids_md5
FROM r
""")
def q_encode_moves(spark, sf_dir):
    out = encode_fixed(move_games(spark, sf_dir), "tokens", move_id_table(move_vocabulary(spark)), keep_rejects=True)
    return out.select("doc_id", "reject_reason", F.when(F.col("ids").isNotNull(), F.col("len")).alias("len"),
                      F.md5(ids_text("ids")).alias("ids_md5"))


@register("convert_moves", f"""
WITH {SQL_DT}, {_sql_moves()},
t AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM dt),
m AS (SELECT doc_id, i, CASE WHEN length(token) > 14 THEN token ELSE
             chr((97 + (i + length(token)) % 8)::INTEGER) || chr((49 + (i * 3) % 8)::INTEGER) || chr((97 + (i + length(token)) % 8)::INTEGER)
             || chr((49 + ((i * 3) % 8 + CASE WHEN length(token) = 1 AND i % 5 = 0 THEN 0 ELSE 1 + length(token) % 7 END) % 8)::INTEGER)
             END AS token FROM t),
e AS (SELECT doc_id, count(*) AS n, count(v.id) AS known, string_agg(m.token, ' ' ORDER BY i) AS text
      FROM m LEFT JOIN mvocab v ON v.token = m.token AND v.id >= 4 GROUP BY doc_id)
SELECT dt.doc_id, CASE WHEN e.n IS NULL OR known < e.n THEN 'unparseable' END AS reject_reason,
       CASE WHEN known = e.n THEN e.n::INTEGER END AS n_tokens, CASE WHEN known = e.n THEN md5(e.text) END AS digest
FROM dt LEFT JOIN e ON e.doc_id = dt.doc_id
""")
def q_convert_moves(spark, sf_dir):
    """H2 with the built-in converter: a text is a game if all its tokens are moves of the vocabulary."""
    texts = move_games(spark, sf_dir).select("doc_id", F.array_join("tokens", " ").alias("text"))
    out = convert_games(texts, "text", vocabulary_converter(fixed_tokens(spark)[N_SPECIAL:]))
    return out.select("doc_id", "reject_reason", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@register("seen_vocab_sketch", f"""
WITH {SQL_DT}, t AS (SELECT shard, unnest(tokens) AS token FROM dt)
SELECT shard, count(*) AS n_tokens, true AS near, grouping(shard) = 1 AS is_total FROM t GROUP BY ROLLUP (shard)
""")
def q_seen_vocab_sketch(spark, sf_dir):
    """D16, monitoring mode: sketches per shard, written in two increments and united at reading, stay within five
    standard errors of the exact counts."""
    docs = doc_tokens(spark, sf_dir)
    path = scratch_dir(spark, "sketches")
    for part in (F.col("lang") == "en", F.coalesce(F.col("lang") != "en", F.lit(True))):
        token_sketches(docs.where(part).select("shard", F.explode("tokens").alias("token")), "shard").write.mode("append").parquet(path)
    sketches = spark.read.parquet(path)
    total = F.lit(None).cast("string").alias("shard")
    told = sketched_vocab(sketches, "shard").withColumn("is_total", F.lit(False)).unionByName(
        sketched_vocab(sketches).select(total, "n_distinct", "n_tokens", F.lit(True).alias("is_total")))
    tokens = docs.select("shard", F.explode("tokens").alias("token")).distinct()
    exact = tokens.groupBy("shard").agg(F.count("*").alias("exact")).withColumn("is_total", F.lit(False)).unionByName(
        tokens.agg(F.count_distinct("token").alias("exact")).select(total, "exact", F.lit(True).alias("is_total")))
    same = told["shard"].eqNullSafe(exact["shard"]) & (told["is_total"] == exact["is_total"])
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 5 * 0.009 * F.col("exact"))
    return told.join(exact, same).select(told["shard"], "n_tokens", near.alias("near"), told["is_total"])


#: Context length of the scorer and its number of outputs.
PREFIX_LEN, PREFIX_OUT = CHUNK_LEN - 1, 16


@register("score_prefixes", f"""
WITH {SQL_DT}, {SQL_EN_VOCAB},
el AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM dt),
known AS (SELECT el.doc_id, count(v.id) AS n_known FROM el LEFT JOIN vocab v USING (token) GROUP BY el.doc_id),
told AS (SELECT dt.doc_id, (len(tokens) + 1)::INTEGER AS n_ids,
                CASE WHEN coalesce(n_known, 0) < len(tokens) THEN 'unknown_token'
                     WHEN len(tokens) + 1 > {PREFIX_LEN} THEN 'too_long' END AS reason
         FROM dt LEFT JOIN known USING (doc_id)),
ids AS (SELECT doc_id, 0 AS pos, {BOS} AS id FROM told WHERE reason IS NULL
        UNION ALL SELECT el.doc_id, el.pos, v.id FROM el JOIN vocab v USING (token)
        JOIN told ON told.doc_id = el.doc_id AND told.reason IS NULL),
o AS (SELECT doc_id, i, sum((id * 7 + pos * 3 + i * 13) % 17 - 8) / 8.0 AS logit
      FROM ids, range({N_SPECIAL}, {PREFIX_OUT}) r(i) GROUP BY doc_id, i),
best AS (SELECT doc_id, arg_max(i, (logit, i))::INTEGER AS top_id, max(logit)::DOUBLE AS top_logit FROM o GROUP BY doc_id)
SELECT told.doc_id, n_ids, reason, top_id, top_logit FROM told LEFT JOIN best USING (doc_id)
""")
def q_score_prefixes(spark, sf_dir):
    """Every document as the prefix of a game, scored at its last position; those that cannot be, with the reason."""
    looked = lookup_ids(doc_tokens(spark, sf_dir), "doc_id", "tokens", en_vocab(spark, sf_dir), "_ids", carry=[])
    prefix = F.concat(F.array(F.lit(BOS)), F.coalesce("_ids", F.array().cast("array<int>")))
    told = looked.select("doc_id", prefix.alias("ids"))
    out = score_prefixes(told, "ids", prefix_scorer(PREFIX_OUT), PREFIX_OUT, PREFIX_LEN)
    best = F.array_max(F.transform("logits", lambda x, i: F.struct(x.alias("l"), i.alias("i"))))
    return out.select("doc_id", F.size("ids").alias("n_ids"), "reason", best["i"].alias("top_id"), best["l"].alias("top_logit"))
