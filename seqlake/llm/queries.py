"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.llm import (ann, html_extract, line_dedup, mixing, pii, prefix_trie, quality, runs, sentencepiece, simhash,
                         suffix_dedup, toxicity, warc)
from seqlake.llm.common import load, staged, words_of


def op1_pii(spark, sf_dir):
    out = pii.detect(load(spark, sf_dir, "documents"))
    return out.drop("findings")


def op2_mixing(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '')), 1, 13))::BIGINT
                 ::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.1, 1.0 - (length(t) - length(regexp_replace(t, '[#*$%&|<>!]', '', 'g')))::DOUBLE
                               / greatest(size, 1)::DOUBLE) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM d GROUP BY source),
-- reshare round by round: sources above twice their size are fixed there, the rest is shared again
r(round, source, source_size, w, capped) AS (
  SELECT 0, source, source_size, w, false FROM s
  UNION ALL
  SELECT * FROM (
    SELECT round + 1, source, source_size, w,
           capped OR w * (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (capped) OVER (), 0))
                     / sum(w) FILTER (NOT capped) OVER () > 2 * source_size AS now
    FROM r WHERE round < (SELECT count(*) FROM s))),
f AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (2 * source_size)::DOUBLE
              ELSE least((2 * source_size)::DOUBLE,
                   ((1.5 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) FILTER (capped) OVER (), 0)::DOUBLE)
                    / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE) * w) END AS target
  FROM r WHERE round = (SELECT count(*) FROM s)),
e AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS epochs,
             floor(target - floor(target / greatest(source_size, 1)) * source_size)::BIGINT AS rest FROM f),
p AS (SELECT k.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM k)
SELECT p.doc_id, p.size, e.source_size, e.target,
       (e.epochs * p.size + greatest(0, least(p.size, e.rest - p.before)))::BIGINT AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""


def op3_html(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op4_ann(spark, sf_dir):
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def toxicity_chain(spark, docs, sf_dir):
    """The chain over the categories that ``labels`` offers: poor quality, then toxic."""
    labels = load(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    return toxicity.train(docs, labels, ["poor", "toxic"])


def op5_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_chain(spark, docs, sf_dir))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.deduped(load(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r,
                  unnest(coalesce(string_split(text, chr(10)), [NULL])) AS raw,
                  unnest(coalesce(range(len(string_split(text, chr(10)))), [0])) AS pos FROM documents),
l AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM d),
f AS (SELECT x, length(x) AS n, min(r * 10000000 + pos) AS first FROM l WHERE length(x) >= 20 GROUP BY x),
c AS (SELECT a.x, b.x AS y, b.first FROM f a JOIN f b
        ON a.x[1:least(a.n, b.n) // 2] = b.x[1:least(a.n, b.n) // 2] AND a.n = b.n
      WHERE b.first < a.first
      UNION ALL SELECT a.x, b.x, b.first FROM f a JOIN f b ON a.n = b.n
        AND a.x[a.n - a.n // 2:] = b.x[b.n - b.n // 2:] WHERE b.first < a.first
      UNION ALL SELECT a.x, b.x, b.first FROM f a JOIN f b ON a.n = b.n + 1
        AND a.x[1:b.n // 2] = b.x[1:b.n // 2] WHERE b.first < a.first
      UNION ALL SELECT a.x, b.x, b.first FROM f a JOIN f b ON a.n = b.n + 1
        AND a.x[a.n - b.n // 2 + 1:] = b.x[b.n - b.n // 2 + 1:] WHERE b.first < a.first
      UNION ALL SELECT a.x, b.x, b.first FROM f a JOIN f b ON a.n + 1 = b.n
        AND a.x[1:a.n // 2] = b.x[1:a.n // 2] WHERE b.first < a.first
      UNION ALL SELECT a.x, b.x, b.first FROM f a JOIN f b ON a.n + 1 = b.n
        AND a.x[a.n - a.n // 2 + 1:] = b.x[b.n - a.n // 2 + 1:] WHERE b.first < a.first),
near AS (SELECT x, min(first) AS near FROM (SELECT DISTINCT * FROM c)
         WHERE CASE WHEN length(x) = length(y)
                    THEN len(list_filter(range(1, length(x) + 1), lambda i: x[i] <> y[i])) <= 1
                    WHEN length(x) > length(y)
                    THEN len(list_filter(range(1, length(x) + 1), lambda i: x[1:i - 1] || x[i + 1:] = y)) > 0
                    ELSE len(list_filter(range(1, length(y) + 1), lambda i: y[1:i - 1] || y[i + 1:] = x)) > 0 END
         GROUP BY x),
v AS (SELECT l.*, coalesce(least(f.first, coalesce(near.near, f.first)) < l.r * 10000000 + l.pos, false) AS gone
      FROM l LEFT JOIN f ON l.x = f.x LEFT JOIN near ON l.x = near.x)
SELECT doc_id, count(*) FILTER (gone) AS n_dropped,
       NOT bool_or(gone) OR count(*) FILTER (NOT gone AND length(x) > 0) > 0 AS kept,
       CASE WHEN any_value(text) IS NOT NULL
            THEN coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') END AS text
FROM v GROUP BY r, doc_id
"""


def op7_warc(spark, sf_dir):
    out = warc.archive(load(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


def op8_sentencepiece(spark, sf_dir):
    return sentencepiece.encode(load(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    out = quality.quality(load(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM hit) GROUP BY r),
c AS (
  SELECT d.doc_id, d.t, d.w, len(w)::BIGINT AS n_words, len(l)::BIGINT AS n_lines,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.r = rep.r),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words
         OR 2 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))
            > length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g'))
         OR 10 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) > 3 * n_words AS rejected
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM v
"""

def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def rebuilt(conversations):
    """``conv, depth, role, text`` and ``conv``: each conversation with the first turns of the last one divisible by 20.

    How many turns are exchanged (none to three) follows from the conversation's id.
    """
    turns = prefix_trie.numbered(conversations)
    head = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(4))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    convs = convs.select("conv", "n", (F.col("conv") - F.col("conv") % 20).alias("base"), head.alias("h"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").select(
        "conv", "base", "n", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    first = turns.where("pos <= 3 AND conv % 20 = 0").withColumnRenamed("conv", "base")
    heads = first.join(convs.drop("n"), "base").where("pos <= taken").select(
        "conv", F.col("pos").alias("depth"), "role", "text")
    # a conversation's own turns keep their order; how far they move is spread over every few thousand of its turns
    moved = convs.select("conv", "taken", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 4096))).alias("span"))
    own = turns.withColumn("h", head).where("pos > h").withColumn("span", F.floor(F.col("pos") / 4096))
    own = own.join(moved, ["conv", "span"]).select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    return heads.union(own), convs.select("conv")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.nodes(*rebuilt(load(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
          lambda v, z: xor(v // 2, 3988292384 * (v % 2)))) AS inverted FROM ids),
k AS (SELECT c, c - c % 20 AS base, xor(inverted, 4294967295::BIGINT) % 4 AS h FROM h),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT k.c, 0 AS part, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
      UNION ALL SELECT k.c, 1, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
o AS (SELECT c, row_number() OVER w AS d, len(regexp_extract_all(text, '[^ 	-
]+'))::BIGINT AS words,
             string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS path
      FROM r WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
p AS (SELECT c, d, md5(path) AS node, words FROM o UNION ALL SELECT c, 0, md5(''), 0 FROM ids),
l AS (SELECT c, max(d) AS last FROM p GROUP BY c),
g AS (SELECT node, d, min(p.c) AS conv, count(*) AS n, any_value(words) AS words,
             sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (d = last), '')) AS ends
      FROM p JOIN l ON p.c = l.c GROUP BY node, d),
-- each node with the node above it, and with every node above it or itself
up AS (SELECT g.conv, g.d, u.conv AS parent FROM g JOIN p ON p.c = g.conv AND p.d = g.d - 1 JOIN g u ON u.node = p.node AND u.d = p.d),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n FROM up GROUP BY parent, d - 1),
sub AS (SELECT a.node, a.d, sum((g.n - 1) * g.words) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
        FROM g JOIN p a ON a.c = g.conv AND a.d <= g.d LEFT JOIN kids ON kids.parent = g.conv AND kids.d = g.d GROUP BY a.node, a.d)
SELECT g.conv AS conv_id, g.d::BIGINT AS depth, up.parent AS parent_conv_id, g.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       sub.leaves AS n_leaves, sub.saved::BIGINT AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN sub ON sub.node = g.node AND sub.d = g.d LEFT JOIN up ON up.conv = g.conv AND up.d = g.d
LEFT JOIN kids ON kids.parent = g.conv AND kids.d = g.d
"""


def with_periods(docs):
    """``doc_id, text``: in one document of ten, by its id, the words from some place on repeat the first few of them."""
    d = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = F.col("h") % 10 == 0
    d = staged(d, w=F.when(chosen, words_of(F.col("text"))), g=F.floor(F.col("h") / 10))
    d = staged(d, n=F.size("w").cast("bigint"))
    d = staged(d, a=F.when(F.col("n") > 0, F.col("g") % F.greatest("n", F.lit(1))))
    d = staged(d, p=1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return d.select("doc_id", F.when(chosen & (F.col("n") > 0), F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark, sf_dir):
    d = runs.collapse(with_periods(load(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    # exact comparison of length / period: cross products; the list is by start, then period
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.array_sort("runs", lambda x, y: F.when(more(x, y), -1).when(more(y, x), 1).when(x["start"] < y["start"], -1)
                        .when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).otherwise(1))
    d = d.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.get(best, F.lit(0)).alias("best"),
                 F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                    "runs_sha256", "collapsed_sha256")


def op13_suffix_dedup(spark, sf_dir):
    d = suffix_dedup.cut_repeats(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_ann": op4_ann,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_runs": op12_runs,
    "op13_suffix_dedup": op13_suffix_dedup,
}
SQL = {
    "op2_mixing": OP2_SQL.strip(),
    "op6_line_dedup": OP6_SQL.strip(),
    "op7_warc": OP7_SQL.strip(),
    "op9_quality": OP9_SQL.strip(),
    "op11_prefix_trie": OP11_SQL.strip(),
}
