"""Registered queries: movetext cleaning and corpus conversion (H1, H2/K1)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from seqlake.functions.text import WS_PATTERN
from seqlake.operators.convert import (ANNOTATION_SUFFIX, BRACE_COMMENT, GLYPH, LINE_COMMENT, MOVE_NUMBER,
                                       clean_movetext_df, convert_games)
from seqlake.plans.registry import register, table


def _sql_comments(col: str) -> str:
    t = col
    for pat in (BRACE_COMMENT, LINE_COMMENT, GLYPH):
        t = f"regexp_replace({t}, '{pat}', ' ', 'g')"
    return t


SQL_MOVETEXT = """m AS (SELECT doc_id, '1. e4 {a (c} ' || text || ' ' || repeat('(x ', (doc_id % 12)::INTEGER) || 'y'
                           || repeat(' z)', (doc_id % 12)::INTEGER) || CASE WHEN doc_id % 29 = 0 THEN ' )' ELSE '' END
                           || ' 2. Nf3! $5 1-0' AS text FROM documents)"""


def movetext(docs):
    """Movetext of all kinds around each text: comments, glyphs, results, nesting to depth 11, stray parentheses."""
    k = (F.col("doc_id") % 12).cast("int")
    return docs.select("doc_id", F.concat(
        F.lit("1. e4 {a (c} "), F.col("text"), F.lit(" "), F.repeat(F.lit("(x "), k), F.lit("y"), F.repeat(F.lit(" z)"), k),
        F.when(F.col("doc_id") % 29 == 0, " )").otherwise(""), F.lit(" 2. Nf3! $5 1-0")).alias("text"))


# the oracle counts the depth character by character
@register("clean_movetext", f"""
WITH {SQL_MOVETEXT}, u AS (SELECT doc_id, text, {_sql_comments('text')} AS bare FROM m),
ch AS (SELECT doc_id, unnest(string_split(bare, '')) AS c, unnest(range(length(bare))) AS i FROM u WHERE length(bare) > 0),
dp AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM ch),
o AS (SELECT doc_id, min(d) < 0 OR sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) <> 0 AS unbalanced,
             string_agg(CASE WHEN d <> 0 THEN '' WHEN c = ')' THEN ' ' ELSE c END, '' ORDER BY i) AS stripped
      FROM dp GROUP BY doc_id),
t AS (SELECT u.doc_id, text, unbalanced,
             list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace(coalesce(stripped, ''), '{MOVE_NUMBER}', ' ', 'g'),
                                                                          '{WS_PATTERN}'), lambda x: x <> ''),
                                        lambda x: regexp_replace(x, '{ANNOTATION_SUFFIX}', '')),
                         lambda x: x <> '' AND x NOT IN ('1-0', '0-1', '1/2-1/2', '*')) AS toks
      FROM u LEFT JOIN o ON u.doc_id = o.doc_id),
r AS (SELECT *, CASE WHEN text IS NULL THEN 'empty' WHEN unbalanced THEN 'unbalanced' WHEN len(toks) = 0 THEN 'empty' END AS reject_reason
      FROM t)
SELECT doc_id, reject_reason, CASE WHEN reject_reason IS NULL THEN len(toks) END::INTEGER AS n_tokens,
       CASE WHEN reject_reason IS NULL THEN md5(array_to_string(toks, ' ')) END AS digest
FROM r
""")
def q_clean_movetext(spark, sf_dir):
    c = clean_movetext_df(movetext(table(spark, sf_dir, "documents")), "text")
    return c.select("doc_id", "reject_reason", F.size("tokens").alias("n_tokens"),
                    F.md5(F.array_join("tokens", " ")).alias("digest"))


_WS = re.compile(WS_PATTERN)


def lowercase_words(text):
    """Example converter plug-in (K1): lower-cased whitespace tokens; starred texts give nothing, hashed ones fail."""
    if "###" in text:
        raise ValueError("not a game")
    if "***" in text:
        return None
    return [t for t in _WS.split(text.lower()) if t] or None


@register("convert_games", f"""
WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '{WS_PATTERN}'), lambda x: x <> '') AS toks
           FROM documents),
r AS (SELECT *, CASE WHEN text IS NULL THEN 'empty' WHEN contains(text, '###') THEN 'converter_error'
                     WHEN contains(text, '***') OR len(toks) = 0 THEN 'unparseable' END AS reject_reason FROM t)
SELECT doc_id, CASE WHEN reject_reason IS NULL THEN len(toks) END::INTEGER AS n_tokens,
       CASE WHEN reject_reason IS NULL THEN md5(array_to_string(toks, ' ')) END AS digest, reject_reason
FROM r
""")
def q_convert_games(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = convert_games(docs, "text", lowercase_words)
    return out.select("doc_id", F.size("tokens").alias("n_tokens"),
                      F.md5(F.array_join("tokens", " ")).alias("digest"), "reject_reason")
