"""Registered queries: encoding core and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.operators.encode import encode
from seqlake.operators.packing import pack_exact, packing_summary
from seqlake.operators.vocab import learned_vocabulary
from seqlake.plans.registry import register, table
from seqlake.plans.standins import CHUNK_LEN, SEED, doc_tokens, sql_tokens


def encoded_games(spark, sf_dir, max_len=None):
    """All documents (with ``max_len``: those that come out no longer) encoded with the vocabulary learned from all."""
    docs = doc_tokens(spark, sf_dir)
    vocab = learned_vocabulary(table(spark, sf_dir, "documents"))
    return encode(docs, "doc_id", "tokens", vocab, carry=["shard"], max_len=max_len)


def packable(spark, sf_dir, enc=None):
    """Encoded games that fit one chunk."""
    enc = encoded_games(spark, sf_dir, CHUNK_LEN) if enc is None else enc
    return enc.where(F.col("len") <= CHUNK_LEN)


def packed(spark, sf_dir, enc=None):
    """Packing table (doc_id, shard, len, chunk_id, pos); ``enc`` reuses an encoding."""
    items = packable(spark, sf_dir, enc).select("doc_id", "shard", "len")
    return pack_exact(items, ["doc_id"], "len", CHUNK_LEN, SEED)


SQL_PACK_ITEMS = f"""
items AS (
  SELECT doc_id, source AS shard, len({sql_tokens('text')}) + 2 AS len,
         row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) AS rn
  FROM documents
  WHERE len({sql_tokens('text')}) BETWEEN 1 AND {CHUNK_LEN - 2}),
fold(rn, doc_id, len, cur, chunk_id, pos) AS (
  SELECT rn, doc_id, len, len, 0, 0 FROM items WHERE rn = 1
  UNION ALL
  SELECT i.rn, i.doc_id, i.len,
         CASE WHEN f.cur + i.len > {CHUNK_LEN} THEN i.len ELSE f.cur + i.len END,
         f.chunk_id + CASE WHEN f.cur + i.len > {CHUNK_LEN} THEN 1 ELSE 0 END,
         CASE WHEN f.cur + i.len > {CHUNK_LEN} THEN 0 ELSE f.pos + 1 END
  FROM fold f JOIN items i ON i.rn = f.rn + 1)
"""


@register("pack_exact", f"""
WITH RECURSIVE {SQL_PACK_ITEMS}
SELECT f.doc_id, i.shard, f.len::INTEGER AS len, f.chunk_id::BIGINT AS chunk_id, f.pos::INTEGER AS pos
FROM fold f JOIN items i USING (rn)
""")
def q_pack_exact(spark, sf_dir):
    return packed(spark, sf_dir).select("doc_id", "shard", "len", "chunk_id", "pos")


@register("packing_summary", f"""
WITH RECURSIVE {SQL_PACK_ITEMS}
SELECT count(*) AS n_games, count(DISTINCT i.shard) AS n_shards,
       (max(f.chunk_id) + 1)::BIGINT AS n_chunks, sum(f.len)::BIGINT AS n_tokens,
       round(sum(f.len) / ((max(f.chunk_id) + 1) * {CHUNK_LEN}.0), 6) AS fill
FROM fold f JOIN items i USING (rn)
""")
def q_packing_summary(spark, sf_dir):
    return packing_summary(packed(spark, sf_dir), "len", "shard", CHUNK_LEN)
