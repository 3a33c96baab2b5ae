"""Registered queries: training feed — orders, splits, ranks, batches, chunk
gathering and tensors (SURVEY order 5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlake.operators.packing import (chunk_tensor, gather_chunks, nonpad_tokens, pack_bucketed, pack_exact,
                                       preview, shift_labels, shift_labels_long)
from seqlake.operators.split import (batch, date_split, epoch_shuffle, random_pick, random_split,
                                     seeded_shuffle, shard_ranks, sorted_listing, training_feed)
from seqlake.operators.vocab import learned_vocabulary
from seqlake.plans.encoding_plans import SQL_ALL_VOCAB, SQL_DT, ids_text
from seqlake.plans.packing_plans import SQL_PACK_ITEMS, encoded_games, packable, packed
from seqlake.plans.registry import register, table
from seqlake.plans.standins import CHUNK_LEN, SEED
from seqlake.session import scratch_dir
from seqlake.sources.tokens import GAME_KEY, stored_games, write_bucketed

WORLD = 8
BATCH = 16
EPOCH = 3
N_BUCKETS = 4

SQL_IDS = """el AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM dt),
ids AS (SELECT el.doc_id, list_concat(list_concat([1], list(v.id ORDER BY el.pos)), [2]) AS ids
        FROM el JOIN vocab v USING (token) GROUP BY el.doc_id)"""
SQL_CHUNKS = f"""WITH RECURSIVE {SQL_DT}, {SQL_ALL_VOCAB}, {SQL_IDS}, {SQL_PACK_ITEMS},
chunks AS (SELECT f.chunk_id::BIGINT AS chunk_id, count(*) AS n_games, flatten(list(ids.ids ORDER BY f.pos)) AS tokens
           FROM fold f JOIN ids USING (doc_id) GROUP BY f.chunk_id),
tensor AS (SELECT chunk_id, list_resize(tokens, {CHUNK_LEN}, 0)[1:{CHUNK_LEN - 1}] AS input_ids,
                  list_resize(tokens, {CHUNK_LEN}, 0)[2:{CHUNK_LEN}] AS labels FROM chunks)"""


def chunks(spark, sf_dir):
    """Packing by id and length, joined to the bucketed token store; the tokens move once, to their chunks."""
    name = f"token_store_{uuid.uuid4().hex[:12]}"
    store = write_bucketed(packable(spark, sf_dir), name, scratch_dir(spark, "tokens"), "doc_id")
    packing = pack_exact(stored_games(store, "doc_id"), ["doc_id"], "len", CHUNK_LEN, SEED)
    return gather_chunks(packing, store, GAME_KEY)


@register("seeded_shuffle", f"""
SELECT doc_id, (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1)::BIGINT AS perm_idx FROM documents
""")
def q_seeded_shuffle(spark, sf_dir):
    return seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED)


@register("epoch_shuffle", f"""
SELECT doc_id, (row_number() OVER (ORDER BY md5('{SEED}:{EPOCH}:' || doc_id), doc_id) - 1)::BIGINT AS perm_idx
FROM documents
""")
def q_epoch_shuffle(spark, sf_dir):
    return epoch_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED, EPOCH)


@register("random_split", f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id)
                         <= floor((SELECT count(*) FROM documents) * 0.05) THEN 'val' ELSE 'train' END AS split
FROM documents
""")
def q_random_split(spark, sf_dir):
    return random_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05, SEED)


@register("date_split", """
WITH h AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT d, coalesce(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              / sum(n) OVER () AS share FROM h)
SELECT o_orderkey, CASE WHEN share < 0.95 THEN 'train' WHEN share < 0.975 THEN 'val' ELSE 'test' END AS split
FROM orders JOIN s ON s.d = o_orderdate::DATE
""")
def q_date_split(spark, sf_dir):
    return date_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"),
                      "o_orderdate").select("o_orderkey", "split")


SQL_RANKS = f"""
perm AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:{EPOCH}:' || doc_id), doc_id) - 1 AS idx FROM documents),
sz AS (SELECT count(*) AS n, ((count(*) + {WORLD} - 1) // {WORLD}) * {WORLD} AS total FROM documents),
padded AS (SELECT doc_id, idx AS p FROM perm
           UNION ALL SELECT doc_id, idx + (SELECT n FROM sz) FROM perm WHERE idx < (SELECT total - n FROM sz)),
ranked AS (SELECT doc_id, p::BIGINT AS p, (p % {WORLD})::INTEGER AS rank, (p // {WORLD})::BIGINT AS pos_in_rank FROM padded)"""


def _ranked(spark, sf_dir):
    docs = epoch_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED, EPOCH, "idx")
    return shard_ranks(docs, "idx", WORLD)


@register("shard_ranks", f"WITH {SQL_RANKS} SELECT doc_id, p, rank, pos_in_rank FROM ranked")
def q_shard_ranks(spark, sf_dir):
    return _ranked(spark, sf_dir).select("doc_id", "p", "rank", "pos_in_rank")


@register("batch", f"""
WITH {SQL_RANKS}
SELECT doc_id, rank, (pos_in_rank // {BATCH})::BIGINT AS batch_id, pos_in_rank FROM ranked
WHERE pos_in_rank < ((SELECT total FROM sz) // {WORLD} // {BATCH}) * {BATCH}
""")
def q_batch(spark, sf_dir):
    return batch(_ranked(spark, sf_dir), BATCH, drop_last=True).select("doc_id", "rank", "batch_id", "pos_in_rank")


@register("gather_chunk", f"""
{SQL_CHUNKS}
SELECT chunk_id, n_games, array_to_string(tokens, ' ') AS tokens FROM chunks
""")
def q_gather_chunk(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "n_games", ids_text("tokens").alias("tokens"))


@register("chunk_tensor", f"""
{SQL_CHUNKS}
SELECT chunk_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels,
       len(list_filter(labels, lambda x: x <> 0))::INTEGER AS n_tokens
FROM tensor
""")
def q_chunk_tensor(spark, sf_dir):
    t = chunk_tensor(chunks(spark, sf_dir), CHUNK_LEN)
    return t.select("chunk_id", ids_text("input_ids").alias("input_ids"),
                    ids_text("labels").alias("labels"), "n_tokens")


@register("nonpad_tokens", f"""
{SQL_CHUNKS}
SELECT chunk_id, len(list_filter(labels, lambda x: x <> 0))::INTEGER AS n_tokens FROM tensor
""")
def q_nonpad_tokens(spark, sf_dir):
    t = chunk_tensor(chunks(spark, sf_dir), CHUNK_LEN)
    return t.select("chunk_id", nonpad_tokens("labels").alias("n_tokens"))


@register("shift_labels", f"""
WITH {SQL_DT}, {SQL_ALL_VOCAB}, {SQL_IDS}
SELECT doc_id, array_to_string(ids[1:len(ids) - 1], ' ') AS input_ids, array_to_string(ids[2:len(ids)], ' ') AS labels
FROM ids
""")
def q_shift_labels(spark, sf_dir):
    enc = encoded_games(spark, sf_dir)
    inp, lab = shift_labels("ids")
    return enc.select("doc_id", ids_text(inp).alias("input_ids"), ids_text(lab).alias("labels"))


@register("shift_labels_long", f"""
WITH {SQL_DT}, {SQL_ALL_VOCAB}, {SQL_IDS},
lng AS (SELECT doc_id, unnest(ids) AS token, unnest(range(0, len(ids))) AS pos FROM ids)
SELECT doc_id, pos::INTEGER AS pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS label
FROM lng QUALIFY label IS NOT NULL
""")
def q_shift_labels_long(spark, sf_dir):
    enc = encoded_games(spark, sf_dir)
    ids = enc.select("doc_id", "ids").repartition("doc_id")       # whole arrays move, the window's long rows do not
    lng = ids.select("doc_id", F.posexplode("ids").alias("pos", "token"))
    return shift_labels_long(lng, "doc_id", "pos", "token").select("doc_id", "pos", "token", "label")


@register("pack_bucketed", f"""
WITH RECURSIVE items AS (
  SELECT doc_id, len({'list_filter(regexp_split_to_array(text, ' + repr(chr(91)+' '+chr(9)+chr(10)+chr(13)+chr(12)+chr(93)+'+') + '), lambda x: x <> ' + repr('') + ')'}) + 2 AS len,
         (('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::BIGINT % {N_BUCKETS})::INTEGER AS bucket,
         md5('{SEED}:' || doc_id) AS k
  FROM documents),
it AS (SELECT doc_id, len, bucket, row_number() OVER (PARTITION BY bucket ORDER BY k, doc_id) AS rn
       FROM items WHERE len BETWEEN 3 AND {CHUNK_LEN}),
fold(bucket, rn, doc_id, cur, chunk_no, pos) AS (
  SELECT bucket, rn, doc_id, len, 0, 0 FROM it WHERE rn = 1
  UNION ALL
  SELECT i.bucket, i.rn, i.doc_id,
         CASE WHEN f.cur + i.len > {CHUNK_LEN} THEN i.len ELSE f.cur + i.len END,
         f.chunk_no + CASE WHEN f.cur + i.len > {CHUNK_LEN} THEN 1 ELSE 0 END,
         CASE WHEN f.cur + i.len > {CHUNK_LEN} THEN 0 ELSE f.pos + 1 END
  FROM fold f JOIN it i ON i.bucket = f.bucket AND i.rn = f.rn + 1)
SELECT doc_id, bucket, chunk_no::BIGINT AS chunk_no, pos::INTEGER AS pos FROM fold
""")
def q_pack_bucketed(spark, sf_dir):
    items = packable(spark, sf_dir).select("doc_id", "len")
    return pack_bucketed(items, ["doc_id"], N_BUCKETS, "len", CHUNK_LEN, SEED).select(
        "doc_id", "bucket", "chunk_no", "pos")


@register("random_pick", f"""
SELECT c_nationkey, c_custkey FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('{SEED}:' || c_custkey), c_custkey) <= 3
""")
def q_random_pick(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return random_pick(cust, "c_custkey", 3, SEED, owner="c_nationkey")


@register("preview", f"""
{SQL_CHUNKS},
first AS (SELECT * FROM tensor ORDER BY chunk_id LIMIT 3),
inv AS (SELECT token, id FROM vocab UNION ALL SELECT * FROM (VALUES ('PAD', 0), ('BOS', 1), ('EOS', 2), ('MASK', 3)) s(token, id)),
el2 AS (SELECT chunk_id, unnest(input_ids) AS id, unnest(range(0, len(input_ids))) AS pos FROM first),
named AS (SELECT chunk_id, pos, coalesce(inv.token, '?') AS token FROM el2 LEFT JOIN inv USING (id))
SELECT chunk_id, string_agg(token, ' ' ORDER BY pos) FILTER (WHERE rk <= 20) AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS rk FROM named WHERE token <> 'PAD')
GROUP BY chunk_id
""")
def q_preview(spark, sf_dir):
    """first 3 chunks, first 20 non-PAD decoded input tokens."""
    vocab = learned_vocabulary(table(spark, sf_dir, "documents"))
    return preview(chunk_tensor(chunks(spark, sf_dir), CHUNK_LEN), vocab, 3, 20)


@register("sorted_listing", """
SELECT url, (row_number() OVER (ORDER BY url) - 1)::BIGINT AS idx FROM (SELECT DISTINCT url FROM pages)
""")
def q_sorted_listing(spark, sf_dir):
    return sorted_listing(table(spark, sf_dir, "pages"), "url", "idx")


FEED_EPOCHS = (0, 1)


@register("training_feed", f"""
WITH RECURSIVE {SQL_PACK_ITEMS},
ch AS (SELECT DISTINCT chunk_id::BIGINT AS chunk_id FROM fold),
sp AS (SELECT chunk_id, row_number() OVER (ORDER BY md5('{SEED}:' || chunk_id), chunk_id)
                          <= floor((SELECT count(*) FROM ch) * 0.05) AS is_val FROM ch),
tr AS (SELECT chunk_id FROM sp WHERE NOT is_val),
ep AS (SELECT unnest([{", ".join(str(e) for e in FEED_EPOCHS)}]) AS epoch),
perm AS (SELECT ep.epoch, tr.chunk_id,
                row_number() OVER (PARTITION BY ep.epoch ORDER BY md5('{SEED}:' || ep.epoch || ':' || tr.chunk_id), tr.chunk_id) - 1 AS idx
         FROM tr, ep),
sz AS (SELECT count(*) AS n, ((count(*) + {WORLD} - 1) // {WORLD}) * {WORLD} AS total FROM tr),
padded AS (SELECT epoch, chunk_id, idx AS p FROM perm
           UNION ALL SELECT epoch, chunk_id, idx + (SELECT n FROM sz) FROM perm WHERE idx < (SELECT total - n FROM sz))
SELECT chunk_id, epoch::INTEGER AS epoch, (p % {WORLD})::INTEGER AS rank, (p // {WORLD})::BIGINT AS pos_in_rank,
       ((p // {WORLD}) // {BATCH})::BIGINT AS batch_id
FROM padded WHERE p // {WORLD} < ((SELECT total FROM sz) // {WORLD} // {BATCH}) * {BATCH}
""")
def q_training_feed(spark, sf_dir):
    """Chunks of the packed corpus -> exact 5 % validation cut -> per-epoch order,
    ranks and batches of the training side (two epochs)."""
    ch = packed(spark, sf_dir).select("chunk_id").distinct()
    return training_feed(ch, "chunk_id", 0.05, SEED, WORLD, BATCH, FEED_EPOCHS).select(
        "chunk_id", "epoch", "rank", "pos_in_rank", "batch_id")
