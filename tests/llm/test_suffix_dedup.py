import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import queries, suffix_dedup
from seqlake.llm.common import load

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length=100):
    """Every string of every text looked up in a dictionary of earlier ones."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        body = (rows[i][1] or "").encode()
        gone = np.zeros(len(body) + 1, int)
        for a in range(len(body) - length + 1):
            s = body[a:a + length]
            if s in seen:
                gone[a] += 1
                gone[a + length] -= 1
            seen.add(s)
        gone = np.cumsum(gone)[:len(body)] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(body) else 0
        kept = bytes(np.frombuffer(body, np.uint8)[~gone]) if len(body) else b""
        out.append((rows[i][0], len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(40) for _ in range(6)]
    texts = []
    for _ in range(150):
        t = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:      # with a change somewhere, or a part of it
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice(["", "X", " new "]) + p[k + rng.randint(0, 2):]
            t += rng.choice([" ", "\n", "-"]) + p[rng.choice([0, 0, 30]):] + rng.choice(["", " ", prose(5)])
        texts.append(t)
    texts += rng.choices(texts, k=30)
    texts += ["a" * 500, "a" * 99, "a" * 100, "ab" * 200, "x" + "ab" * 150, "", " ", "é" * 50, "日" * 40, passages[0][:100]]
    rng.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def query_rows(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(str(tuple(r)) for r in queries.op13_suffix_dedup(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS ord", "'x' AS body", "2 AS a", "3 AS id", "array(1) AS spans").repartition(7)
    assert query_rows(spark, df, tmp_path) == brute(rows)


def test_nulls_and_shared_ids(spark, tmp_path):
    """NULL ids and texts, repeated rows: every row is kept apart; ids that are shared take the general way."""
    p = "The same passage again and again, longer than one hundred bytes, so that it is found wherever it stands. "
    rows = [(None, p), (None, None), (5, p + "tail"), (5, p + "tail"), (5, p + "tail"), (3, "head " + p), (9, None), (9, "")]
    got = query_rows(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    assert got == brute(rows)


def test_small_pieces_and_buckets(spark, tmp_path, monkeypatch):
    """Long texts cut into pieces, very many equal suffixes over many buckets: the boundaries show in nothing."""
    rows = corpus(3)
    p = rows[0][1] + " the passage that a third of all documents hold, with more than one hundred bytes of its own text"
    rows = rows + [(2000 + i, f"{p} {i if i % 3 else ''}") for i in range(300)] + [(5000, " ".join(map(str, range(3000))) * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)     # for the driver; the pieces below are cut on it, too
    joined = b"".join((t or "").encode() for _, t in rows[:40])
    parts = list(suffix_dedup._steps([joined, b"", joined[:150]], 100))
    covered = sorted((r, s + x) for raw, starts, rs, shifts in parts for r, s, a, e in zip(
        rs, shifts, starts, [*starts[1:], len(raw)]) for x in range(e - a - 99))
    assert covered == [(0, x) for x in range(len(joined) - 99)] + [(2, x) for x in range(51)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert query_rows(spark, df.repartition(5), tmp_path) == brute(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_whole_table(spark):
    """All documents of the smallest scale, byte for byte."""
    rows = [(r.doc_id, r.text) for r in load(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = queries.op13_suffix_dedup(spark, "/root/testdata/sf0.001")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_order_and_empty_table(spark):
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 3, 400).astype(np.uint64) for _ in range(5)]
    order = suffix_dedup._multikey_order(words)
    strings = list(zip(*[w.tolist() for w in words]))
    assert order.tolist() == sorted(range(400), key=lambda i: strings[i])
    empty = suffix_dedup.cut_repeats(spark.createDataFrame([], DOCS).withColumn("kept", F.lit(1)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "spans", "kept"]
    with pytest.raises(ValueError):
        suffix_dedup.cut_repeats(spark.createDataFrame([], DOCS), gram=48)
