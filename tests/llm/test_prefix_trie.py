import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import prefix_trie, queries, sketch
from tests.oracle import compare, duck

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    """Every node with its members, counted one by one."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    words = lambda p: len(p[-1][1].encode().split()) if p else 0

    def under(p):
        stack, leaves, saved = [p], 0, 0
        while stack:
            x = stack.pop()
            leaves += x not in kids
            saved += (len(members[x]) - 1) * words(x)
            stack += kids.get(x, [])
        return leaves, saved
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *under(p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(150):
        kind = rng.random()
        n = 0 if kind < 0.1 else rng.randint(1, 6)
        for t in range(n):
            shared = rng.random() < 0.8 if kind < 0.7 else False
            text = rng.choice(["hello there", "a b c", "", None]) if shared else f"t {rng.randint(0, 10 ** 6)} é\n日"
            rows.append((c, t, rng.choice(["user", "user", "assistant", None]), text))
    return rows


ROWS = [
    *conversations(3), (None, 1, "user", "lost"), (200, None, "user", "first"), (200, 1, "user", "b"), (200, 1, "user", "a"),
    (200, 1, "user", "a"), (200, 1, None, None), (-40, 1, "user", "neg"), (-41, 1, "user", "neg"), (-41, 2, "user", "more"),
    *[(220, i, "user", f"turn {i}") for i in range(300)], *[(221, i, "user", f"turn {i}") for i in range(300)],
    (240, 1, "user", "x " * 50000), (241, 1, "user", "x " * 50000),
    *[(300 + c, i, "user", f"copy {i}") for c in range(200) for i in range(4)],
]


@pytest.mark.parametrize("bits", [16, 3])
def test_against_brute_force(spark, tmp_path, monkeypatch, bits):
    """NULLs, ties, repeated rows, long conversations and texts, many copies, clashing columns, a hopeless sketch too."""
    if bits < 16:   # every estimate is two or more, so that all is grouped exactly
        monkeypatch.setattr(prefix_trie, "company", lambda keys, width, rows: np.full((rows, width // 8), 255, np.uint8))
    df = spark.createDataFrame(ROWS, TURNS).selectExpr("*", "1 AS conv", "2 AS depth", "'k' AS k1", "3 AS pos", "4 AS own")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rebuilt(ROWS))


def test_general_interface(spark):
    turns = [(c, t + 1, r, x) for c, v in rebuilt(ROWS).items() for t, (r, x) in enumerate(v)]
    got = prefix_trie.nodes(spark.createDataFrame(turns, "conv long, depth long, role string, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute({c: v for c, v in rebuilt(ROWS).items() if v})
    empty = prefix_trie.nodes(prefix_trie.numbered(spark.createDataFrame([], TURNS)).withColumnRenamed("pos", "depth"))
    assert empty.count() == 0


def test_sketch(spark):
    """An estimate of one is a proof; the sketch does not depend on how rows are dealt."""
    keys = spark.range(20000).select(F.xxhash64(F.lit(1), F.col("id") % 15000).alias("a"),
                                     F.xxhash64(F.lit(2), F.col("id") % 15000).alias("b"))
    one, many = (sketch.company(keys.repartition(n), 1 << 16) for n in (1, 9))
    assert (one == many).all()
    ids = keys.toPandas()
    maybe = sketch.may_recur(one, ids.a.to_numpy(), ids.b.to_numpy())
    times = ids.groupby("a")["a"].transform("size").to_numpy()
    assert maybe[times > 1].all() and maybe[times == 1].mean() < 0.05
    assert sketch.width_for(0) == 1 << 16 and sketch.width_for(10 ** 12) == 1 << 24


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, duck(sf), "op11", queries.op11_prefix_trie, queries.OP11_SQL, sf)
    assert r["ok"], r
