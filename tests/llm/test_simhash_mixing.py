import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqlake.llm import components, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for b in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(b, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Smallest index reachable, by brute force over all pairs."""
    a = np.array(fps, dtype=np.uint64)
    label = np.arange(len(a))
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            return label.tolist()
        label = new


TEXTS = [None, "", " \n ", "One", "one", "one two three", "ONE two\tthree", "a b c d", "a b c d e", "É é x y z",
         "a b c d " * 50, "a\x85b c d　e f g", "w " * 3000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_small(spark):
    rng = random.Random(3)
    texts = list(TEXTS)
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 200, 400]))]
        for _ in range(rng.choice([1, 3, 12])):
            other = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                other[rng.randrange(len(other))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(other))
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, None, None, None) for i, t in enumerate(texts)]
    want = plain_components([plain_fingerprint(t) for t in texts])
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(0)).withColumn("component_id", F.lit("x"))
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        assert got[i * 3 + 1].fingerprint == f"{plain_fingerprint(t):016x}"
        assert got[i * 3 + 1].component_id == want[i] * 3 + 1
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {w * 3 + 1 for w in want}


def test_link_components_dense_and_sparse(spark, monkeypatch):
    """Dense balls, chains and random values, with tiny blocks so that hot lists are salted."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for c in [rng.getrandbits(64) for _ in range(3)]:
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(150)}
    x = rng.getrandbits(64)
    for _ in range(40):   # a chain of 4-bit steps
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(x)
    fps = sorted(fps)
    want = plain_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.fp: r.root for r in simhash.link_components(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert len(got) == len(fps)
    groups = {}
    for f, w in zip(signed, want):
        groups.setdefault(w, set()).add(f)
    found = {}
    for f, r in got.items():
        found.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_simhash_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    rows = [(None, "a b c d e", "en", "s", 9), (7, "a b c d e", "en", "s", 9), (7, "a b c d e", "en", "s", 9),
            (None, "other words here now", "en", "s", 9), (None, "other words here now", "en", "s", 9)]
    df = spark.createDataFrame(rows, DOCS)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {7, None}
    kept = simhash.keep_one(df.withColumn("extra", F.lit(1))).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == [(False, "a b c d e"), (True, "other words here now")]


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (101, 103), (103, 101), (None, 4)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 103: 101}


def plain_targets(sizes):
    """Share by weight, fix what is above its cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 2.0 * sizes[s] for s in over})


def _mix_rows():
    rng = random.Random(11)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None, ""])
        n = rng.choice([0, 1, 5, 60])
        rows.append((i, None if n == 0 and i % 2 else " ".join(rng.choice(["x", "y#", "z"]) for _ in range(n)), "en", source, n))
    return rows + [(7, "same text here", "en", "a", 3)] * 30 + [(None, "no id", None, None, None)] * 3


def test_mix(spark):
    rows = _mix_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("x")).withColumn("_w", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert set(by_target) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (_, target), taken in by_target.items():
        assert target - 40 <= sum(taken) <= target + 1e-6   # 30 equal rows share a cut evenly


def test_mix_matches_plain_order(spark):
    """Whole epochs first, then documents in key order up to the budget."""
    rows = [(i, " ".join(["w"] * (i % 9 + 1)), "en", "ab"[i % 5 == 0], 1) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    keys = {r.doc_id: r._key for r in mixing.keyed(df, "doc_id", "text", "source", mixing.SEED).collect()}
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    for s in "ab":
        ids = sorted((i for i, *_ in rows if rows[i][3] == s), key=lambda i: keys[i])
        size = sum(got[i].size for i in ids)
        epochs, left = int(got[ids[0]].target // size), int(got[ids[0]].target - got[ids[0]].target // size * size)
        for i in ids:
            part = min(left, got[i].size)
            left -= part
            assert got[i].taken == epochs * got[i].size + part


def test_mixed_documents(spark):
    rows = _mix_rows()
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed_documents(df.withColumn("_cut", F.lit(5)).drop("_cut"))
    assert out.columns == df.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    taken = sum(r.taken for r in mixing.mix(df).collect())
    assert words == taken
    texts = {t for _, t, *_ in rows}
    assert all(any((t or "").startswith(r.text or "") for t in texts) for r in out.collect())


def test_mix_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", "en", "s", 1)], DOCS)
    assert {(r.size, r.taken, r.target) for r in mixing.mix(blank).collect()} == {(0, 0, 0.0)}


def test_mix_crowded_edge_band(spark, monkeypatch):
    """A band that holds too many rows (low weights, equal keys) is divided until it is small; the mix stays the same."""
    rows = [(i, "w " * (i % 4), "en", None if i % 3 else "hot", 1) for i in range(3000)]
    rows += [(None, f"no id, text {i}", "en", "unnamed", 1) for i in range(300)] + [(7, "same text", "en", "copies", 1)] * 50
    df = spark.createDataFrame(rows, DOCS)
    seen, plain = [], mixing._edge
    monkeypatch.setattr(mixing, "_edge", lambda bands: seen.append(plain(bands)) or seen[-1])
    want = sorted(map(str, mixing.mix(df, weight=F.lit(0.1)).collect()))
    assert len(seen) == 1
    monkeypatch.setattr(mixing, "EDGE_ROWS", 8)
    got = mixing.mix(df, weight=F.lit(0.1)).collect()
    assert sorted(map(str, got)) == want
    assert len(seen) > 2 and seen[1].agg(F.max("_n")).first()[0] > 100
    assert seen[-1].where("_rlo < _rhi").agg(F.max("_n")).first()[0] <= 8
