import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import ann, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, asks, k=20):
    """Exact answers: (query id, [(vec_id, score)…])."""
    good = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i, tuple(np.float32(v).tolist())] = np.float32(v).astype(np.float64)
    out = []
    for (i, _), q in good.items():
        if asks(i):
            c = [(-float(v @ q), j) for (j, _), v in good.items() if j != i and len(v) == len(q)]
            out.append((i, [(j, -s) for s, j in sorted(c)[:k]]))
    return out


def recall(got, want):
    hit = n = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for i, exact in want:
        rows = sorted(by.get(i, []))
        assert [r[0] for r in rows] == list(range(1, len(exact) + 1)), (i, len(rows), len(exact))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(rows, rows[1:])), (i, rows)
        hit += len({r[1] for r in rows} & {j for j, _ in exact})
        n += len(exact)
    return hit / max(n, 1)


def test_recall_of_one_graph():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(4000, 24)), rng.normal(size=(4000, 24)) * rng.uniform(0.1, 9, (4000, 1)),
              np.repeat(rng.normal(size=(40, 24)), 100, axis=0) + 0.05 * rng.normal(size=(4000, 24))):
        q = x[rng.permutation(len(x))[:100]] + 0.01 * rng.normal(size=(100, 24))
        exact = np.argsort(-q @ x.T, axis=1)[:, :20]
        found = ann.Graph.build(x).search(q)
        assert np.mean([len(set(a) & set(b[:20])) / 20 for a, b in zip(exact, found)]) > 0.9


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.op4_ann(spark, d).collect()
    assert recall(got, brute(rows, lambda i: i % 20 == 0)) > 0.95
    vectors = {i: np.float32(v).astype(np.float64) for i, v, _ in rows}
    assert all(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12 for r in got)


def test_shards_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)]
    rows[5] = (5, [10 * x for x in rows[5][1]], 0)
    rows += [(1000 + i, rows[5][1], 1) for i in range(60)] + [(40, [1.0] * 8, 2), (40, [1.0] * 8, 2), (7, rows[7][1], 0)]
    rows += [(2000, None, 0), (2020, [], 0), (2040, [0.0] * 8, 0), (2060, [1.0, None] + [1.0] * 6, 0), (2080, [float("nan")] * 8, 0),
             (2100, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (2120, [1.0, 2.0, 3.0], 0), (2121, [1.0, 0.0, 3.0], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("vector", F.lit(1)).withColumn("score", F.lit("x"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=64).collect()
    want = [w for w in brute(rows, lambda i: i % 20 == 0) if w[0] != 40]
    assert {r.query_id for r in got} == {w[0] for w in want} | {40}
    assert recall([r for r in got if r.query_id != 40], want) > 0.99
    ties = [r.vec_id for r in sorted((r for r in got if r.query_id == 1000), key=lambda r: r.rank)]
    assert ties == [5, *range(1001, 1020)]
    assert sorted((r.vec_id, r.rank) for r in got if r.query_id == 2120) == [(2121, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 25])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(i * 20, [float(i + 1), 1.0], 0) for i in range(n)], VECTORS)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == n * min(20, max(n - 1, 0))
