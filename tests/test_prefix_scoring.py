"""Prefixes scored by runs of one length: no batch mixes lengths, nothing is padded, every row answers."""

import random

import pytest

import seqlake.operators.scoring as scoring
from seqlake.operators.scoring import prefix_scorer, score_prefixes

N_OUT = 9


def plain(ids):
    return [float("-inf")] * 4 + [sum((x * 7 + i * 3 + v * 13) % 17 - 8 for i, x in enumerate(ids)) / 8 for v in range(4, N_OUT)]


def test_equal_to_one_by_one_and_no_batch_mixes_lengths(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randint(0, 99) for _ in range(rng.choice([1, 2, 5, 5, 5, 12]))], "x") for i in range(3000)]
    rows += [(3000, None, "x"), (3001, [], None), (3002, [1, None], "x"), (3003, [1] * 13, "x"), (None, [4], None), (7, [4], "y")]

    def strict():
        inner = prefix_scorer(N_OUT)()

        def score(ids):
            # a rectangle of whole prefixes: no padding, no more rows than agreed
            assert ids.ndim == 2 and 1 <= ids.shape[1] <= 12 and 1 <= ids.shape[0] <= 1024
            return inner(ids)
        return score
    df = spark.createDataFrame(rows, "k int, ids array<int>, logit string")
    out = score_prefixes(df, "ids", strict, N_OUT, 12)
    assert out.columns == ["k", "ids", "logit", "reason", "logits"]
    got = sorted((repr((r.k, r.ids, r.logit, r.reason, r.logits)) for r in out.collect()))

    def want(k, ids, x):
        reason = "empty" if not ids else "unknown_token" if None in ids else "too_long" if len(ids) > 12 else None
        return repr((k, ids, x, reason, None if reason else plain(ids)))
    assert got == sorted(want(*r) for r in rows)
    assert score_prefixes(df.where("false"), "ids", strict, N_OUT, 12).count() == 0


def test_a_common_length_is_spread(spark):
    """A length that most rows share does not end in one task."""
    df = spark.range(40_000, numPartitions=4).selectExpr("id", "array(1, 2, 3) AS ids")
    out = score_prefixes(df, "ids", prefix_scorer(N_OUT), N_OUT, 12)
    sizes = [r["count"] for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert sum(sizes) == 40_000 and (len(sizes) == 1 or max(sizes) < 20_000)


def test_wrong_shape_is_an_error(spark):
    df = spark.createDataFrame([(1, [1, 2])], "k int, ids array<int>")
    with pytest.raises(Exception, match="scorer"):
        score_prefixes(df, "ids", prefix_scorer(N_OUT + 1), N_OUT, 12).collect()
    assert scoring.PREFIX_ROWS == 1024
