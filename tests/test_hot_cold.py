"""Lookup through a vocabulary over the broadcast bound: frequent values broadcast, the long tail shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from seqlake.operators.encode import encode, map_elements
from seqlake.operators.joins import HOT_BYTES, hot_values


def rows_of(rng, n):
    """Sequences with hot and rare, known and unknown, NULL and very long tokens; repeated keys, repeated rows."""
    def token():
        r = rng.random()
        if r < 0.4:
            return "hot"
        if r < 0.5:
            return "?hot"                     # frequent and unknown
        if r < 0.52:
            return None
        return rng.choice(["t", "u"]) + str(rng.randint(0, 3000))
    rows = [(rng.choice([None, *range(n // 2)]), [token() for _ in range(rng.randint(0, 30))], i % 3) for i in range(n)]
    rows += [(1, None, 0), (2, [], 0), (3, [], 0), (3, ["x" * 5000, "t1", "x" * 5000], 1), (4, ["hot"] * 2000, 2)]
    return rows + rows[:40] + rows[:5]


def norm(rows):
    return sorted((repr(tuple(r)) for r in rows))


def test_equal_to_a_dictionary(spark):
    rng = random.Random(3)
    rows = rows_of(rng, 400)
    ids = {"hot": 7, "x" * 5000: 8} | {f"t{i}": 100 + i for i in range(3001)}
    df = spark.createDataFrame(rows, "k int, tokens array<string>, c int").repartition(5)
    vocab = spark.createDataFrame(list(ids.items()), "token string, id int")
    got = {b: map_elements(df, "k", "tokens", vocab, "token", "id", "out", broadcast_bytes=b) for b in (0, 1 << 26)}
    want = [(k, t, c, None if t is None else [ids.get(x) for x in t]) for k, t, c in rows]
    for out in got.values():
        # the elements of a NULL array are none, as those of an empty one
        assert norm((r.k, r.tokens, r.c, r.out or None) for r in out.collect()) == norm((*w[:3], w[3] or None) for w in want)
    carried = map_elements(df, "k", "tokens", vocab, "token", "id", "out", carry=["c"], broadcast_bytes=0)
    assert norm((r.k, r.c, r.out or None) for r in carried.collect()) == norm((k, c, o or None) for k, _, c, o in want)


def test_ids_to_tokens_and_empty_input(spark):
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(50)], "token string, id int")
    df = spark.createDataFrame([("a", [1, 2, 99, None]), ("b", [3])], "k string, ids array<int>")
    out = map_elements(df, "k", "ids", vocab, "id", "token", "out", broadcast_bytes=0)
    assert {r.k: r.out for r in out.collect()} == {"a": ["t1", "t2", None, None], "b": ["t3"]}
    assert map_elements(df.where("false"), "k", "ids", vocab, "id", "token", "out", broadcast_bytes=0).count() == 0
    none = map_elements(df, "k", "ids", vocab.where("false"), "id", "token", "out", broadcast_bytes=-1)
    assert {r.k: r.out for r in none.collect()} == {"a": [None] * 4, "b": [None]}


def test_frequent_values_are_found(spark):
    n = 200_000
    df = spark.range(n, numPartitions=6).select("id", F.when(F.col("id") % 3 == 0, "third").when(
        F.col("id") % 50 == 1, "fiftieth").when(F.col("id") % 50 == 2, F.repeat(F.lit("z"), HOT_BYTES + 1))
        .when(F.col("id") % 50 == 3, None).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("v"))
    hot = [r.v for r in hot_values(df, "v", ["id"]).collect()]
    assert {"third", "fiftieth"} <= set(hot) and None not in hot and max(map(len, hot)) <= HOT_BYTES


def test_hot_tokens_take_no_part_in_the_shuffle(spark):
    """Only the long tail is joined by a shuffle; the rows move once."""
    df = spark.createDataFrame([(i, ["hot"] * 20 + [f"t{i}"]) for i in range(500)], "k int, tokens array<string>")
    vocab = spark.createDataFrame([("hot", 1), *[(f"t{i}", i + 2) for i in range(500)]], "token string, id int")
    out = map_elements(df, "k", "tokens", vocab, "token", "id", "out", carry=[], broadcast_bytes=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(_is_hot" in plan
    assert {r.k: r.out for r in out.collect()} == {i: [1] * 20 + [i + 2] for i in range(500)}
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 1


def test_length_bound_before_the_lookup_and_named_unknown(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    df = spark.createDataFrame([(1, ["a"] * 3), (2, ["b"] * 4), (3, ["a", "?"]), (4, [])], "k int, tokens array<string>")
    late = encode(df, "k", "tokens", vocab).where("len <= 5")
    assert norm(encode(df, "k", "tokens", vocab, max_len=5).collect()) == norm(late.collect())
    with pytest.raises(ValueError):
        encode(df, "k", "tokens", vocab, keep_rejects=True, max_len=5)
    with pytest.raises(Exception, match="unknown token: \\?"):
        encode(df, "k", "tokens", vocab, on_unknown="error").collect()


def test_frequent_elements_are_not_regrouped(spark):
    """Frequent elements are looked up inside their arrays; only the long tail is collected again, named by a number."""
    df = spark.createDataFrame([(i, ["hot"] * 20 + [f"t{i}"], "s") for i in range(300)], "k int, tokens array<string>, s string")
    vocab = spark.createDataFrame([("hot", 1), *[(f"t{i}", i + 2) for i in range(300)]], "token string, id int")
    out = map_elements(df, "k", "tokens", vocab, "token", "id", "out", carry=["s"], broadcast_bytes=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "MapInArrow" in plan
    assert {(r.k, r.s): r.out for r in out.collect()} == {(i, "s"): [1] * 20 + [i + 2] for i in range(300)}
