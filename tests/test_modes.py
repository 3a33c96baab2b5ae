"""Built-in converter, fast shuffle keys, sketches of distinct tokens."""

import pytest
from pyspark.sql import functions as F

from seqlake.operators.convert import vocabulary_converter
from seqlake.operators.split import epoch_shuffle, seeded_shuffle
from seqlake.operators.vocab import N_SPECIAL, fixed_tokens, sketched_vocab, token_sketches


def test_converter_knows_the_vocabulary(spark):
    convert = vocabulary_converter(fixed_tokens(spark)[N_SPECIAL:])
    assert convert(" e2e4\te7e8q\n") == ["e2e4", "e7e8q"]
    for text in (None, "", " ", "a1a1", "e2e4 a1a1", "e2e4x", "e2e4 BOS", "e7e8k", "a1b5"):
        assert convert(text) is None


@pytest.mark.parametrize("key", ["md5", "xxhash64"])
def test_shuffle_keys(spark, key):
    df = spark.range(500)
    one, two = ({r.id: r.perm_idx for r in seeded_shuffle(df.repartition(n), "id", 7, n_blocks=n, key=key).collect()} for n in (1, 6))
    other = {r.id: r.perm_idx for r in seeded_shuffle(df, "id", 8, key=key).collect()}
    epochs = [{r.id: r.perm_idx for r in epoch_shuffle(df, "id", 7, e, key=key).collect()} for e in (0, 1)]
    assert one == two and sorted(one.values()) == list(range(500))
    assert len({str(sorted(x.items())) for x in (one, other, *epochs)}) == 4


def test_united_sketches_equal_one_pass(spark):
    """Increments that overlap, NULL tokens and groups, an empty table; the error stays within its bound."""
    df = spark.range(60000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 != 0, F.concat(F.lit("t"), F.col("id") % 40000)).alias("token"))
    df = df.union(spark.createDataFrame([(None, "t1")], "g long, token string"))
    parts = [token_sketches(df.where(c), "g") for c in ("token < 't3'", "token >= 't2' OR token IS NULL")]
    united, once = sketched_vocab(parts[0].union(parts[1]), "g"), sketched_vocab(token_sketches(df, "g"), "g")
    a, b = ({r.g: r.n_distinct for r in x.collect()} for x in (united, once))
    assert a == b and a[None] == 1
    total = sketched_vocab(token_sketches(df, "g")).first()
    exact = df.agg(F.count_distinct("token")).first()[0]
    assert abs(total.n_distinct - exact) <= 0.045 * exact and total.n_tokens == df.where("token IS NOT NULL").count()
    assert sketched_vocab(token_sketches(df.limit(0), "g"), "g").count() == 0


def test_texts_are_converted_once_in_short_steps(spark, monkeypatch):
    """Equal texts are converted once where they lie, and few texts' tokens are held at a time."""
    from seqlake.operators import convert
    monkeypatch.setattr(convert, "STEP_CHARS", 10)
    calls = spark.sparkContext.accumulator(0)

    def words(text):
        calls.add(1)
        if text == "bad":
            raise ValueError("no game")
        return text.split() or None
    texts = ["a b c d e f g h", "bad", "", None, "x" * 40]
    rows = [(i, texts[i % 5]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    out = convert.convert_games(df, "text", words)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    why = {"bad": "converter_error", "": "unparseable", None: "empty"}
    got = sorted((r.id, r.text, r.tokens, r.reject_reason) for r in out.collect())
    assert got == [(i, t, None if t in why else t.split(), why.get(t)) for i, t in rows]
    assert calls.value == 4
