import random

import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

from seqlake.llm import sentencepiece as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def both():
    return S.Pieces(S.read_model()), spm.SentencePieceProcessor(model_file=S.MODEL)


ODD = ["", " ", "  a  b ", "\n\t", "é日本🎉 x", "<s></s><unk><0x41>", "a\0b \0￾", "▁x ▁▁y", "x" * 3000, "ab " * 500,
       "https://www.example.com/abcdefghijklmnop?x=1&y=2 Hello World! internationalization",
       "def f(x):\n    return x+1", "ￏ￾￿", " " * 100, "1234567890" * 30, "ﷺ ẞ ǅ"]


def test_odd_texts_equal_the_library(both):
    own, lib = both
    for t, ids in zip(ODD, own.encode(ODD)):
        assert ids == lib.encode(t), t
        assert own.decode(ids) == lib.decode(ids), t


def test_random_texts_equal_the_library(both):
    own, lib = both
    rng = random.Random(4)
    alphabet = "etaoin shrdlu  éßç\n.,!▁日0aa"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(800)]
    assert own.encode(texts) == lib.encode(texts)
    assert [own.decode(i) for i in own.encode(texts)] == lib.decode(lib.encode(texts))


def test_round_trip_tells_whether_decoding_gives_the_text(spark, both):
    own = both[0]
    ids, same = own.encode(iter(ODD), verify=True)
    assert same == [own.decode(i) == t for t, i in zip(ODD, ids)] and not same[ODD.index("▁x ▁▁y")]
    df = spark.createDataFrame([(1, "a▁b"), (2, "a b"), (3, None), (4, "▁")], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in S.encode(df).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_cache_turnover(both, monkeypatch):
    own, lib = S.Pieces(S.read_model()), both[1]
    monkeypatch.setattr(S, "CACHED_CHUNKS", 5)
    monkeypatch.setattr(S, "CACHED_PAIRS", 50)
    for t in ["one two three four five six seven", "one eight nine ten", "eleven twelve one two", "one two three"] * 2:
        assert own.encode([t]) == [lib.encode(t)]


def test_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in S.encode(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].ids == both[1].encode(r.text) and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)
        assert got[r.doc_id].round_trip
    back = {r.doc_id: r.text for r in S.decode(S.encode(docs)).collect()}
    assert back == {r.doc_id: r.text for r in rows}


def test_edges(spark):
    rows = [(1, None, None, None, None), (1, "", None, None, None), (None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3)]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(1))
    got = sorted((str(r.doc_id), r.n_tokens, r.round_trip) for r in S.encode(df).collect())
    assert got == [("1", 0, True), ("1", 0, True), ("None", 2, True), ("None", 2, True)]
    assert S.encode(df.where("false")).count() == 0
    assert S.decode(S.encode(df)).where("text = ''").count() == 2
