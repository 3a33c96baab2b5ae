import math
import random

import pytest
from pyspark.sql import functions as F

from seqlake.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_features():
    assert toxicity.features(None) == set() == toxicity.features(" 12 _ ")
    assert toxicity.features("Idiot!! idiot### É") == {"idiot", "é"}
    got = toxicity.features("schlaf schlag schlau schon")
    assert {"schl*2", "schl*3", "schla*2", "schla*3"} <= got and "scho*2" not in got


def test_held_out_accuracy(spark):
    """Trained on labels of half the documents, tested on the others' labels."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2)) == 0
    chain = toxicity.train(docs, labels.where(half), ["poor", "toxic"])
    got = toxicity.score(docs, chain).join(labels.where(~half), "doc_id")
    tp, fp, fn, n, poor = got.agg(
        F.count_if(F.expr("is_toxic AND toxic = 1")), F.count_if(F.expr("is_toxic AND toxic = 0")),
        F.count_if(F.expr("NOT is_toxic AND toxic = 1")), F.count("*"), F.avg(((F.col("p_poor") > 0.5) == (F.col("poor") == 1)).cast("int"))).first()
    print(tp, fp, fn, n, poor, chain.thresholds, len(chain.vocabulary))
    assert tp / (tp + fn) > 0.75 and fp / n < 0.01 and poor > 0.75


def test_edges(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"]) for _ in range(20)) + (" vile" if i % 4 == 0 else ""), None, None, None)
            for i in range(400)] + [(None, None, None, None, None), (3, "", None, None, None), (4, "vile " * 5000, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("y0", F.lit("x")).withColumn("f", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None if i == 8 else 0) for i in range(200)] + [(None, 1, 1), (4, 0, 0)],
                                   "doc_id long, toxic int, mild int")
    chain = toxicity.train(docs, labels, ["mild", "toxic"])
    got = toxicity.score(docs, chain).collect()
    assert len(got) == len(rows)
    assert all(r.is_toxic == (r.doc_id is not None and r.doc_id % 4 == 0 and r.p_toxic > 0.5) for r in got)
    assert sum(r.is_toxic for r in got) == 101 and not any(r.is_mild for r in got)
    left = toxicity.without(docs, chain, "toxic")
    assert left.columns == docs.columns and left.count() == len(rows) - 101
    none = toxicity.train(docs, labels.where("false"), ["mild", "toxic"])
    assert toxicity.without(docs, none, "toxic").count() == len(rows)
    empty = docs.where("false")
    assert toxicity.score(empty, toxicity.train(empty, labels, ["toxic"])).count() == 0


def plain_chain(text, chain):
    """The chain written out for one text: each category's logistic model sees the probabilities before it."""
    found = [chain.vocabulary[f] for f in toxicity.features(text) if f in chain.vocabulary]
    n, out = len(chain.vocabulary), []
    for w in chain.weights:
        z = sum(w[i] for i in found) + sum(w[n + k] * p for k, p in enumerate(out)) + w[-1]
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_plain_chain_and_label_ties(spark):
    """Equal texts with different labels train the same chain in any order; scores equal the chain written out."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "grey"]) for _ in range(6)) + (" vile" if i % 5 == 0 else "")
             + (" schlaf schlag" if i % 3 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(0)).withColumn("id", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 == 0 and i % 7 > 0)) for i in range(600)],
                                   "doc_id long, poor int, toxic int")
    chain = toxicity.train(docs, labels, ["poor", "toxic"])
    again = toxicity.train(docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(5), ["poor", "toxic"])
    assert chain.vocabulary == again.vocabulary and chain.thresholds == again.thresholds
    assert all((a == b).all() for a, b in zip(chain.weights, again.weights))
    texts = dict(rows)
    for r in toxicity.score(docs, chain).collect():
        p = plain_chain(texts[r.doc_id], chain)
        assert abs(r.p_poor - p[0]) < 1e-9 and abs(r.p_toxic - p[1]) < 1e-9
        assert (r.is_poor, r.is_toxic) == tuple(x >= t for x, t in zip((r.p_poor, r.p_toxic), chain.thresholds))
    assert toxicity.without(docs, chain, "toxic").columns == docs.columns


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    out = queries.op5_toxicity(spark, f"/root/testdata/{sf}")
    assert out.count() == spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").count()
