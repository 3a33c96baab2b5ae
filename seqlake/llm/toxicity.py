"""Toxicity by a classifier chain over bounded labelled samples.

The categories are predicted one after another by logistic models.  Each later
model sees the probabilities of the earlier ones; in training those are
out-of-fold predictions, so a later model learns how far to trust them on texts
they were not fitted to.  The same out-of-fold predictions set each category's
threshold (best F1).

Features of a text are the words it holds (runs of letters, lower case) and the
word beginnings that two or three of its different words share.  Document
frequencies and label counts are aggregated in Spark over the sample; the
features kept are the most associated ones of each category (z-score).  The
sample is bounded by ``MAX_ROWS`` labelled documents, the smallest hashes of
their ids, one of each text; scoring reads every document's whole text.

Defined results: a NULL or empty text has no features and gets the base rate;
labels with a NULL id or category are not trained on, of several labels of an
id, or of equal texts, the largest counts; a very long text counts whole, in
training and scoring; columns of any other name are neither read nor in the way
(``without`` returns them); without labels nothing is rejected; repeated rows each
get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import landed, small_batches

#: Parameters: the bounded sample, features per category, least documents and z-score of a feature.
MAX_ROWS = 8_000
MAX_FEATURES = 4_096
MIN_DOCS = 5
MIN_Z = 3.0
FOLDS = 5
PENALTY = 0.3
STEPS = 250
BEGINNINGS = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None, beginnings: frozenset | None = None) -> set[str]:
    """Words of a text, and ``beginning*n`` for n = 2, 3 (only ``beginnings``, if given)."""
    words = set(_WORD.findall((text or "").lower()))
    heads = Counter(w[:n] for w in words for n in BEGINNINGS if len(w) > n and (beginnings is None or w[:n] in beginnings))
    return words | {f"{h}*{n}" for h, k in heads.items() for n in (2, 3) if k >= n}


def _fit(starts, index, n_features: int, extra: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic regression on 0/1 features in rows ``index[starts[i]:starts[i+1]]``; the last weight is the bias."""
    rows = np.repeat(np.arange(len(y)), np.diff(starts))
    w = np.zeros(n_features + extra.shape[1] + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -20.0
    if not 0 < y.sum() < len(y):
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[index], len(y)) + extra @ w[n_features:-1] + w[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(index, e[rows], n_features), extra.T @ e, [e.sum()]])
        g[:-1] += PENALTY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.08 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def _predict(starts, index, n_features, extra, w) -> np.ndarray:
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    z = np.bincount(rows, w[index], len(starts) - 1) + extra @ w[n_features:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float(max(0.4, (p[order][k] + below) / 2))   # never reject on slight evidence


class Chain:
    """The trained chain: plain arrays and a feature dictionary, small enough for every task."""

    def __init__(self, categories, vocabulary, weights, thresholds):
        self.categories, self.vocabulary = list(categories), vocabulary
        self.weights, self.thresholds = weights, thresholds
        self.beginnings = frozenset(f.rpartition("*")[0] for f in vocabulary if "*" in f)

    def probabilities(self, texts) -> np.ndarray:
        """One row per text, one column per category."""
        ids = [[i for f in features(t, self.beginnings) if (i := self.vocabulary.get(f)) is not None] for t in texts]
        starts = np.cumsum([0, *map(len, ids)])
        index = np.array([i for row in ids for i in row], dtype=np.int64)
        out = np.zeros((len(ids), 0))
        for w in self.weights:
            out = np.column_stack([out, _predict(starts, index, len(self.vocabulary), out, w)])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id",
          text_col: str = "text", max_rows: int = MAX_ROWS) -> Chain:
    """Fit the chain; ``labels`` has the id and a 0/1 column per category, in chain order."""
    y_cols = [f"y{k}" for k in range(len(categories))]
    known = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(y) for c, y in zip(categories, y_cols)])
    known = known.dropna().groupBy("id").agg(*[F.max(y).alias(y) for y in y_cols])
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # the sample of ids is bounded by max_rows, whatever the labels' size
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.withColumn("h", F.xxhash64("text")).groupBy("h").agg(
        F.min("text").alias("text"), *[F.max(y).alias(y) for y in y_cols])
    as_features = F.pandas_udf(lambda s: pd.Series([sorted(features(t)) for t in s]), "array<string>")
    sample = landed(sample.select("h", *y_cols, as_features("text").alias("f")), "toxic-sample")

    n, *pos = sample.agg(F.count("*"), *[F.coalesce(F.sum(y), F.lit(0.0)) for y in y_cols]).first()
    counts = sample.select(F.explode("f").alias("f"), *y_cols).groupBy("f").agg(
        F.count("*").alias("n"), *[F.sum(y).alias(y) for y in y_cols]).where(F.col("n") >= MIN_DOCS)
    vocabulary: dict[str, int] = {}
    for y, p in zip(y_cols, pos):
        rate = p / max(n, 1)
        if 0 < rate < 1:
            z = (F.col(y) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
            top = counts.select("f", F.abs(z).alias("z")).where(F.col("z") >= MIN_Z)
            for r in top.orderBy(F.desc("z"), "f").limit(MAX_FEATURES).collect():
                vocabulary.setdefault(r.f, len(vocabulary))
    to_ids = F.pandas_udf(lambda s: pd.Series([[vocabulary[x] for x in f if x in vocabulary] for f in s]), "array<int>")
    rows = sorted(sample.select("h", *y_cols, to_ids("f").alias("i")).collect(), key=lambda r: r.h)  # max_rows at most

    starts = np.cumsum([0, *[len(r.i) for r in rows]])
    index = np.array([i for r in rows for i in r.i], dtype=np.int64)
    fold = np.array([r.h % FOLDS for r in rows])
    nf = len(vocabulary)

    def part(mask):
        keep = np.flatnonzero(mask)
        spans = [index[starts[i]:starts[i + 1]] for i in keep]
        return np.cumsum([0, *map(len, spans)]), np.concatenate([*spans, np.zeros(0, np.int64)])

    parts = [(fold == k, part(fold == k), part(fold != k)) for k in range(FOLDS)]
    earlier = np.zeros((len(rows), 0))
    weights, thresholds = [], []
    for y_col in y_cols:
        y = np.array([r[y_col] for r in rows], dtype=float)
        out = np.zeros(len(rows))
        for held, inside, outside in parts:
            w = _fit(*outside, nf, earlier[~held], y[~held])
            out[held] = _predict(*inside, nf, earlier[held], w)
        weights.append(_fit(starts, index, nf, earlier, y))
        thresholds.append(_best_threshold(out, y) if 0 < y.sum() < len(y) else 2.0)
        earlier = np.column_stack([earlier, out])
    return Chain(categories, vocabulary, weights, thresholds)


def probability_column(chain: Chain, text: Column) -> Column:
    """``array<double>`` of category probabilities of a text column, in chain order."""
    return F.pandas_udf(lambda s: pd.Series(list(chain.probabilities(s))), "array<double>")(text)


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, p_<category>…, is_<category>…``: one row per input row."""
    small_batches(df.sparkSession)
    d = df.select(id_col, probability_column(chain, F.col(text_col)).alias("_p"))
    return d.select(
        id_col, *[F.get("_p", F.lit(k)).alias(f"p_{c}") for k, c in enumerate(chain.categories)],
        *[(F.get("_p", F.lit(k)) >= chain.thresholds[k]).alias(f"is_{c}") for k, c in enumerate(chain.categories)])


def without(df: DataFrame, chain: Chain, category: str, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the chain does not put in ``category``, with all their columns."""
    small_batches(df.sparkSession)
    k = chain.categories.index(category)
    return df.where(F.get(probability_column(chain, F.col(text_col)), F.lit(k)) < chain.thresholds[k])
