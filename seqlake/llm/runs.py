"""Periodic runs of words, found by online dyadic square catching.

A run is a stretch of words that repeats with a smallest period ``q``, is at
least ``min_length`` words and ``min_exponent`` periods long, and cannot be
extended.  Its words equal those ``q`` places on over a stretch of at least
``2 q`` places, so with ``B`` the power of two at or below ``q`` one whole block
``[m B, (m + 1) B)`` lies in that stretch.

* Every completed block of ``B = 2^k`` words gets a catcher for the periods
  ``B .. 2 B - 1``.
* Each appended word completes one suffix of ``B`` words per level; its place
  names the one catcher it can answer to, and fingerprints compare the two.
  That is one comparison a word and level.  The comparisons do not depend on one
  another, so all words of a batch are appended in one array step a level.
* A caught suffix is a square.  Squares that neighbouring catchers report with
  one period merge; the merged stretch grows to both sides by comparing suffixes
  of 2^(k-1), ..., 2, 1 words, which is all that is left to a next block.
* Multiples of the smallest period end up with the same ends; the smallest stays.

Fingerprints have 64 bits and never miss equal words.  The work is
``O(n log n)`` for n words, whatever repeats, and each document is on its own:
no shuffle, and a lost executor costs its tasks only.

Defined results: a NULL text has no words; a NULL or repeated id is kept as it is
(one row out for each row in); other columns are not read; an empty table gives
no rows; a long text takes memory in proportion to its words times their
logarithm, and long texts are worked on one at a time.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shortest run, in words, and in periods.
MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words that are appended in one array step; one longer text is a step of its own.
STEP_WORDS = 1 << 17

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _SPREAD
    x ^= x >> _SHIFT
    x *= _FOLD
    x ^= x >> _SHIFT
    return x


def suffix_levels(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """Per level k the fingerprints of the ``2^k`` words from each place, while ``2^k <= longest``."""
    levels = [_mixed(ids.astype(np.uint64) + np.uint64(1))]
    b = 1
    while 2 * b <= longest and len(levels[-1]) > b:
        h = levels[-1]
        levels.append(_mixed(h[:-b] * _FOLD + h[b:]))
        b *= 2
    return levels


def _caught(h: np.ndarray, b: int):
    """Merged squares of the catchers of one level: periods, first and last block of each."""
    rows = (len(h) + b - 1) // b
    catchers = np.repeat(h[::b], b)[:max(len(h) - b, 0)]
    hit = np.flatnonzero(h[b:] == catchers)
    if not len(hit):
        return None
    # squares in order of their period, then of their catcher; neighbours merge
    key = (hit % b) * rows + hit // b
    key.sort()
    period, block = key // rows + b, key % rows
    new = np.empty(len(key), bool)
    new[0] = True
    new[1:] = (np.diff(block) != 1) | (np.diff(period) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return period[first], block[first], block[last]


def runs_of(ids: np.ndarray, longest: int | None = None, min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """``(start, length, period)`` rows of all runs of a word sequence, by start, then period.

    ``min_exponent`` is 3 at least: a run of fewer periods need not hold a whole
    block of its level.  ``longest`` bounds the length of a run, if known.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    n = len(ids)
    levels = suffix_levels(ids, max(1, min(longest or n, n) // min_exponent))
    found = []
    for k, h in enumerate(levels):
        b = 1 << k
        caught = _caught(h, b)
        if caught is None:
            continue
        q, start, end = caught[0], caught[1] * b, (caught[2] + 1) * b
        for j in range(k - 1, -1, -1):
            step, g = 1 << j, levels[j]
            at = np.minimum(end, len(g) - 1)
            there = np.minimum(end + q, len(g) - 1)
            end = np.where((end + q < len(g)) & (g[at] == g[there]), end + step, end)
            back = start - step
            at = np.maximum(back, 0)
            start = np.where((back >= 0) & (g[at] == g[np.minimum(at + q, len(g) - 1)]), back, start)
        length = end - start + q
        keep = length >= np.maximum(min_length, min_exponent * q)
        found.append(np.stack([start[keep], length[keep], q[keep]], axis=1))
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    if len(out):
        fresh = np.append(True, (out[1:, 0] != out[:-1, 0]) | (out[1:, 1] != out[:-1, 1]))
        out = out[fresh]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _step(texts: list[list[bytes]], min_length: int, min_exponent: int):
    """Runs and kept words of several texts at once; a word of its own stands between two texts."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    long = [i for i, words in enumerate(texts) if len(words) >= min_length]
    parts, begins, at = [], [], 0
    for i in long:
        begins.append(at)
        parts.append(np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i])))
        at += len(texts[i]) + 1
    runs = [np.zeros((0, 3), np.int64)] * len(texts)
    kept = [b" ".join(words) for words in texts]
    if not long:
        return runs, kept
    joined = np.concatenate([x for j, p in enumerate(parts) for x in (p, [len(number) + j])])
    found = runs_of(joined, max(len(texts[i]) for i in long), min_length, min_exponent)
    owner = np.searchsorted(begins, found[:, 0], "right") - 1
    for j in np.unique(owner):
        i, own = long[j], found[owner == j]
        own[:, 0] -= begins[j]
        edges = np.zeros(len(texts[i]) + 1, np.int64)
        np.add.at(edges, own[:, 0] + own[:, 2], 1)
        np.add.at(edges, own[:, 0] + own[:, 1], -1)
        repeated = np.cumsum(edges[:-1]) > 0
        runs[i] = own
        kept[i] = b" ".join(w for w, gone in zip(texts[i], repeated.tolist()) if not gone)
    return runs, kept


def collapse(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH,
             min_exponent: int = MIN_EXPONENT, step_words: int = STEP_WORDS) -> DataFrame:
    """``id_col, n_words, runs, collapsed``: the runs of each text, and the text without their repeats.

    ``collapsed`` holds the words that no run contains after its first period, joined by one blank.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))

    def work(batches):
        for batch in batches:
            texts, n_words, runs, kept = [], [], [], []
            size = 0

            def flush():
                nonlocal texts, size
                r, k = _step(texts, min_length, min_exponent)
                n_words.extend(map(len, texts))
                runs.extend(r)
                kept.extend(k)
                texts, size = [], 0
            for body in batch.column(1):
                words = body.as_py().split()
                if texts and size + len(words) > step_words:
                    flush()
                texts.append(words)
                size += len(words)
            flush()
            flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], RUN.names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), lists, pa.array(kept, pa.binary())],
                ["id", "n_words", "runs", "collapsed"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.BinaryType())])
    return src.mapInArrow(work, schema).select(
        F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
