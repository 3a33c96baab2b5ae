import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from seqlake.llm import queries, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(words, least=24):
    """All runs, lag by lag."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n_, q) for (s, n_), q in out.items())


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words = [rng.choice("abcdef"[:rng.randint(1, 6)]) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            base = [rng.choice("abc") + rng.choice("xy") for _ in range(rng.randint(1, 30))]
            words += (base * rng.randint(2, 40))[:rng.randint(1, 200)]
            words += [rng.choice("abcdef") for _ in range(rng.randint(0, 10))]
        yield words


def test_against_all_lags():
    for words in texts(1, 150):
        ids = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, np.int64)
        assert [tuple(r) for r in runs.runs_of(ids).tolist()] == brute(words)


def test_structured_words():
    """Sequences that weak fingerprints confuse, and runs of runs."""
    thue, fib = [0], [[0], [0, 1]]
    for _ in range(9):
        thue += [1 - x for x in thue]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    for seq in (thue, fib[-1], ([1] * 30 + [2]) * 40, [7] * 1000, list(range(500)) * 3):
        assert [tuple(r) for r in runs.runs_of(np.array(seq)).tolist()] == brute(seq)


def expected(rows):
    out = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        found = brute(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, n_, q in found for k in range(s + q, s + n_)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                    sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
                    sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return sorted(map(str, out))


def test_query(spark, tmp_path):
    """NULLs, ties, repeated rows, several steps, clashing columns, long texts."""
    rows = [(i, " ".join(w)) for i, w in enumerate(texts(2, 120))]
    rows += [(None, "a " * 100), (None, None), (500, None), (501, ""), (502, " \t\n"), (7, rows[7][1]), (7, rows[7][1]),
             (503, "é è é è\x1c " * 40), (504, "x y " * 12 + "z z z " * 8), (505, "w " * 20000), (506, "é日 " * 8),
             (-40, "a b c " * 30)]
    rows += [(i, "one two three four five six seven " * 9) for i in range(600, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS h", "'x' AS w", "2 AS n_words", "array(1) AS runs", "'y' AS collapsed", "3L AS id")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_runs(spark, str(tmp_path)).collect()
    small = [r for r in rows if r[0] != 505]
    assert sorted(str(tuple(r)) for r in got if r.doc_id != 505) == expected(small)
    long = next(r for r in got if r.doc_id == 505)
    assert (long.n_runs, long.length, long.period) == (1, 20000, 1)
    one, many = (runs.collapse(df, step_words=n) for n in (1, 1 << 20))
    assert one.exceptAll(many).count() == 0 == many.exceptAll(one).count()
    empty = runs.collapse(spark.createDataFrame([], DOCS).withColumn("runs", F.lit(1)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]
