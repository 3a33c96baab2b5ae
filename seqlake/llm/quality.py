"""Quality rules as a short-circuit cascade (columns only, no Python).

The base counts of a text are exact and computed for every row.  The verdict
rules run behind the base rule in one CASE: a row stops at the first rule that
rejects it.  Their order comes from a sample: each rule's cost (seconds on the
sample) and selectivity (share it rejects), most rejections per second first.
The verdict is the OR of all rules, so it does not depend on that order; only
the work does.

Defined results: a NULL text has no words and fails the base rule; an empty
table gives an empty result; repeated rows each get a row; columns other than
the id and the text are neither read nor returned.  A window of three words is
compared by its 64-bit hash within one text.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import BLANKS, staged, words_of

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    for ch in chars:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def _repeat_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words``: words in 3-word windows that occur twice or more."""
    grams = F.when(F.size("_w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    df = staged(df, _g=grams)
    # only texts with a repeated window go on to sort their (hash, position) pairs
    repeated = F.size(F.array_distinct("_g")) < F.size("_g")
    df = staged(df, _s=F.when(repeated, F.sort_array(
        F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    pairs = F.zip_with(F.slice("_s", F.lit(1), F.size("_s") - 1), F.slice("_s", F.lit(2), F.size("_s") - 1),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(
                           F.array().cast("array<int>")))
    df = staged(df, _p=F.when(F.col("_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(pairs)))))
    gaps = F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")),
                      lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint")))


def base_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, _t, _w, n_lines, COUNTS)``: exact counts over whole texts."""
    d = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = staged(d, _w=words_of(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    d = staged(d, _l=lines)
    d = d.select(
        id_col, "_t", "_w", F.size("_l").cast("bigint").alias("n_lines"),
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"))
    return _repeat_words(d).drop("_g", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rejection rules of the verdict, over the columns of ``base_counts``."""
    capitals = F.length("_t") - F.length(F.regexp_replace("_t", "[A-Z]+", ""))
    letters = F.length("_t") - F.length(F.regexp_replace("_t", "[A-Za-z]+", ""))
    bare = F.size(F.filter("_w", lambda x: ~x.rlike(r"[A-Za-z]|[^\x00-\x7F]")))
    return {
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("n_words"),
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "capitals": 2 * capitals > letters,
        "bare_words": 10 * bare > 3 * F.col("n_words"),
    }


def cascade_order(sample: DataFrame, named: dict[str, Column]) -> list[str]:
    """Rule names, most rejections per second of cost on ``sample`` (counted rows) first.

    The sample is cached only while the rules are timed; an empty one leaves the given order.
    """
    sample = sample.cache()
    try:
        rows = sample.count()
        if not rows:
            return list(named)
        score = {}
        for name, rule in named.items():
            began = time.perf_counter()
            hit = sample.agg(F.count(F.when(rule, 1))).first()[0]
            score[name] = (hit / rows) / max(time.perf_counter() - began, 1e-6)
        return sorted(named, key=lambda k: -score[k])
    finally:
        sample.unpersist()


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, ``base_failed``, ``rejected_by`` (first rule hit, NULL if none) and ``kept``."""
    counts = base_counts(df, id_col, text_col)
    named = rules()
    # a Bernoulli draw of about ``sample_rows`` rows, taken before any counting
    share = min(1.0, sample_rows / max(df.select(id_col).count(), 1))
    order = cascade_order(base_counts(df.sample(False, share, 42), id_col, text_col), named)
    hit = F.when(base_failed(), F.lit("base"))
    for name in order:
        hit = hit.when(named[name], F.lit(name))
    return (counts.withColumn("base_failed", base_failed()).withColumn("rejected_by", hit)
            .withColumn("kept", F.col("rejected_by").isNull()).drop("_t", "_w"))
