"""Movetext conversion (H1 clean_movetext, H2 convert_games, K1 converter plug-in).

H1 is a chain of Catalyst ``regexp_replace`` calls.  H2 runs a per-row
converter (``str -> list[str] | None``) as a ``mapInPandas`` job over rows that
lie sorted by their text, so that identical movetexts are converted once; a
converter exception becomes NULL with a reason.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.text import WS_PATTERN, split_ws

# The PGN pieces removed from movetext.
BRACE_COMMENT = r"\{[^}]*\}"
LINE_COMMENT = ";[^\n]*"
GLYPH = r"\$[0-9]+"
MOVE_NUMBER = r"[0-9]+\.+"
ANNOTATION_SUFFIX = "[!?]+$"
RESULT_MARKERS = ["1-0", "0-1", "1/2-1/2", "*"]


def _without_variations(t: Column) -> Column:
    """Text outside all parentheses, nested to any depth; unbalanced text comes back as it is.

    The text is cut before each parenthesis and the depth is folded over the pieces."""
    def step(s, piece):
        depth = (s["depth"] + F.when(piece.startswith("("), 1).when(piece.startswith(")"), -1).otherwise(0)).cast("int")
        return F.struct(
            depth.alias("depth"), F.least(s["low"], depth).alias("low"),
            F.when(depth == 0, F.concat(s["kept"], F.array(F.regexp_replace(piece, r"^\)", "")))).otherwise(s["kept"])
             .alias("kept"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"), F.array().cast("array<string>").alias("kept"))
    outside = F.aggregate(F.split(t, r"(?=[()])"), start, step, lambda s: F.when(
        (s["depth"] == 0) & (s["low"] == 0), F.array_join(s["kept"], " ")))
    return F.when(F.regexp_like(t, F.lit("[()]")), F.coalesce(outside, t)).otherwise(t)


def strip_movetext(text) -> Column:
    """Movetext with comments, glyphs and variations (any nesting) removed; parentheses left over are unbalanced."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(t, BRACE_COMMENT, " ")
    t = F.regexp_replace(t, LINE_COMMENT, " ")
    t = F.regexp_replace(t, GLYPH, " ")
    return _without_variations(t)


def clean_movetext(text) -> Column:
    """H1 as one column expression: struct(tokens array<string>, reject_reason string).
    Prefer ``clean_movetext_df`` when several fields are used (it keeps the
    regex chain from being evaluated once per use).  Leftover
    unbalanced parentheses reject; an empty result rejects."""
    stripped = strip_movetext(text)
    body = F.regexp_replace(stripped, MOVE_NUMBER, " ")
    toks = F.filter(F.transform(split_ws(body), lambda x: F.regexp_replace(x, ANNOTATION_SUFFIX, "")),
                    lambda x: (x != F.lit("")) & ~x.isin(*RESULT_MARKERS))
    reason = (F.when(F.col(text).isNull() if isinstance(text, str) else text.isNull(), F.lit("empty"))
               .when(F.regexp_like(stripped, F.lit("[()]")), F.lit("unbalanced"))
               .when(F.size(toks) == 0, F.lit("empty")))
    return F.struct(F.when(reason.isNull(), toks).alias("tokens"), reason.alias("reject_reason"))


def clean_movetext_df(df: DataFrame, text_col: str, tokens_col: str = "tokens",
                      reason_col: str = "reject_reason") -> DataFrame:
    """H1 as staged columns: the stripped text and the token array are each
    referenced more than once, so as separate projections Catalyst keeps them
    computed once per row instead of inlining the regex chain at every use."""
    out = (df.withColumn("_stripped", strip_movetext(text_col))
             .withColumn("_toks", F.filter(
                 F.transform(split_ws(F.regexp_replace("_stripped", MOVE_NUMBER, " ")),
                             lambda x: F.regexp_replace(x, ANNOTATION_SUFFIX, "")),
                 lambda x: (x != F.lit("")) & ~x.isin(*RESULT_MARKERS))))
    reason = (F.when(F.col(text_col).isNull(), F.lit("empty"))
               .when(F.regexp_like("_stripped", F.lit("[()]")), F.lit("unbalanced"))
               .when(F.size("_toks") == 0, F.lit("empty")))
    return (out.withColumn(reason_col, reason)
               .withColumn(tokens_col, F.when(F.col(reason_col).isNull(), F.col("_toks")))
               .drop("_stripped", "_toks"))


def vocabulary_converter(tokens) -> Callable[[str | None], list[str] | None]:
    """Built-in converter: the whitespace tokens of a text, if all of them are in the vocabulary, else None.

    ``tokens`` is a fixed vocabulary, as ``vocab.fixed_tokens`` without its specials: 1,968 moves."""
    known, gap = frozenset(tokens), re.compile(WS_PATTERN)

    def convert(text: str | None) -> list[str] | None:
        found = [t for t in gap.split(text or "") if t]
        return found if found and known.issuperset(found) else None
    return convert


#: Characters of the texts that are converted before their tokens leave Python.
STEP_CHARS = 1 << 19


def convert_games(df: DataFrame, text_col: str, converter: Callable[[str | None], list | None],
                  n_partitions: int | None = None) -> DataFrame:
    """H2: convert every text with ``converter``; unparseable or empty -> NULL
    tokens with ``reject_reason``; exceptions are swallowed to NULL.

    The rows move once, to where equal texts lie side by side, and each text is
    converted at its first row; a text with very many rows is split over tasks
    by adaptive execution, and converted once in each.  A step of some hundred
    kilobytes of texts is converted at a time, so a worker's memory does not
    grow with the input."""
    kept = [c for c in df.columns if c not in ("tokens", "reject_reason")]
    hashable = [c for c in kept if "map<" not in df.schema[c].dataType.simpleString()]
    # rows without a text are spread by their other columns
    near = F.when(F.col(text_col).isNull(), F.xxhash64(*hashable)).otherwise(F.xxhash64(text_col))
    keyed = df.select(*kept, near.alias("_th"))
    keyed = keyed.hint("rebalance", n_partitions, "_th") if n_partitions else keyed.hint("rebalance", "_th")

    def run(batches):
        last, known = None, None
        for pdf in batches:
            sizes = pdf[text_col].str.len().fillna(0).cumsum().to_numpy() if len(pdf) else []
            step = [int(n) // STEP_CHARS for n in sizes]
            cuts = [0, *(i for i in range(1, len(step)) if step[i] != step[i - 1]), len(step)]
            for a, b in zip(cuts, cuts[1:]):
                part, out, why = pdf.iloc[a:b], [], []
                for t in part[text_col].tolist():
                    if not isinstance(t, str):
                        out.append(None)
                        why.append("empty")
                        continue
                    if known is None or t != last:
                        try:
                            r, w = converter(t), None
                        except Exception:  # noqa: BLE001 - a failing game is a reject, not a failed job
                            r, w = None, "converter_error"
                        else:
                            w = None if r else "unparseable"
                            r = list(r) if r else None
                        last, known = t, (r, w)
                    out.append(known[0])
                    why.append(known[1])
                yield part[kept].assign(tokens=pd.Series(out, part.index, object), reject_reason=pd.Series(why, part.index, object))

    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in kept],
                           T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("reject_reason", T.StringType())])
    return keyed.sortWithinPartitions("_th").mapInPandas(run, schema)
