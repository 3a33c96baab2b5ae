"""Corpus predicates: ratings, time control, lengths, termination,
threshold sweeps.  All are Catalyst expressions inside one whole-stage span;
simple comparisons on plain columns reach the Parquet scan as pushed filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CorpusConfig:
    """Thresholds of the corpus filter (defaults are the reference's)."""
    min_rating: int = 2200          # strict '>' on both players
    min_base_seconds: int = 180     # inclusive '>=' on the base time
    min_plies: int = 20             # inclusive '>=' on converted move count
    max_seq_len: int = 256          # chunk_len = max_seq_len + 1
    tc_separator: str = "+"
    rating_cols: tuple = ("WhiteElo", "BlackElo")
    tc_col: str = "TimeControl"
    allowed_terminations: tuple = field(default_factory=tuple)  # empty = no B5 filter


# Fixed value: the only accepted shape of an integer field (both engines agree on it).
INT_TEXT = "^[ \t]*[+-]?[0-9]+[ \t]*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rating_value(c, mode: str = "strict") -> Column:
    """Rating text -> int.  ``strict``: ANSI cast, malformed text fails the query;
    ``lenient``: ``try_cast`` (NULL, the row is dropped or quarantined)."""
    if mode == "strict":
        return _c(c).cast("int")
    if mode == "lenient":
        return F.trim(_c(c)).try_cast("int")
    raise ValueError(f"unknown mode {mode!r}")


def rating_filter(df: DataFrame, min_rating: int = 2200, cols=("WhiteElo", "BlackElo"),
                  mode: str = "strict") -> DataFrame:
    """B1: every rating ``> min_rating`` (strict), NULL drops the row."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (rating_value(c, mode) > F.lit(min_rating))
    return df.where(cond)


def base_seconds(tc, sep: str = "+") -> Column:
    """B2 helper: base time of ``"base<sep>inc"``; ``'-'``, NULL and junk -> NULL.
    Only ``^\\s*[+-]?\\d+\\s*$`` is accepted (DuckDB's TRY_CAST would also take
    decimals, exponents and hex; Spark's would not)."""
    part = F.split_part(F.coalesce(_c(tc), F.lit("-")), F.lit(sep), F.lit(1))
    return F.when(F.regexp_like(part, F.lit(INT_TEXT)), F.trim(part).try_cast("int"))


def time_control_filter(df: DataFrame, min_base: int = 180, tc_col: str = "TimeControl",
                        sep: str = "+") -> DataFrame:
    """B2: base time ``>= min_base`` (inclusive); unparseable -> dropped."""
    return df.where(base_seconds(tc_col, sep) >= F.lit(min_base))


def corpus_condition(cfg: CorpusConfig, mode: str = "strict") -> Column:
    cond = base_seconds(cfg.tc_col, cfg.tc_separator) >= F.lit(cfg.min_base_seconds)
    for c in cfg.rating_cols:
        cond = cond & (rating_value(c, mode) > F.lit(cfg.min_rating))
    if cfg.allowed_terminations:
        cond = cond & F.col("Termination").isin(*cfg.allowed_terminations)
    return cond


#: Why ``corpus_condition`` leaves a game out, in the order in which the reasons are looked at.
FILTER_REASONS = ("rating_missing", "rating_malformed", "rating_low", "time_control", "time_short", "termination")


def corpus_reject_reason(cfg: CorpusConfig, mode: str = "lenient") -> Column:
    """B3 with a reason: NULL exactly where ``corpus_condition`` is TRUE, else the first of ``FILTER_REASONS`` that
    holds.  ``mode="strict"`` fails on a malformed rating, as the strict cast does."""
    base = base_seconds(cfg.tc_col, cfg.tc_separator)
    values = [rating_value(c, mode) for c in cfg.rating_cols]
    checks = [("rating_missing", F.greatest(*[F.col(c).isNull().cast("int") for c in cfg.rating_cols], F.lit(0)) == 1)]
    if mode == "lenient":
        checks += [("rating_malformed", v.isNull()) for v in values]
    checks += [("rating_low", ~(v > F.lit(cfg.min_rating))) for v in values]
    checks += [("time_control", base.isNull()), ("time_short", base < F.lit(cfg.min_base_seconds))]
    if cfg.allowed_terminations:
        checks.append(("termination", ~F.coalesce(F.col("Termination").isin(*cfg.allowed_terminations), F.lit(False))))
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in checks])


def corpus_filter(df: DataFrame, cfg: CorpusConfig = CorpusConfig(), mode: str = "strict",
                  project=("movetext",)) -> DataFrame:
    """B1 and B2 (and B5 when configured) in one ``where``, then the projection."""
    out = df.where(corpus_condition(cfg, mode))
    return out.select(*project) if project else out


def min_length_filter(df: DataFrame, tokens_col: str = "tokens", min_len: int = 20) -> DataFrame:
    """Keep sequences with at least ``min_len`` tokens (plies); NULL dropped."""
    return df.where(F.size(tokens_col) >= F.lit(min_len))


def max_length_filter(df: DataFrame, len_col: str = "len", chunk_len: int = 257) -> DataFrame:
    """Keep encoded sequences with ``len <= chunk_len``; longer ones are dropped,
    never truncated."""
    return df.where(F.col(len_col) <= F.lit(chunk_len))


def termination_filter(df: DataFrame, allowed, col: str = "Termination") -> DataFrame:
    """Keep rows whose termination is in the allowed list."""
    return df.where(F.col(col).isin(*allowed))


def threshold_sweep(df: DataFrame, thresholds, cols=("WhiteElo", "BlackElo"),
                    mode: str = "lenient") -> DataFrame:
    """Rows surviving each candidate rating threshold, in one pass.

    One conditional count per threshold in a single aggregate (partial
    aggregation on the map side), then unpivoted to (threshold, n_kept)."""
    vals = [rating_value(c, mode) for c in cols]
    aggs = []
    for t in thresholds:
        cond = F.lit(True)
        for v in vals:
            cond = cond & (v > F.lit(t))
        aggs.append(F.count_if(cond).alias(f"t{t}"))
    wide = df.agg(*aggs)
    stack = ", ".join(f"{t}, t{t}" for t in thresholds)
    return wide.selectExpr(f"stack({len(thresholds)}, {stack}) AS (threshold, n_kept)")
