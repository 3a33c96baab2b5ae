"""Whitespace tokenisation shared by every text-consuming operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace class (space, tab, LF, CR, FF).  Not `\s`: the
# JVM and RE2 disagree on vertical tab, and `trim` only strips spaces.
WS_PATTERN = "[ \t\n\r\f]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_ws(text) -> Column:
    """Split on runs of whitespace and drop empty pieces (strip + split)."""
    return F.filter(F.split(_col(text), WS_PATTERN), lambda t: t != F.lit(""))


def join_ws(tokens) -> Column:
    """Join tokens with one space (the text-line form of a sequence)."""
    return F.array_join(_col(tokens), " ")
