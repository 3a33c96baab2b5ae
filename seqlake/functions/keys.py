"""Deterministic randomness.

Every random decision is a pure function of ``(seed, …, id)`` so that a retried
task, a recomputed stage and an SQL oracle all draw the same value.  Never
``rand()``: its value depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    if isinstance(c, str):
        return F.col(c).cast("string")
    return F.lit(str(c))


def hash_key(seed, *parts) -> Column:
    """md5 hex of ``seed:part1:part2…`` — the sort key of every seeded permutation."""
    pieces = [_as_str(seed)]
    for p in parts:
        pieces += [F.lit(":"), _as_str(p)]
    return F.md5(F.concat(*pieces))


def xxhash_key(seed, *parts) -> Column:
    """64-bit key with half the shuffle bytes of md5 (production mode, no oracle)."""
    return F.xxhash64(F.lit(str(seed)), *[_as_str(p) for p in parts])


def uniform01(seed, *parts) -> Column:
    """Uniform draw in [0, 1): first 8 hex digits of the md5 key / 2^32."""
    h = F.substring(hash_key(seed, *parts), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(4294967296.0)
