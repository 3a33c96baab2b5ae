"""Connected components of an edge list, by alternating star contraction.

Each round points every node's larger neighbours at its smallest neighbour
(large star), then its smaller neighbours too (small star); the edge list
shrinks to one star per component in a logarithmic number of rounds.  All
rounds are joins and partial aggregates; each round's edges are written to the
shared folder, so a lost executor costs one round at most and no edge list ever
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import landed


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)``: every node that is not the smallest of its component, with that smallest.

    ``edges`` has columns ``u, v`` of one ordered type; loops, repeats and NULL ends are ignored.
    """
    cur = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = landed(cur, "edges")
    last = _state(cur)
    while last[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        cur = landed(small, "edges")
        now = _state(cur)
        if now == last:
            break
        last = now
    return cur
