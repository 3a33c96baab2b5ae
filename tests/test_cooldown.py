"""Cooldown over blocks: heads on the driver and by binary lifting give the sequential rule's events."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators.events import _emitted, _exits, cooldown


def sequential(events, gap):
    last, out = {}, set()
    for k, t, i in sorted(events):
        if k not in last or t - last[k] >= gap:
            out.add(i)
            last[k] = t
    return out


def test_pointers():
    rng = random.Random(3)
    for gap in (0, 1, 5, 50):
        t = np.array(sorted(rng.randint(0, 200) for _ in range(rng.randint(1, 120))))
        for first in range(0, len(t), 7):
            want = sequential([("k", x, i) for i, x in enumerate(t.tolist()) if i >= first], gap)
            assert set(_emitted(t, gap, first).tolist()) == want and _exits(t, gap)[first] == t[max(want)]


@pytest.mark.parametrize("blocks", [1, 2, 9])
def test_both_ways_equal_the_rule(spark, blocks):
    """Hot keys over many blocks, dense and sparse ones, equal times, a key within one gap."""
    rng = random.Random(blocks)
    events = [("hot", rng.randint(0, 3000), i) for i in range(400)] + [("dense", rng.randint(0, 90), 1000 + i) for i in range(200)]
    events += [(f"k{rng.randint(0, 30)}", rng.randint(0, 500), 2000 + i) for i in range(200)]
    events += [("same", 7, 3000 + i) for i in range(100)] + [("wide", 1000 * i, 4000 + i) for i in range(60)]
    df = spark.createDataFrame(events, "user string, ts long, eid long")
    for head_rows in (100_000, 0):
        got = {r.eid for r in cooldown(df, "user", "ts", "eid", 100, n_blocks=blocks, head_rows=head_rows).collect()}
        assert got == sequential(events, 100), head_rows


def test_many_events_within_one_gap(spark):
    """A key with 300,000 events within three gaps: its heads never reach the driver."""
    df = spark.range(300_000).select(F.lit(1).cast("long").alias("user"), (F.col("id") * 10).alias("ts"), F.col("id").alias("eid"))
    got = sorted(r.eid for r in cooldown(df, "user", "ts", "eid", 1_000_000, n_blocks=6, head_rows=1000).collect())
    assert got == [0, 100_000, 200_000]
