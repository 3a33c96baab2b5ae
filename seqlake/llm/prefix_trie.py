"""Prefix trie of conversations: one node per distinct sequence of first turns.

* A prefix is known by 128 bits over sums of its turns' positioned hashes, so the
  digests of all prefixes are running sums; a conversation that holds a third of
  all turns is spread over range blocks like any other.
* Count-min screening (``sketch``): a prefix whose estimate is one belongs to one
  conversation for certain, and so does everything behind it.  Those tails become
  nodes where they are.  Only prefixes that may be shared are shuffled, and
  grouped exactly by their digest.
* A conversation is its nodes' smallest member from some depth on (``own``).
  With that one number per conversation all sums over a subtree become sums over
  a node's members: a member's words from the node on, less the words of the
  nodes that it owns.  No walk over the trie, no round per depth; a node with a
  third of all conversations is a partial aggregate.

Joins that carry a node's data back to its members meet hot nodes: at most
``HOT`` nodes can hold more than one in ``HOT`` of the shared prefixes, so those,
a proven bound, are broadcast and the others shuffled.

Defined results: rows with a NULL conversation id take no part; a NULL role or
text is empty; turns are ordered by turn (NULL first), then role, then text, and
repeated rows are turns of their own; other columns are not read; an empty table
has no nodes, not even a root; a long text is hashed where it is read and does
not travel any further.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import BLANKS, landed
from seqlake.llm.sketch import ROWS, company, may_recur, width_for
from seqlake.operators.ordered import running_sum

#: At most so many nodes hold more than one in so many of the shared prefixes.
HOT = 1000
#: Depths of one conversation that share a join key.
_DEPTHS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
_LANES = ("s1", "s2", "s3", "s4")


def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``conv, pos, role, text``: turns with their place (from 1) in their conversation."""
    d = conversations.select(
        F.col(id_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.col("conv").isNotNull())
    return running_sum(d, F.lit(1), ["turn", "role", "text"], ["conv"], name="pos").drop("turn")


def _n_words(text: Column) -> Column:
    """Number of words: places where one begins."""
    return F.size(F.split(F.concat(F.lit(" "), text), f"[{BLANKS}]+(?=[^{BLANKS}])", -1)).cast("bigint") - 1


def _digest(depth: Column, lanes: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(seed), depth, *lanes) for seed in (1, 2)]


def _hashed(turns: DataFrame) -> DataFrame:
    """Turns as two hashes of their depth, role and text, and their number of words."""
    return turns.select("conv", F.col("depth").cast("bigint").alias("depth"), F.xxhash64(F.lit(1), "depth", "role", "text").alias("x"),
                        F.xxhash64(F.lit(2), "depth", "role", "text").alias("y"), _n_words(F.col("text")).alias("words"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """One row per conversation and depth: digests of the prefix and its parent, words of the last turn and ahead."""
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    lanes = [low("x"), high("x"), low("y"), high("y")]
    rows = rows.select("conv", "depth", "words", *[F.when(F.col("depth") > 0, v).otherwise(0).alias(f"t{c}")
                                                   for c, v in zip(_LANES, lanes)])
    per = landed(rows.groupBy("conv").agg(F.max("depth").alias("last"), F.sum("words").alias("total")), "trie_lengths")
    sums = running_sum(rows, {c: f"t{c}" for c in _LANES} | {"upto": "words"}, ["depth"], ["conv"])
    own, above = [F.col(c) for c in _LANES], [F.col(c) - F.col(f"t{c}") for c in _LANES]
    out = sums.select(
        "conv", "depth", "words", (F.col("upto") - F.col("words")).alias("before"),
        *[c.alias(n) for n, c in zip(("k1", "k2"), _digest(F.col("depth"), own))],
        *[F.when(F.col("depth") > 0, c).alias(n) for n, c in zip(("p1", "p2"), _digest(F.col("depth") - 1, above))])
    out = _with_conversation(out, per, F.col("last"))
    return out.select("conv", "depth", "k1", "k2", "p1", "p2", "last", (F.col("total") - F.col("before")).alias("ahead"))


def _with_conversation(rows: DataFrame, per: DataFrame, last: Column) -> DataFrame:
    """``rows`` with the columns of ``per`` (one row per conversation): one join key for every few thousand depths."""
    per = per.select("*", F.explode(F.sequence(F.lit(0), F.floor(last / _DEPTHS))).alias("_span"))
    return rows.withColumn("_span", F.floor(F.col("depth") / _DEPTHS)).join(per, ["conv", "_span"], "left").drop("_span")


def _screened(prefixes: DataFrame, n: int) -> DataFrame:
    """``prefixes`` with ``maybe`` (it may be shared) and ``first`` (no shorter lone prefix of its conversation is near)."""
    sketch = prefixes.sparkSession.sparkContext.broadcast(company(prefixes.select("k1", "k2"), width_for(n), ROWS))

    def work(batches):
        for batch in batches:
            conv, depth, k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            maybe = may_recur(sketch.value, k1, k2)
            lone = np.flatnonzero(~maybe)
            lone = lone[np.lexsort((depth[lone], conv[lone]))]
            first = np.zeros(len(conv), bool)
            first[lone[np.flatnonzero(np.diff(conv[lone], prepend=conv[lone[:1]] - 1))]] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe), pa.array(first)],
                                             [*batch.schema.names, "maybe", "first"])
    return prefixes.mapInArrow(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
                               + ", maybe boolean, first boolean")


def _ends(shared: DataFrame) -> DataFrame:
    """``k1, k2, ends``: SHA-256 over the ids of the conversations that end at a node, in order.

    The ids are sorted by node and id in range blocks, so a node where very many
    end is spread over blocks; each block joins its ids, and only the joined
    pieces meet, one after the other, in a running hash.
    """
    def pieces(batches):
        for batch in batches:
            d = batch.to_pandas().groupby(["k1", "k2"], sort=False)["conv"]
            d = d.agg(["first", lambda x: ",".join(map(str, x))]).reset_index()
            d.columns = ["k1", "k2", "conv", "piece"]
            yield pa.RecordBatch.from_pandas(d, preserve_index=False)

    def hashes(batches):
        node, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for k1, k2, piece in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "piece"))):
                if (k1, k2) == node:
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256()
                state.update(piece.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends"), x)) for x in done])
        if node:
            yield pa.RecordBatch.from_pylist([{"k1": node[0], "k2": node[1], "ends": state.hexdigest()}])

    ends = shared.where("depth = last").select("k1", "k2", "conv")
    ranged = ends.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    parts = landed(ranged.mapInArrow(pieces, "k1 long, k2 long, conv long, piece string"), "trie_ends")
    return (parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv")
            .mapInArrow(hashes, "k1 long, k2 long, ends string"))


def nodes(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node.

    ``turns``: ``conv, depth (1, 2, ... without gaps), role, text``.  ``conversations``
    (``conv``) may name conversations without turns.  A node is named by its
    smallest member and its depth.
    """
    hashed = landed(_hashed(turns), "trie_turns")      # read often from here on; texts are left behind
    ids = hashed.select("conv")
    ids = (ids if conversations is None else ids.union(conversations.select("conv"))).distinct()
    root = ids.select("conv", *[F.lit(0).cast("bigint").alias(c) for c in ("depth", "x", "y", "words")])
    prefixes = landed(_prefixes(hashed.union(root)), "trie_prefixes")
    screened = _screened(prefixes, prefixes.count())
    shared = landed(screened.where("maybe").drop("maybe", "first"), "trie_shared")
    lone = screened.where("NOT maybe")

    me = F.struct("p1", "p2", "ahead", "last")
    groups = landed(shared.groupBy("k1", "k2").agg(
        F.min("conv").alias("rep"), F.count("*").alias("n"), F.first("depth").alias("depth"),
        F.min_by(me, "conv").alias("me"), (F.max("last") == F.first("depth")).alias("leaf")), "trie_groups")
    # where each conversation starts to be its nodes' smallest member, and whether its end is a leaf of its own
    own = groups.select(F.col("rep").alias("conv"), "depth", "leaf", "me").union(
        lone.where("first").select("conv", "depth", F.lit(True), me)).groupBy("conv").agg(
        F.min("depth").alias("own"), F.max("leaf").alias("leaf"), F.min_by("me", "depth").alias("me"))
    own = landed(own.select("conv", "own", "leaf", F.col("me.p1").alias("k1"), F.col("me.p2").alias("k2"),
                            F.col("me.ahead").alias("own_ahead"), F.col("me.last").alias("own_last")), "trie_own")
    total = shared.count()
    up = groups.select("k1", "k2", F.col("rep").alias("up"), (F.col("n") * HOT > total).alias("hot"))
    hot = F.broadcast(up.where("hot").select("k1", "k2", "up"))        # fewer than HOT rows
    met = own.join(hot, ["k1", "k2"], "left")
    rest = met.where("up IS NULL").drop("up").join(up.where("NOT hot").select("k1", "k2", "up"), ["k1", "k2"], "left")
    own = landed(met.where("up IS NOT NULL").unionByName(rest).drop("k1", "k2"), "trie_parents")

    parent = F.when(F.col("depth") > F.col("own"), F.col("conv")).otherwise(F.col("up"))
    members = _with_conversation(shared, own, F.col("own_last"))
    mine = F.coalesce(F.when(F.col("own") > F.col("depth"), F.col("own_ahead")).when(F.col("own").isNotNull(), F.col("ahead")),
                      F.lit(0))
    child = F.coalesce(F.col("depth") + 1 >= F.col("own"), F.lit(False)) & (F.col("depth") < F.col("last"))
    inner = members.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.min_by(parent, "conv").alias("parent_conv_id"),
        F.count("*").alias("n_convs"), F.count_if(child).alias("n_children"),
        F.count_if(F.coalesce("leaf", F.lit(False))).alias("n_leaves"), F.sum(F.col("ahead") - mine).alias("saved_tokens"))
    inner = inner.join(_ends(shared), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))

    ends = F.when(F.col("depth") == F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(NO_ENDS)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def tail(rows: DataFrame, parent: Column) -> DataFrame:
        return rows.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), one.alias("n_convs"),
                           (F.col("depth") < F.col("last")).cast("bigint").alias("n_children"), one.alias("n_leaves"),
                           none.alias("saved_tokens"), ends.alias("ends_sha256"))
    # behind a lone prefix the parent is the conversation's own node; only first ones may hang on another's
    firsts = lone.where("first").join(own.select("conv", "own", "up"), "conv")
    tails = tail(lone.where("NOT first"), F.col("conv")).union(tail(firsts, parent))
    return inner.select(tails.columns).union(tails)
