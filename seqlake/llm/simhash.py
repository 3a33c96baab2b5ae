"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint's eight bytes are eight positional tokens.  Two fingerprints that
differ in at most ``d`` bits differ in at most ``d`` bytes, so they share at
least ``8 - d`` positional bytes: that is the guaranteed minimum.  The index
holds one list per combination of ``8 - d`` positions and their bytes, which are
just the sets of fingerprints whose shared positional bytes reach the minimum.

Equal texts are one fingerprint from the first step on, so copies are never
paired.  Inside the lists no group is expanded into all its pairs either:

1. each fingerprint of a list is paired with the list's smallest one, the shared
   positional bytes are tallied, and the bit distance is verified;
2. the links found so far are contracted to components; only lists that still
   hold more than one component go on, and there only pairs across components
   are tallied and verified (in NumPy, blockwise, the largest component of a hot
   list salted over blocks).

No link between two components is lost: any linked pair shares a list, and is
either in one component after step 1 or compared in step 2.

Defined results: a NULL, empty or blank text has fingerprint zero and links
like any other; a NULL id never becomes a component id unless its component has
no other; repeated rows each get a row; an empty table gives an empty result;
other columns are neither read nor returned (``keep_one`` returns them all).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import bit_filter, landed, small_batches
from seqlake.llm.components import components

SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42          # fixed value: the seed of the shingle hash
BLOCK = 4096       # members of the largest component per block of a hot list
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one text (unsigned)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-shingle]]]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[lo:lo + _HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_cols: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id_cols, fp)``, the fingerprint as a signed long."""
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in id_cols] + [T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            n = b.num_columns - 1
            fps = np.array([fingerprint(t, shingle) for t in b.column(n).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(fps.view(np.int64))], names=schema.names)

    return df.select(*id_cols, text_col).mapInArrow(run, schema)


def _byte(fp, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def shared_bytes(a, b) -> Column:
    """Positional bytes that two fingerprints share."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return sum((F.when(_byte(x, p) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _lists(fps: DataFrame, min_shared: int) -> DataFrame:
    """``(key, fp)``: a row for each index list that holds the fingerprint."""
    d = fps.select("fp", *[_byte(F.col("fp"), p).alias(f"b{p}") for p in range(8)])
    keys = []
    for n, chosen in enumerate(combinations(range(8), min_shared)):
        key = F.lit(n).cast("bigint")
        if min_shared > 6:   # the bytes no longer fit beside the number: hash them
            key = F.xxhash64(key, *[F.col(f"b{p}") for p in chosen])
        else:
            for p in chosen:
                key = key * 256 + F.col(f"b{p}")
        keys.append(key)
    return d.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _linked(a: str, b: str, max_distance: int) -> Column:
    return ((shared_bytes(a, b) >= 8 - max_distance)
            & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_distance))


def _across(rows: np.ndarray, comps: np.ndarray, others: np.ndarray, first: bool, d: int):
    """Links between components in one block: others against all, in slices."""
    out = []
    big = np.flatnonzero(~others)
    small = np.flatnonzero(others)
    targets = np.concatenate([big, small]) if first else big
    if not len(small) or not len(targets):
        return out
    t_fp, t_comp = rows[targets], comps[targets]
    step = max(1, (1 << 20) // len(targets))
    for lo in range(0, len(small), step):
        s = small[lo:lo + step]
        x = rows[s][:, None] ^ t_fp[None, :]
        ok = (np.bitwise_count(x) <= d) & (comps[s][:, None] != t_comp[None, :])
        i, j = np.nonzero(ok)
        if len(i):
            # x's zero bytes are the shared positions
            tally = 8 - (x[i, j].view(np.uint8).reshape(-1, 8) != 0).sum(axis=1)
            hit = tally >= 8 - d
            out.append(np.unique(np.stack([comps[s][i[hit]], t_comp[j[hit]]], axis=1), axis=0))
    return out


def _across_links(cells: DataFrame, d: int) -> DataFrame:
    """Component links ``(u, v)`` of the cells ``(key, block, fp, comp, other)``, one cell at a time."""
    def run(batches):
        held = None

        def solve(t):
            key, block = t["key"], t["block"]
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            bounds = [0, *cut.tolist(), len(key)]
            found = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                found += _across(t["fp"][a:b].view(np.uint64), t["comp"][a:b], t["other"][a:b], block[a] == 0, d)
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for b in batches:
            t = {n: np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i, n in enumerate(b.schema.names)}
            if not b.num_rows:
                continue
            if held is not None:
                t = {k: np.concatenate([held[k], t[k]]) for k in t}
            # the last cell may go on in the next batch
            tail = np.flatnonzero((t["key"] != t["key"][-1]) | (t["block"] != t["block"][-1]))
            cut = int(tail[-1]) + 1 if len(tail) else 0
            held = {k: v[cut:] for k, v in t.items()}
            if cut:
                yield solve({k: v[:cut] for k, v in t.items()})
        if held is not None:
            yield solve(held)

    return (cells.repartition("key", "block").sortWithinPartitions("key", "block")
            .mapInArrow(run, "u long, v long"))


def link_components(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint: ``root`` is equal within a component."""
    if not 0 <= max_distance <= 7:
        raise ValueError("max_distance must be 0 to 7")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = landed(fps.select("fp").distinct(), "fps", compact=True)
    # a small scan, but each row becomes 70 keys: dealt over all tasks first
    lists = _lists(fps.repartition(tasks, "fp"), 8 - max_distance)
    hubs = landed(lists.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("hub"))
                  .where("n > 1"), "hubs", compact=True)
    # most lists hold one fingerprint: their keys end at the filter, before the shuffle
    members = landed(bit_filter(hubs, "key")(lists).join(hubs, "key"), "members", compact=True)
    near = members.where((F.col("fp") != F.col("hub")) & _linked("fp", "hub", max_distance))
    first = components(near.select(F.col("fp").alias("u"), F.col("hub").alias("v")))

    named = members.where("n > 2").join(first.select(F.col("u").alias("fp"), "v"), "fp", "left").select(
        "key", "n", "fp", F.coalesce("v", "fp").alias("comp"))
    named = landed(named, "named")
    per = named.groupBy("key", "n", "comp").agg(F.count("*").alias("c"))
    mixed = (per.groupBy("key", "n").agg(F.count("*").alias("k"), F.max_by("comp", F.struct("c", "comp")).alias("big"))
             .where("k > 1").select("key", "big", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    cells = named.drop("n").join(landed(mixed, "mixed"), "key").withColumn("other", F.col("comp") != F.col("big"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = cells.withColumn("block", F.explode(F.when(
        F.col("other"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    more = _across_links(cells.select("key", "block", "fp", "comp", "other"), max_distance)
    second = components(more)
    return (fps.join(first.select(F.col("u").alias("fp"), F.col("v").alias("a")), "fp", "left")
            .withColumn("a", F.coalesce("a", "fp"))
            .join(second.select(F.col("u").alias("a"), F.col("v").alias("b")), "a", "left")
            .select("fp", F.coalesce("b", "a").alias("root")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable)."""
    marked = landed(fingerprints(df, [id_col], text_col, shingle), "marked")
    roots = landed(link_components(marked, max_distance), "roots")
    lowest = marked.groupBy("fp").agg(F.min(id_col).alias("low")).join(roots, "fp")
    ids = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = landed(roots.join(ids, "root").select("fp", "component_id"), "by_fp")
    return marked.join(by_fp, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``df``, one of each component: the smallest id (NULL last), then the smallest row hash.

    Rows equal in every column are one document and leave one row.
    """
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    tagged = df.withColumn("_row", row).withColumn("_row2", F.xxhash64(F.lit(1), "_row", F.col(text_col)))
    marked = landed(fingerprints(tagged, [id_col, "_row", "_row2"], text_col, shingle), "marked")
    roots = landed(link_components(marked, max_distance), "roots")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_row"), F.col("_row2"))
    kept = (marked.groupBy("fp").agg(F.min(order).alias("o")).join(roots, "fp")
            .groupBy("root").agg(F.min("o").alias("o")).select("o._row", "o._row2"))
    times = landed(marked.join(kept, ["_row", "_row2"]).groupBy("_row", "_row2").agg(F.count("*").alias("_n")), "kept")
    out = tagged.join(times, ["_row", "_row2"])
    once = out.where("_n = 1").select(*df.columns)
    # rows that occur several times, equal in every column
    return once.unionByName(out.where("_n > 1").dropDuplicates(["_row", "_row2"]).select(*df.columns))
