"""Exact substring dedup over a sparse suffix array.

Bytes are removed that a string of ``length`` bytes covers which also starts
earlier in the corpus.

1. **Suffixes.**  Of the ``GRAM``-byte grams in a window of ``length`` bytes the
   one with the smallest hash (the first of equal ones) is the window's anchor.
   Equal windows have their anchors at one place, so it is enough to sort the
   suffixes that start at anchors, about one byte in 35.  A suffix stands for all
   consecutive windows with its anchor: its *context* is their bytes.
2. **Screening.**  A gram that occurs once cannot start an equal suffix.  Grams
   are counted exactly; those that occur again set bits in a map whose size has a
   bound (``MAX_FILTER_BITS``), and suffixes outside it stay where they are.  A
   map that fills up only lets more suffixes pass.
3. **Buckets.**  Sampled splitters range-partition the suffixes by their leading
   bytes, ties by document and place, so that very many equal suffixes spread
   over buckets.  Each bucket is sorted by multikey quicksort, eight bytes a
   level, equal parts going on to the next level.  Of neighbours with equal
   contexts all but the earliest are repeats, whole contexts at once; different
   contexts that share their gram are compared window by window.
4. **Boundaries.**  The groups at either end of a bucket may go on next door.
   Their windows, each once a bucket, pass a count-min screening (``sketch``); the
   digests of those that may recur are range-partitioned and sorted in the same way,
   and each bucket learns the last digest of the bucket before it, one row a
   bucket, so that a repeat is seen across the boundary.
5. The windows found are joined to their documents and cut out.

Equal texts in one batch are settled before anything is shuffled.  Digests have
128 bits.  Nothing is sampled but the splitters, whatever their choice the result
is the same.

Defined results: a NULL text is empty; NULL ids come first; documents that share
an id are ordered by a hash of their text, and repeated rows in any order, each
with its own row out; other columns are not read; an empty table gives no rows;
texts may be of any length, long ones are cut into overlapping pieces for steps
1 to 3 (windows are not affected).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import landed, small_batches
from seqlake.llm.sketch import company, may_recur, width_for
from seqlake.operators.ordered import dense_index

#: Bytes of a string that counts as repeated, and of the grams that place its anchor.
LENGTH = 100
GRAM = 32
#: Bits a repeated gram gets in the screening map, and the bounds of the map: 128 MB at most.
BITS_PER_GRAM = 8
MIN_FILTER_BITS, MAX_FILTER_BITS = 20, 30
#: Window starts that are worked on in one array step.
PIECE = 1 << 18

_PLACE = np.uint64((1 << 24) - 1)      # a step's places must fit in here
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) | np.uint64(1)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes from each place (a power of two), by doubling."""
    h = _BYTE[data]
    b = 1
    while b < gram:
        h = _mixed_pair(h[:-b], h[b:])
        b *= 2
    h ^= h >> np.uint64(32)
    return h


def _mixed_pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x * _A + y
    h ^= h >> np.uint64(29)
    h *= _B
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` neighbours from each place, by doubling."""
    b = 1
    while 2 * b <= width:
        keys = np.minimum(keys[:-b], keys[b:])
        b *= 2
    return np.minimum(keys[:len(keys) - (width - b)], keys[width - b:]) if width > b else keys


def anchored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Contexts of a step's documents: gram hash, first window, last window, anchor (places in ``data``)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = _grams(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    anchor = (_least((h & ~_PLACE) | place, length - gram + 1) & _PLACE).astype(np.int64)
    # windows that reach into the next document are none
    inside = np.zeros(len(data) + 1, np.int32)
    fit = ends - starts >= length
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, ends[fit] - length + 1, -1)
    inside = np.cumsum(inside[:len(anchor)]) > 0
    new = np.empty(len(anchor), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    # neighbouring documents: the last window of one is never followed by a window of the next
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    first, last = first[inside[first]], last[inside[first]]
    return h[anchor[first]], first, last, anchor[first]


def _steps(bodies, length: int):
    """Documents of a batch as ``data, starts, ends, row, shift``: rows and the place in their text where a part starts."""
    data, starts, rows, shifts, size = [], [], [], [], 0
    for row, body in enumerate(bodies):
        n = len(body)
        for cut in range(0, max(n - length + 1, 0), PIECE):
            part = body[cut:cut + PIECE + length - 1]
            if size and size + len(part) > PIECE + length:
                yield b"".join(data), starts, rows, shifts
                data, starts, rows, shifts, size = [], [], [], [], 0
            data.append(part)
            starts.append(size)
            rows.append(row)
            shifts.append(cut)
            size += len(part)
    if data:
        yield b"".join(data), starts, rows, shifts


def _contexts(batch, length: int, gram: int):
    """Per step of a batch (``ord``, body): bytes, gram hash, first and last window, anchor, row, shift."""
    bodies = batch.column(1).to_pylist()
    for raw, starts, rows, shifts in _steps(bodies, length):
        data = np.frombuffer(raw, np.uint8)
        starts = np.array(starts, np.int64)
        ends = np.append(starts[1:], len(data))
        key, lo, hi, at = anchored(data, starts, ends, length, gram)
        part = np.searchsorted(starts, lo, "right") - 1
        yield raw, key, lo, hi, at, np.array(rows)[part], np.array(shifts)[part] - starts[part]


def _filter(docs: DataFrame, length: int, gram: int) -> tuple[np.ndarray, int]:
    """Bit map of the grams that start more than one suffix, and its number of bits."""
    def count(batches):
        for batch in batches:
            keys = [c[1] for c in _contexts(batch, length, gram)]
            if keys:
                own, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["k", "n"])

    grams = docs.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").select("k")
    grams = landed(grams, "suffix_grams", compact=True)
    need = BITS_PER_GRAM * max(grams.count(), 1)
    bits = 1 << min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, (need - 1).bit_length()))
    slot = F.col("k").bitwiseAND(F.lit(bits - 1).cast("bigint"))
    maps = grams.groupBy(F.bitmap_bucket_number(slot + 1).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for b, m in maps.collect():      # the map itself, of known size
        out[(b - 1) * len(m):b * len(m)] = np.frombuffer(bytes(m), np.uint8)
    return out, bits


def _multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of strings given as big-endian words, first word first; equal strings stay in their order.

    Multikey quicksort, all open parts of a level at once: parts of equal leading
    words go on to the next word, parts of one string are done.
    """
    n = len(words[0])
    order = np.argsort(words[0], kind="stable")
    part = np.zeros(n, np.int64)
    for level, w in enumerate(words):
        if level:
            open_ = np.flatnonzero((np.diff(part, prepend=-1) == 0) | (np.diff(part, append=-1) == 0))
            if not len(open_):
                break
            own = order[open_]
            order[open_] = own[np.lexsort((w[own], part[open_]))]
        differs = np.append(True, (np.diff(part) != 0) | (w[order][1:] != w[order][:-1]))
        part = np.cumsum(differs)
    return order


def _sorted_bucket(batches, length: int, gram: int):
    """Repeats and windows to compare of one bucket of suffixes (see step 3 and 4)."""
    table = pa.Table.from_batches(batches)
    n = table.num_rows
    left, right = (table.column(c).to_pylist() for c in ("tail", "head"))
    ords, start = (table.column(c).to_numpy() for c in ("ord", "start"))
    # the suffix from its anchor, at most ``length`` bytes, then what stands before it, then their lengths
    width = -(-(2 * length - gram + 4) // 8) * 8
    text = b"".join((r.ljust(length, b"\0") + b.ljust(length - gram, b"\0") + len(r).to_bytes(2) + len(b).to_bytes(2)).ljust(
        width, b"\0") for r, b in zip(right, left))
    words = np.frombuffer(text, ">u8").reshape(n, -1)
    placed = np.lexsort((start, ords))
    order = placed[_multikey_order([np.ascontiguousarray(words[placed, j]).astype(np.uint64) for j in range(width // 8)])]
    rows = words[order]
    same = np.append(False, (rows[1:] == rows[:-1]).all(axis=1))
    same_gram = np.append(False, (rows[1:, :gram // 8] == rows[:-1, :gram // 8]).all(axis=1))
    group = np.cumsum(~same_gram) - 1
    kinds = np.bincount(group, weights=~same)              # different contexts with one gram
    edge = (group == 0) | (group == group[-1])
    before = np.fromiter(map(len, left), np.int64, n)
    size = before + np.fromiter(map(len, right), np.int64, n)
    gone = order[same]
    # windows of different contexts are compared in order of their documents and places
    mixed = np.flatnonzero(~same & (edge | (kinds[group] > 1)))
    mixed = mixed[np.lexsort(((start + before)[order[mixed]], ords[order[mixed]]))]
    whole = order[mixed]
    texts = [left[j] + right[j] for j in whole]
    row, at, again = _compared(texts, size[whole], group[mixed], length, gram)
    r, first, last = _stretches(row[again], at[again])
    o, a, b = ords[whole[r]], start[whole[r]] + first, start[whole[r]] + last + length
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([ords[gone], o])), pa.array(np.concatenate([start[gone], a])),
         pa.array(np.concatenate([start[gone] + size[gone], b])), pa.nulls(len(gone) + len(o), pa.binary())],
        ["ord", "a", "b", "bytes"])
    # of the groups at the ends, windows that are new in this bucket go on
    on = ~again & edge[mixed[row]]
    r, first, last = _stretches(row[on], at[on])
    for i in range(0, len(r), 4096):
        j, x, y = r[i:i + 4096], first[i:i + 4096], last[i:i + 4096] + length
        own = whole[j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ords[own]), pa.array(start[own] + x), pa.array(start[own] + y),
             pa.array([texts[k][u:v] for k, u, v in zip(j.tolist(), x.tolist(), y.tolist())], pa.binary())],
            ["ord", "a", "b", "bytes"])


def _digests(texts: list[bytes], length: int, width: int) -> np.ndarray:
    """64-bit hash of the window from each place of each text (of ``width`` bytes at most)."""
    out = [np.zeros((0, width - length + 1), np.uint64)]
    b = 1 << (length.bit_length() - 1)
    for i in range(0, len(texts), 2048):
        part = texts[i:i + 2048]
        data = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in part) + b"\0" * width, np.uint8)
        h = _grams(data, b)
        h = _mixed_pair(h[:len(h) - (length - b)], h[length - b:])
        out.append(h[:len(part) * width].reshape(len(part), width)[:, :width - length + 1])
    return np.concatenate(out)


def _window_places(size: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.arange(width - length + 1) <= (size - length)[:, None])


def _compared(texts: list[bytes], size: np.ndarray, group: np.ndarray, length: int, gram: int):
    """All windows as ``row, place``, and whether an earlier context of the same group has the window, too."""
    width = 2 * length - gram
    row, at = _window_places(size, length, width)
    digest, own = _digests(texts, length, width)[row, at], group[row]
    order = np.lexsort((digest, own))          # stable: the earliest of equal windows comes first
    again = np.zeros(len(row), bool)
    again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    return row, at, again


def _stretches(row: np.ndarray, at: np.ndarray):
    """Row, first and last place of each stretch of neighbouring places."""
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    return row[new], at[new], at[np.append(new[1:], len(row))[:len(new)] - 1]


def _windows(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """``d1, d2, ord, a``: digest and place of the contexts' windows that may occur twice."""
    width = 2 * length - gram
    n = contexts.agg(F.coalesce(F.sum(F.col("b") - F.col("a") - (length - 1)), F.lit(0))).first()[0]

    def digests(batch):
        texts = batch.column(0).to_pylist()
        h = _digests(texts, length, width)[_window_places(np.fromiter(map(len, texts), np.int64, len(texts)), length, width)]
        return h, _mixed_pair(h, h)

    sketch = contexts.sparkSession.sparkContext.broadcast(company(contexts.select("bytes"), width_for(n), digests=digests))

    def work(batches):
        for batch in batches:
            ords, starts, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            row, at = _window_places(np.fromiter(map(len, texts), np.int64, len(texts)), length, width)
            maybe = may_recur(sketch.value, *digests(batch.select(["bytes"])))
            row, at = row[maybe], at[maybe]
            if not len(row):
                continue
            d = b"".join(hashlib.blake2b(texts[r][k:k + length], digest_size=16).digest() for r, k in zip(row.tolist(), at.tolist()))
            d = np.frombuffer(d, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(ords[row]),
                                              pa.array(starts[row] + at)], ["d1", "d2", "ord", "a"])
    return contexts.select("ord", "a", "bytes").mapInArrow(work, "d1 long, d2 long, ord long, a long")


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """``ord, a``: windows with a digest that an earlier window has."""
    keys = ["d1", "d2", "ord", "a"]
    ranged = windows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("bucket", F.spark_partition_id())

    def mark(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            d1, d2 = (batch.column(c).to_numpy() for c in ("d1", "d2"))
            same = np.append(last == (d1[0], d2[0]), (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1]))
            # the first of a bucket is not known yet; it and the last one tell their digests
            edge = np.zeros(len(d1), bool)
            edge[0] = last is None
            keep = same | edge
            last = (d1[-1], d2[-1])
            ends = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket").take(pa.array(ends)), *[batch.column(c).take(pa.array(ends)) for c in keys],
                 pa.array(np.where(edge[ends], "first", "repeat"))], ["bucket", *keys, "kind"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket").slice(batch.num_rows - 1), *[batch.column(c).slice(batch.num_rows - 1) for c in keys],
                 pa.array(["last"])], ["bucket", *keys, "kind"])

    marked = landed(ranged.mapInArrow(mark, "bucket int, d1 long, d2 long, ord long, a long, kind string"), "suffix_windows")
    ends = marked.where("kind <> 'repeat'").groupBy("bucket").agg(
        F.max(F.when(F.col("kind") == "first", F.struct(*keys))).alias("first"),
        F.max(F.when(F.col("kind") == "last", F.struct(*keys))).alias("last")).collect()   # one row per bucket
    ends.sort(key=lambda r: r.bucket)
    across = [(y.first.ord, y.first.a) for x, y in zip(ends, ends[1:]) if (x.last.d1, x.last.d2) == (y.first.d1, y.first.d2)]
    spark = windows.sparkSession
    return marked.where("kind = 'repeat'").select("ord", "a").union(spark.createDataFrame(across, "ord long, a long"))


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, ord, body``: ``ord`` is different for every row and in order of the documents."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    if str(d.schema["id"].dataType) in ("LongType()", "IntegerType()", "ShortType()"):
        n, known, different = d.agg(F.count("*"), F.count("id"), F.count_distinct("id")).first()
        if n == known == different:
            return d.select("id", F.col("id").cast("bigint").alias("ord"), "body")
    d = landed(d.select("id", F.xxhash64("body").alias("tie"), F.monotonically_increasing_id().alias("row"), "body"), "suffix_docs")
    place = dense_index(d.select("id", "tie", "row"), ["id", "tie", "row"], "ord").select("row", "ord")
    return landed(d.join(place, "row").select("id", "ord", "body"), "suffix_docs")


def repeats(placed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``ord, a, b``: byte ranges that strings cover which also start earlier (overlapping, in no order)."""
    spark = placed.sparkSession
    source = placed.select("ord", "body")
    bits, n_bits = _filter(source, length, gram)
    screen = spark.sparkContext.broadcast(bits)
    mask = np.uint64(n_bits - 1)

    def suffixes(batches):
        for batch in batches:
            ords = batch.column(0).to_numpy()
            met: dict[bytes, list] = {}
            out = {"ord": [], "start": [], "tail": [], "head": [], "whole": []}
            for raw, key, lo, hi, at, row, shift in _contexts(batch, length, gram):
                slot = (key & mask).astype(np.int64)
                hit = np.flatnonzero((screen.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                for i, a, e, p, o, s in zip(hit.tolist(), lo[hit].tolist(), (hi[hit] + length).tolist(), at[hit].tolist(),
                                            ords[row[hit]].tolist(), shift[hit].tolist()):
                    text = raw[a:e]
                    me = (o, a + s)
                    # equal contexts of one batch: the earliest goes on, the others are repeats already
                    known = met.get(text)
                    if known is None:
                        met[text] = [me, p - a]
                        continue
                    if me < known[0]:
                        me, known[0] = known[0], me
                    out["ord"].append(me[0])
                    out["start"].append(me[1])
                    out["tail"].append(None)
                    out["head"].append(None)
                    out["whole"].append(len(text))
            for text, ((o, a), p) in met.items():
                out["ord"].append(o)
                out["start"].append(a)
                out["tail"].append(text[:p])
                out["head"].append(text[p:])
                out["whole"].append(len(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["ord"], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["tail"], pa.binary()),
                 pa.array(out["head"], pa.binary()), pa.array(out["whole"], pa.int64())], list(out))

    found = source.mapInArrow(suffixes, "ord long, start long, tail binary, head binary, whole long")
    ranged = found.repartitionByRange("head", "tail", "ord", "start")

    def bucket(batches):
        """Settled repeats pass through, the others are sorted."""
        rest = []
        for b in batches:
            settled = b.column("head").is_null()
            done = b.filter(settled)
            if done.num_rows:
                a = done.column("start")
                yield pa.RecordBatch.from_arrays(
                    [done.column("ord"), a, pa.array(a.to_numpy() + done.column("whole").to_numpy()),
                     pa.nulls(done.num_rows, pa.binary())], ["ord", "a", "b", "bytes"])
            if done.num_rows < b.num_rows:
                rest.append(b.filter(pc.invert(settled)))
        if rest:
            yield from _sorted_bucket(rest, length, gram)

    judged = landed(ranged.mapInArrow(bucket, "ord long, a long, b long, bytes binary"), "suffix_repeats")
    again = _repeated_windows(_windows(judged.where("bytes IS NOT NULL"), length, gram))
    return judged.where("bytes IS NULL").select("ord", "a", "b").union(
        again.select("ord", "a", (F.col("a") + length).alias("b")))


def cut_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH,
                gram: int = GRAM) -> DataFrame:
    """``id_col, n_bytes, spans, kept``: removed byte ranges (``start, end``) of each text, and the bytes that remain."""
    if gram & (gram - 1) or not 8 <= gram <= length:
        raise ValueError("gram must be a power of two between 8 and length")
    small_batches(docs.sparkSession)       # a batch's contexts are Python values
    placed = _placed(docs, id_col, text_col)
    ranges = repeats(placed, length, gram).groupBy("ord").agg(
        F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    joined = placed.join(ranges, "ord", "left").select("id", "body", "a", "b")

    def cut(batches):
        for batch in batches:
            spans, kept, size = [], [], []
            for body, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                size.append(len(body))
                if not a.is_valid:
                    spans.append([])
                    kept.append(body)
                    continue
                a, b = a.values.to_numpy(), b.values.to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                own = list(zip(a[new].tolist(), b[np.append(new[1:] - 1, len(b) - 1)].tolist()))
                edges = [0, *[x for s in own for x in s], len(body)]
                spans.append([{"start": s, "end": e} for s, e in own])
                kept.append(b"".join(body[s:e] for s, e in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])
    kind = placed.schema["id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").select(
        F.col("id").alias(id_col), "n_bytes", "spans", "kept")
