"""Count-min screening: which keys of a table can have company at all.

Every task counts its keys in a few rows of saturating counters (0, 1, "2 or
more") and emits its sketch in compressed blocks; blocks with one number are
merged wherever they meet, in any order.  Of the merged counters only "2 or more"
is kept, one bit each, so the sketch that goes back to the tasks has a size known
beforehand, ``rows * width / 8`` bytes.  A key whose estimate, the least of its
counters, is one occurs once for certain; others may or may not occur again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counter rows, and the bounds of the counters in each: 4 rows of 2^24 make 8 MB of bits.
ROWS = 4
MIN_BITS, MAX_BITS = 16, 24
_BLOCK = 1 << 15


def width_for(n_keys: int, max_bits: int = MAX_BITS) -> int:
    """Counters a row for so many keys: four each, a power of two within the bounds."""
    return 1 << min(max_bits, max(MIN_BITS, (4 * max(n_keys, 1) - 1).bit_length()))


def slots(k1: np.ndarray, k2: np.ndarray, width: int, rows: int = ROWS) -> list[np.ndarray]:
    """Counter of each key in each row, by double hashing of two 64-bit digests."""
    a, b = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
    return [((a + np.uint64(r) * b) & np.uint64(width - 1)).astype(np.int64) for r in range(rows)]


def _two_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)


def company(keys: DataFrame, width: int, rows: int = ROWS, digests=_two_columns) -> np.ndarray:
    """``rows x width / 8`` bytes of bits: counters that more than one key of ``keys`` met.

    ``digests`` gives the two 64-bit digests of the keys of a batch; unless told otherwise they are its two columns.
    """
    def count(batches):
        counters = np.zeros((rows, width), np.uint8)
        for batch in batches:
            k1, k2 = digests(batch)
            for r, at in enumerate(slots(k1, k2, width, rows)):
                own, n = np.unique(at, return_counts=True)
                counters[r, own] = np.minimum(counters[r, own] + np.minimum(n, 2), 2)
        flat = counters.reshape(-1, _BLOCK)
        used = np.flatnonzero(flat.any(axis=1))
        for i in range(0, len(used), 256):
            part = used[i:i + 256]
            data = [zlib.compress(np.packbits(flat[j] >= 1).tobytes() + np.packbits(flat[j] == 2).tobytes(), 1) for j in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    def merge(batches):
        once: dict[int, np.ndarray] = {}   # no more blocks than the sketch has
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for j, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one, two = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, -1)
                if j in once:
                    twice[j] = twice[j] | two | (once[j] & one)
                    once[j] = once[j] | one
                else:
                    once[j], twice[j] = one, two
        for j, bits in twice.items():
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)])],
                                                 ["block", "data"])

    parts = keys.mapInArrow(count, "block int, data binary").repartition("block")
    out = np.zeros((rows * width // _BLOCK, _BLOCK // 8), np.uint8)
    for j, data in parts.mapInArrow(merge, "block int, data binary").collect():   # bounded by the sketch itself
        out[j] = np.frombuffer(zlib.decompress(bytes(data)), np.uint8)
    return out.reshape(rows, width // 8)


def may_recur(sketch: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Whether the estimate of each key is two or more; where it is not, the key occurs once for certain."""
    rows, width = sketch.shape[0], sketch.shape[1] * 8
    out = np.ones(len(k1), bool)
    for r, at in enumerate(slots(k1, k2, width, rows)):
        out &= (sketch[r][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
