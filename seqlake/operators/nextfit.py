"""Next-fit by successor pointers: the one place that knows the packing rule.

With prefix sums over the lengths, the item that starts the next chunk after one
that starts at ``i`` is the first that no longer fits, ``succ(i)``, found by binary
search for all items at once.  Chunk starts are what following ``succ`` reaches;
doubling the pointers gives them, their number and the last one in a logarithmic
number of array steps.  The only state carried from item to item is the fill of
the open chunk, so a stretch of items is a table from entry fill to exit fill, and
tables of neighbouring stretches compose.

Lengths must be within ``1..chunk_len``.
"""

from __future__ import annotations

import numpy as np


def successors(lens: np.ndarray, chunk_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums (one more than items) and ``succ`` (``n``, the end, is its own successor)."""
    total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    succ = np.searchsorted(total, total[:-1] + chunk_len, "right") - 1
    return total, np.append(succ, len(lens))


def _first_start(total: np.ndarray, fill, chunk_len: int):
    """First item that does not fit behind ``fill`` tokens; an empty chunk starts with the first item."""
    return np.where(np.asarray(fill) == 0, 0, np.searchsorted(total, chunk_len - np.asarray(fill), "right") - 1)


def fit_table(lens: np.ndarray, chunk_len: int) -> np.ndarray:
    """``3 x (chunk_len + 1)``: for every entry fill the exit fill, the chunks closed and the items since the last close
    (all items, where none closed)."""
    n = len(lens)
    fill = np.arange(chunk_len + 1, dtype=np.int64)
    if not n:
        return np.stack([fill, np.zeros_like(fill), np.zeros_like(fill)])
    total, succ = successors(lens, chunk_len)
    starts = np.append(np.ones(n, np.int64), 0)            # starts met so far from each item
    last = np.where(succ == n, np.arange(n + 1), succ)      # runs into the last start
    jump = succ
    while (jump != n).any():
        starts = starts + starts[jump]
        jump, last = jump[jump], last[last]
    first = _first_start(total, fill, chunk_len)
    last = last[first]
    closed = starts[first] - (fill == 0)
    none = first == n
    return np.stack([np.where(none, fill + total[n], total[n] - total[last]), np.where(none, 0, closed),
                     np.where(none, n, n - last)])


def compose(table: np.ndarray, after: np.ndarray, n_after: int) -> np.ndarray:
    """The table of two neighbouring stretches, the second of ``n_after`` items."""
    exit_, closed, tail = table
    e, c, t = after[:, exit_]
    return np.stack([e, closed + c, np.where(c > 0, t, tail + n_after)])


def fit(lens: np.ndarray, chunk_len: int, fill: int = 0, items: int = 0, chunk: int = 0):
    """Chunk and place of every item, and the state behind them, for an open chunk of ``items`` items and ``fill`` tokens."""
    n = len(lens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), (fill, items, chunk)
    total, jump = successors(lens, chunk_len)
    reach = np.array([_first_start(total, fill, chunk_len)], np.int64)
    while reach[-1] != n:                                   # twice as many starts each time
        reach, jump = np.unique(np.concatenate([reach, jump[reach]])), jump[jump]
    starts = reach[:-1]
    begins = np.zeros(n, np.int64)
    begins[starts] = 1
    ids = chunk + np.cumsum(begins) - (fill == 0)
    at = np.arange(n)
    since = np.maximum.accumulate(np.where(begins == 1, at, -1))
    pos = np.where(since < 0, items + at, at - since).astype(np.int32)
    end = (int(total[n] - total[starts[-1]]), int(n - starts[-1])) if len(starts) else (int(fill + total[n]), items + n)
    return ids, pos, (*end, int(ids[-1]))
