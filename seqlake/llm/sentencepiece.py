"""SentencePiece (BPE with byte fallback) encoding and decoding by suffix-array matching.

Texts are taken in batches of a few megabytes.  A batch's different chunks (a
run of spaces with the word behind it; no piece of the vocabulary reaches from
a word into the next space) are concatenated and indexed by a suffix array as
deep as the longest piece.  Every piece of the vocabulary is binary-searched in
it; the ranges found are all edges ``(start, end, piece)`` of the batch.  Sorted
by end position they are relaxed left to right, all chunks side by side: the
segmentation of a prefix ends in the one piece that its predecessor tolerates,
that is, whose pair the merge rule would leave as it is.  The result equals merging by score, so ids
are the model's own.  Chunks already solved are kept in a bounded cache.

The model file is read on the driver (a parameter) and its bytes travel with
the function; executors need no file.

Defined results: a NULL or empty text has no ids and decodes to an empty text;
characters outside the vocabulary become byte pieces; U+2581 decodes to a space,
as the model defines; repeated rows each get a row; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece as spm
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqlake.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"    # fixed value: the model's mark for a space
#: Characters of text per batch, chunks per suffix array, solved chunks (twice) and pairs kept per Python worker.
BATCH_CHARS = 1_500_000
SOLVED_AT_ONCE = 40_000
CACHED_CHUNKS = 200_000
CACHED_PAIRS = 500_000

_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_START, _NONE = -1, -2
_END = 0x110000   # ends a chunk: no character
_PAIR = 1 << 22   # more than all pieces and characters together


class Pieces:
    """A model's vocabulary, prepared for matching."""

    def __init__(self, model: bytes):
        sp = spm.SentencePieceProcessor(model_proto=model)
        n = self.size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {sp.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if len(self.bytes) != 256 or any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) for i in normal):
            raise ValueError("a byte-fallback vocabulary without pieces across spaces is needed")
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.id = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: sp.get_score(i) for i in normal}
        # only pieces that merging can produce take part in matching
        self.used = [i for i in normal if len(self.text[i]) == 1 or self.merge(self.text[i]) == [self.text[i]]]
        self.depth = max(len(self.text[i]) for i in self.used)
        self.ids = np.array(self.used)
        self.lengths = np.array([len(self.text[i]) for i in self.used])
        self.inside = np.arange(self.depth)[None, :] < self.lengths[:, None]
        self.codes = np.zeros((len(self.used), self.depth), dtype=np.int64)
        for k, i in enumerate(self.used):
            self.codes[k, :len(self.text[i])] = [ord(c) for c in self.text[i]]
        self.singles = self.codes[self.lengths == 1, 0]
        self.solved: dict[str, tuple[int, ...]] = {}      # the newer half of the cache
        self.older: dict[str, tuple[int, ...]] = {}
        self.damaged: set[str] = set()   # chunks that do not decode to themselves
        self.tolerated: dict[int, bool] = {}
        self.pair_keys, self.pair_kept = np.zeros(1, np.int64) - 1, np.zeros(1, bool)   # the same, sorted
        self.one = np.array(range(self.size), dtype=object)   # one object per id, shared by all cached chunks
        self.length = np.array([len(t) for t in self.text])

    def merge(self, text: str) -> list[str]:
        """The merge rule itself: best score first, leftmost of equals (for short strings)."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def string(self, piece: int) -> str:
        return self.text[piece] if piece < self.size else chr(piece - self.size)

    def pair(self, a: int, b: int) -> bool:
        """Whether merging leaves the two pieces side by side as they are."""
        x, y = self.string(a), self.string(b)
        got = (x + y) not in self.id and self.merge(x + y) == [x, y]
        if len(self.tolerated) >= CACHED_PAIRS:
            self.tolerated = {}
            self.pair_keys, self.pair_kept = np.zeros(1, np.int64) - 1, np.zeros(1, bool)
        self.tolerated[a * _PAIR + b] = got
        return got

    def edges(self, codes: np.ndarray):
        """All occurrences of all pieces in ``codes`` (``_END`` ends a chunk): starts, ends, pieces."""
        alphabet, rank = np.unique(codes, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        n_text, base = len(rank), len(alphabet) + 1
        reach, key = 1, rank
        while reach < self.depth:   # keys of the first 2, 4, 8, … characters, as small as their order allows
            if base * base > 1 << 62:
                key = np.unique(key, return_inverse=True)[1] + 1
                base = int(key.max()) + 1
            ahead = np.zeros_like(key)
            ahead[:-reach] = key[reach:]
            key, base, reach = key * base + ahead, base * base, reach * 2
        suffixes = np.argsort(key)
        # pieces as ranks; a piece with a character the batch lacks cannot occur
        place = np.zeros(_END + 1, dtype=np.int64)
        place[alphabet] = np.arange(1, len(alphabet) + 1)
        table = place[self.codes]
        known = np.flatnonzero(((table > 0) | ~self.inside).all(axis=1))
        kind = np.dtype(">u2") if len(alphabet) < 0xFFFF else np.dtype(">u4")
        as_key = f"S{self.depth * kind.itemsize}"
        padded = np.zeros(n_text + self.depth, dtype=kind)
        padded[:n_text] = rank
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[suffixes]
        sorted_text = np.ascontiguousarray(windows).view(as_key).ravel()
        inside = self.inside[known]
        low = np.where(inside, table[known], 0).astype(kind)
        high = np.where(inside, table[known], np.iinfo(kind).max).astype(kind)
        lo = np.searchsorted(sorted_text, low.view(as_key).ravel(), "left")
        hi = np.searchsorted(sorted_text, high.view(as_key).ravel(), "right")
        n = hi - lo
        starts = suffixes[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        ends = starts + np.repeat(self.lengths[known], n)
        found = np.repeat(self.ids[known], n)
        # characters without a piece of their own are edges too
        odd = np.flatnonzero(~np.isin(alphabet, self.singles)[rank - 1] & (codes != _END))
        starts = np.concatenate([starts, odd])
        ends = np.concatenate([ends, odd + 1])
        found = np.concatenate([found, codes[odd].astype(np.int64) + self.size])
        return starts, ends, found

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """``pair`` for many keys at once: those seen before by binary search, new ones by the merge rule."""
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        out = self.pair_kept[at]
        new = np.flatnonzero(self.pair_keys[at] != keys)
        if len(new):
            different, back = np.unique(keys[new], return_inverse=True)
            got = [self.tolerated[k] if k in self.tolerated else self.pair(*divmod(k, _PAIR)) for k in different.tolist()]
            out[new] = np.array(got, dtype=bool)[back]
        return out

    def _settle(self) -> None:
        """Sort the pairs met since the last time in with the others."""
        if len(self.tolerated) > 1.1 * len(self.pair_keys):
            keys = np.fromiter(self.tolerated, np.int64, len(self.tolerated))
            order = np.argsort(keys)
            self.pair_keys = keys[order]
            self.pair_kept = np.fromiter(self.tolerated.values(), bool, len(keys))[order]

    def solve(self, chunks: list[str]) -> None:
        """Segment chunks that are not in the cache yet, all side by side."""
        codes = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
        lengths = np.array([len(c) for c in chunks])
        stops = np.cumsum(lengths + 1) - 1
        begins = stops - lengths
        codes[stops] = _END
        starts, ends, found = self.edges(codes)
        # edges by their end's place in the chunk: one step relaxes that place in every chunk
        place = ends - np.repeat(begins, lengths + 1)[starts]
        order = np.argsort(place.astype(np.uint16) if lengths.max() < 1 << 16 else place, kind="stable")
        starts, ends, found, place = starts[order], ends[order], found[order], place[order]
        cuts = np.searchsorted(place, np.arange(1, int(lengths.max()) + 2))
        last = np.full(len(codes) + 1, _NONE, dtype=np.int64)
        last[begins] = _START
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            before, piece, to = last[starts[lo:hi]], found[lo:hi], ends[lo:hi]
            ok = before == _START
            asks = np.flatnonzero(before >= 0)
            ok[asks] = self.pairs(before[asks] * _PAIR + piece[asks])
            last[to[ok]] = piece[ok]
        self._settle()
        if (last[stops] == _NONE).any():
            raise ValueError("a vocabulary whose merges do not nest: segmentation by pairs is not defined")
        # walk back from every chunk's end at once
        who, at, steps = np.arange(len(chunks)), stops.copy(), []
        while len(who):
            piece = last[at]
            steps.append((who, piece))
            at = at - np.where(piece < self.size, self.length[np.minimum(piece, self.size - 1)], 1)
            going = at > begins[who]
            who, at = who[going], at[going]
        owner = np.concatenate([w for w, _ in reversed(steps)])
        piece = np.concatenate([p for _, p in reversed(steps)])
        order = np.argsort(owner, kind="stable")
        piece = piece[order]
        odd = set(owner[order][piece >= self.size].tolist())
        bounds = np.cumsum(np.bincount(owner, minlength=len(chunks))).tolist()
        flat = self.one[np.minimum(piece, self.size - 1)].tolist()
        text, lo = self.text, 0
        for k, (c, hi) in enumerate(zip(chunks, bounds)):
            if k in odd:
                ids = []
                for i in piece[lo:hi].tolist():
                    ids += [i] if i < self.size else [self.byte_id[b] for b in chr(i - self.size).encode("utf-8", "surrogatepass")]
                same = self._joined(ids) == c
            else:
                ids = flat[lo:hi]
                same = "".join([text[i] for i in ids]) == c
            self.solved[c] = tuple(ids)
            if not same:
                self.damaged.add(c)
            lo = hi

    def encode(self, texts: Iterable[str | None], verify: bool = False):
        """Ids of each text; with ``verify`` also whether each one's ids decode to it."""
        texts = list(texts)
        split = []
        for t in texts:
            split.append(_CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [])
        if len(self.solved) > CACHED_CHUNKS:
            self.older, self.solved = self.solved, {}
        new = []
        for c in dict.fromkeys(chain.from_iterable(split)):
            if c not in self.solved:
                if c in self.older:
                    self.solved[c] = self.older[c]
                else:
                    new.append(c)
        for lo in range(0, len(new), SOLVED_AT_ONCE):
            self.solve(new[lo:lo + SOLVED_AT_ONCE])
        solved = self.solved
        rows = [list(chain.from_iterable([solved[c] for c in chunks])) for chunks in split]
        if not verify:
            return rows
        # a blank and a space sign have the same ids, which decode to the blank
        return rows, [self.damaged.isdisjoint(chunks) and SPACE not in (t or "") for t, chunks in zip(texts, split)]

    def _joined(self, ids: Iterable[int]) -> str:
        """The pieces of ids put together, with runs of byte pieces decoded."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.special:
                out.append(self.text[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: Iterable[int] | None) -> str:
        text = self._joined(ids if ids is not None else ()).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


_LOADED: dict[bytes, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The prepared vocabulary, built once per Python worker."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """``id, n_tokens, ids, round_trip``: one row per input row.

    ``round_trip`` tells whether decoding the ids gives the text back.  Chunks decode on
    their own (a chunk ends on a whole character), so each different chunk is decoded once; a text with U+2581 itself never comes back.
    """
    small_batches(df.sparkSession)
    model = model or read_model()
    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        vocabulary = pieces(model)

        def flush(keys, texts):
            rows, same = vocabulary.encode(texts, verify=True)
            flat = pa.array(np.fromiter(chain.from_iterable(rows), np.int32, sum(map(len, rows))))
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys), pa.array(np.diff(offsets).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(same, pa.bool_())], names=schema.names)

        keys, texts, chars = [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                keys.append(part.column(0))
                texts += part.column(1).to_pylist()
                chars += sum(len(t) for t in texts[-part.num_rows:] if t)
                if chars >= BATCH_CHARS:
                    yield flush(keys, texts)
                    keys, texts, chars = [], [], 0
        if texts:
            yield flush(keys, texts)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: bytes | None = None) -> DataFrame:
    """``id, text`` from the ids; NULL ids decode to an empty text."""
    small_batches(df.sparkSession)
    model = model or read_model()
    schema = T.StructType([df.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches):
        vocabulary = pieces(model)
        for b in batches:
            texts = [vocabulary.decode(r) for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=schema.names)

    return df.select(id_col, ids_col).mapInArrow(run, schema)
