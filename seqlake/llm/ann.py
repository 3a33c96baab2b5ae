"""Approximate nearest neighbours by inner product: one HNSW graph per shard, shard results merged.

Equal vectors are one node (copies would make a graph's neighbourhoods useless);
of each the ``k + 1`` smallest ids are kept, which is all that any answer can
hold.  Nodes are dealt to shards by a hash.  A shard's graph is built by one
task in NumPy, layer by layer from the top, batches of points at a time, and
stored as rows with flat neighbour arrays.  A search takes blocks of queries
against every shard's graph; the best of all shards are merged, scored again in
double precision on the original vectors, and copies are put back.

Inner products become distances by one more dimension that brings a shard's
vectors to equal length, so any lengths are searched rightly.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
components take no part, nor do NULL ids; rows with the query's id are its own;
rows equal in id and vector count once; vectors of another length than the
query's are no candidates; an empty table gives an empty result; other columns
are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.common import landed

#: Parameters: links per node (twice in the lowest layer), width of the search while building and asking.
LINKS = 12
EF_BUILD = 48
EF_SEARCH = 200
SHARD_ROWS = 16_384
QUERY_BLOCK = 16_384
TOP = 20
_BATCH = 512
_AT_ONCE = 4


def _pick(vectors, ids, sims, width: int) -> np.ndarray:
    """Of candidates sorted by similarity (-1: none), the ``width`` to link: near and in different directions."""
    b, c = ids.shape
    v = vectors[ids]
    between = v @ v.transpose(0, 2, 1)
    kept = np.zeros((b, c), dtype=bool)
    for j in range(c):
        hidden = (kept & (between[:, j] > sims[:, j, None])).any(axis=1)
        kept[:, j] = (ids[:, j] >= 0) & ~hidden
    # first the kept ones, then the nearest others, nothing after the last candidate
    order = np.argsort(np.where(ids < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, order, axis=1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


def _beam(vectors, links, queries, entry, ef: int):
    """The ``ef`` most similar nodes found per query: ids (-1: none) and similarities, best first."""
    n_q, n = len(queries), len(vectors)
    if n_q * n > 1 << 26 and n_q > 1:   # bounds the table of visited nodes
        half = n_q // 2
        a = _beam(vectors, links, queries[:half], entry[:half], ef)
        b = _beam(vectors, links, queries[half:], entry[half:], ef)
        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    visited = np.zeros((n_q, n), dtype=bool)
    ids = np.full((n_q, ef), -1, dtype=np.int64)
    sims = np.full((n_q, ef), -np.inf, dtype=np.float32)
    e = entry.shape[1]
    ids[:, :e] = entry
    sims[:, :e] = np.where(entry >= 0, np.einsum("qed,qd->qe", vectors[entry], queries), -np.inf)
    fresh = ids >= 0
    r, c = np.nonzero(entry >= 0)
    visited[r, entry[r, c]] = True
    rows = np.arange(n_q)
    while len(rows):
        now = np.where(fresh[rows], sims[rows], -np.inf)
        pick = np.argpartition(-now, _AT_ONCE, axis=1)[:, :_AT_ONCE] if ef > _AT_ONCE else np.argsort(-now, axis=1)
        live = np.take_along_axis(now, pick, axis=1) > -np.inf
        going = live.any(axis=1)
        rows, pick, live = rows[going], pick[going], live[going]
        if not len(rows):
            break
        at = np.take_along_axis(ids[rows], pick, axis=1)
        flags = fresh[rows]
        np.put_along_axis(flags, pick, False, axis=1)
        fresh[rows] = flags
        near = np.where(live[:, :, None], links[at], -1).reshape(len(rows), -1)
        near.sort(axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(new)
        keep = ~visited[rows[r], near[r, c]]
        r, node = r[keep], near[r[keep], c[keep]]
        visited[rows[r], node] = True
        s = np.einsum("md,md->m", vectors[node], queries[rows[r]])
        # put the new ones beside the old in a rectangle and keep the best
        count = np.bincount(r, minlength=len(rows))
        wide = int(count.max()) if len(r) else 0
        if not wide:
            continue
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        more_i = np.full((len(rows), wide), -1, dtype=np.int64)
        more_s = np.full((len(rows), wide), -np.inf, dtype=np.float32)
        more_i[r, place], more_s[r, place] = node, s
        all_i = np.concatenate([ids[rows], more_i], axis=1)
        all_s = np.concatenate([sims[rows], more_s], axis=1)
        all_f = np.concatenate([fresh[rows], more_i >= 0], axis=1)
        best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        ids[rows] = np.take_along_axis(all_i, best, axis=1)
        sims[rows] = np.take_along_axis(all_s, best, axis=1)
        fresh[rows] = np.take_along_axis(all_f, best, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _layer(vectors, nodes, entry_of, width: int) -> np.ndarray:
    """Links (by position in ``nodes``) of one layer, its nodes inserted in the given order."""
    x = vectors[nodes]
    n = len(x)
    links = np.full((n, width), -1, dtype=np.int64)
    done = 0
    while done < n:
        size = min(n - done, _BATCH, max(width, done))
        new = np.arange(done, done + size)
        among = x[new] @ x[new].T
        np.fill_diagonal(among, -np.inf)
        take = min(width, size - 1)
        ids = np.argsort(-among, axis=1)[:, :take]
        sims = np.take_along_axis(among, ids, axis=1)
        ids = new[ids] if take else np.empty((size, 0), dtype=np.int64)
        if done:
            found, s = _beam(x, links, x[new], entry_of(new), EF_BUILD)
            ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, s], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        chosen = _pick(x, ids, sims, width)
        links[new] = chosen
        # links back: each node met gets its new neighbours, nearest first, and is thinned if it has too many
        r, c = np.nonzero(chosen >= 0)
        to, frm = chosen[r, c], new[r]
        s = np.einsum("md,md->m", x[to], x[frm])
        order = np.lexsort((-s, to))
        to, frm = to[order], frm[order]
        met, start, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(start, count)
        few = place < width
        incoming = np.full((len(met), min(width, int(count.max()) if len(count) else 0)), -1, dtype=np.int64)
        incoming[np.repeat(np.arange(len(met)), count)[few], place[few]] = frm[few]
        for lo in range(0, len(met), 2048):
            u, inc = met[lo:lo + 2048], incoming[lo:lo + 2048]
            both = np.concatenate([links[u], inc], axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1   # points of one batch may choose each other
            s = np.where(both >= 0, np.einsum("umd,ud->um", x[both], x[u]), -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")
            both, s = np.take_along_axis(both, order, axis=1), np.take_along_axis(s, order, axis=1)
            full = (both >= 0).sum(axis=1) > width
            links[u[~full]] = both[~full][:, :width] if both.shape[1] >= width else np.pad(
                both[~full], ((0, 0), (0, width - both.shape[1])), constant_values=-1)
            if full.any():
                links[u[full]] = _pick(x, both[full], s[full], width)
        done += size
    return links


def equal_length(x: np.ndarray) -> np.ndarray:
    """The vectors with one more component, which brings all to the longest one's length."""
    square = np.einsum("nd,nd->n", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)


class Graph:
    """Layers of ``(nodes, links)``, lowest first; a layer's nodes begin with the nodes of the layer above."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def levels(n: int, seed: int = 42) -> np.ndarray:
        u = np.random.default_rng(seed).random(n)
        return np.floor(-np.log(1 - u) / np.log(LINKS)).astype(int)

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        vectors = equal_length(x)
        level = cls.levels(len(x))
        order = np.argsort(-level, kind="stable")
        out = cls(vectors, [])
        for top in range(int(level.max()), -1, -1):
            nodes = order[:int((level >= top).sum())]
            above = len(out.layers)
            entry = (lambda new, nodes=nodes: out._descend(vectors[nodes[new]])) if above else (
                lambda new: np.zeros((len(new), 1), dtype=np.int64))
            # the nodes of the layer above come first, so an entry point is always there already
            links = _layer(vectors, nodes, entry, LINKS * (2 if top == 0 else 1))
            out.layers.insert(0, (nodes, links))
        return out

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """Entry points below the built layers: positions in the next layer's nodes."""
        at = np.zeros((len(queries), 1), dtype=np.int64)
        for nodes, links in reversed(self.layers):
            at = _beam(self.vectors[nodes], links, queries, at, 4)[0][:, :1]
        return at

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Nodes found per query (-1: none), most similar first."""
        out = []
        (nodes, links), upper = self.layers[0], Graph(self.vectors, self.layers[1:])
        x = self.vectors[nodes]
        for lo in range(0, len(queries), _BATCH):
            q = np.pad(queries[lo:lo + _BATCH], ((0, 0), (0, 1))).astype(np.float32)
            found = _beam(x, links, q, upper._descend(q), ef)[0]
            out.append(np.where(found >= 0, nodes[found], -1))
        return np.concatenate(out) if out else np.empty((0, ef), dtype=np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Whether a vector may take part."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


_INDEX = "dim int, shard int, node int, vec_id long, h1 long, h2 long, vector array<float>, levels array<array<int>>"


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: its shard, identity (``vec_id, h1, h2``), vector, and links in each layer, lowest first."""
    n = nodes.count()
    shards = max(1, -(-n // shard_rows))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("h1", "ascending")])
        graph = Graph.build(_matrix(table["vector"]).astype(np.float64))
        per_node = [[] for _ in range(len(table))]
        for own, links in graph.layers:
            for node, row in zip(own.tolist(), np.where(links >= 0, own[links], -1).astype(np.int32)):
                per_node[node].append(row)
        return pa.table({"dim": table["dim"], "shard": table["shard"], "node": pa.array(np.arange(len(table)), pa.int32()),
                         "vec_id": table["vec_id"], "h1": table["h1"], "h2": table["h2"], "vector": table["vector"].cast(pa.list_(pa.float32())),
                         "levels": pa.array(per_node, pa.list_(pa.list_(pa.int32())))})

    d = nodes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("h1"), F.lit(shards)).cast("int").alias("shard"),
                     "vec_id", "h1", "h2", "vector")
    return d.groupBy("dim", "shard").applyInArrow(build, _INDEX)


def _graph(table: pa.Table) -> Graph:
    """The graph back from its rows (sorted by node)."""
    vectors = equal_length(_matrix(table["vector"]).astype(np.float64))
    levels = table["levels"].combine_chunks()
    depth = np.diff(levels.offsets.to_numpy())
    inner = levels.flatten()
    first = np.cumsum(depth) - depth
    order = np.argsort(-depth, kind="stable")
    starts, flat = inner.offsets.to_numpy(), inner.flatten().to_numpy().astype(np.int64)
    starts = starts - starts[0]
    layers = []
    for k in range(int(depth.max())):
        nodes = order[:int((depth > k).sum())]
        at = starts[first[nodes] + k]
        links = flat[at[:, None] + np.arange(starts[first[nodes[0]] + k + 1] - at[0])[None, :]]
        position = np.zeros(len(depth), dtype=np.int64)
        position[nodes] = np.arange(len(nodes))
        layers.append((nodes, np.where(links >= 0, position[links], -1)))
    return Graph(vectors, layers)


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH,
                 query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(q1, q2, h1, h2, vec_id, score)``: the ``k`` nodes found best in each shard, for queries ``(q1, q2, vector)``."""
    blocks = max(1, -(-queries.count() // query_block))
    cells = index.select("dim", "shard").distinct()
    asked = queries.select(F.size("vector").alias("dim"), "q1", "q2", "vector",
                           F.pmod(F.xxhash64("q1"), F.lit(blocks)).cast("int").alias("block")).join(cells, "dim")
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    kinds = {"q1": pa.int64(), "q2": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(kinds)
        if not len(left) or not len(right):
            return schema.empty_table()
        left = left.sort_by("node")
        q = _matrix(right["vector"]).astype(np.float64)
        found = _graph(left).search(q, max(ef, k))
        ids, x = left["vec_id"].to_numpy(), _matrix(left["vector"]).astype(np.float64)
        names = [t[c].to_numpy() for t, c in ((right, "q1"), (right, "q2"), (left, "h1"), (left, "h2"))]
        out = []
        for lo in range(0, len(q), _BATCH):
            f = found[lo:lo + _BATCH]
            s = np.where(f >= 0, np.einsum("qmd,qd->qm", x[f], q[lo:lo + _BATCH]), -np.inf)
            order = np.lexsort((ids[f], -s), axis=1)[:, :k]
            f, s = np.take_along_axis(f, order, axis=1), np.take_along_axis(s, order, axis=1)
            r, c = np.nonzero(f >= 0)
            node = f[r, c]
            out.append(pa.table([names[0][lo + r], names[1][lo + r], names[2][node], names[3][node], ids[node], s[r, c]],
                                schema=schema))
        return pa.concat_tables(out)

    asked = asked.select("q1", "q2", "vector", *[F.col(c).alias(f"q_{c}") for c in ("dim", "shard", "block")])
    return (spread.groupBy("dim", "shard", "block").cogroup(asked.groupBy("q_dim", "q_shard", "q_block"))
            .applyInArrow(search, ", ".join(f"{c} {'double' if c == 'score' else 'long'}" for c in kinds)))


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP,
            ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row that ``is_query`` chooses."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"),
                     F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    rows = landed(rows.dropDuplicates(["vec_id", "h1", "h2"]), "vectors")
    # copies: the k + 1 smallest ids of each vector (Spark limits the groups before it shuffles them)
    w = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = rows.select("h1", "h2", "vec_id", "vector").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    members = landed(members, "members")
    nodes = landed(members.where("n = 1").select("vec_id", "h1", "h2", "vector"), "nodes")
    copies = landed(members.select("h1", "h2", "vec_id"), "copies")

    index = landed(build_index(nodes, shard_rows), "index")
    # equal query vectors are searched once
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), "vector")
    asked = landed(asking.groupBy("q1", "q2").agg(F.first("vector").alias("vector")), "asked")
    found = search_index(index, asked, k + 1, ef)
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r", "vec_id")
    pairs = landed(found, "found").join(copies, ["h1", "h2"]).join(asking.drop("vector"), ["q1", "q2"])
    ranked = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id")
    return (pairs.where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
