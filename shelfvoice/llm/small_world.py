"""Nearest neighbours by a hierarchical navigable small-world graph for each shard.

Vectors are dealt over shards by a hash of their id. A shard's graph is built by
one task: nodes draw a level, those of the higher levels come first, and each
level is a flat array of neighbour numbers. The levels above the ground hold a
sixteenth of the nodes below them and are linked from all their pairs, in blocks;
on the ground nodes come in batches, each searching the graph so far. Neighbours
are chosen so that none is nearer to another one chosen than to the node.

Inner products are no distance. Each vector gets one more component that makes
all lengths of a shard equal; queries have zero there. The order of the inner
products is then that of the distances, and links are as good as for those.

Equal vectors of a shard are one node, since copies would only link to copies.
A search walks the levels down and, on the ground, widens a list of the best
nodes, for many queries at a time. Scores come from the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, ship, stage

#: Rows of a shard, and bytes of its vectors, whichever is less; a search task holds one shard.
SHARD_ROWS, SHARD_BYTES = 16_384, 64 << 20
#: Queries that one task looks up in one shard.
BLOCK_QUERIES = 32_768
#: Links of a node on the ground; half as many above.
LINKS = 32
#: Nodes kept while a node looks for its links, and while a query searches.
BUILD_WIDTH, SEARCH_WIDTH = 64, 128
_BATCH = 256
#: List entries whose neighbours are read in one step.
_STEP = 4

INDEX = "size int, shard int, vec_ids binary, vectors binary, nodes binary, links binary, levels array<int>"
FOUND = "query_id long, vec_id long, score double"


def chosen(near: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` links for each row of candidates ``near`` (-1: none), as numbers padded with -1.

    From the nearest on a candidate is taken unless it is nearer to one taken
    before; what is left fills up.
    """
    rows, width = near.shape
    held = vectors[near]
    own = np.einsum("rcd,rd->rc", held, vectors[nodes])
    own[near < 0] = -np.inf
    order = np.argsort(-own, axis=1, kind="stable")
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    held = np.take_along_axis(held, order[:, :, None], 1)
    between = held @ held.transpose(0, 2, 1)
    taken = np.zeros((rows, width), bool)
    closest = np.full((rows, width), -np.inf, np.float32)  # to any taken so far
    for k in range(width):
        fits = (own[:, k] > closest[:, k]) & (near[:, k] >= 0) & (taken.sum(1) < most)
        taken[fits, k] = True
        np.maximum(closest, between[:, k], out=closest, where=fits[:, None])
    rank = np.argsort(np.where(near < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
    made = np.take_along_axis(near, rank, 1)
    if width < most:
        made = np.pad(made, ((0, 0), (0, most - width)), constant_values=-1)
    return made.astype(np.int32)


def nearest(links: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``width`` nodes found for each query from its entries (-1: none), best first, with their similarities."""
    rows, n = len(queries), len(links)
    line = np.arange(rows)[:, None]
    width = min(width, n)
    ids = np.full((rows, width), -1, np.int64)
    sims = np.full((rows, width), -np.inf, np.float32)
    ready = np.zeros((rows, width), bool)  # neighbours were read
    seen = np.zeros((rows, n + 1), bool)  # the last column is that of -1
    seen[:, n] = True

    def add(ids, sims, ready, new):
        new = np.sort(new, axis=1)
        again = np.zeros_like(new, bool)
        again[:, 1:] = new[:, 1:] == new[:, :-1]
        new = np.where(again | seen[line, new], -1, new)
        seen[line, new] = True
        near = np.einsum("qkd,qd->qk", vectors[new], queries)
        near[new < 0] = -np.inf
        all_ids, all_sims = np.concatenate((ids, new), 1), np.concatenate((sims, near), 1)
        all_ready = np.concatenate((ready, new < 0), 1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width] if all_sims.shape[1] > width else np.broadcast_to(np.arange(width), (rows, width))
        return tuple(np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_ready))

    ids, sims, ready = add(ids, sims, ready, entries.astype(np.int64))
    while True:
        waiting = np.where(ready | (ids < 0), -np.inf, sims)
        step = min(_STEP, width)
        next_ones = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
        open_ones = np.take_along_axis(waiting, next_ones, 1) > -np.inf
        if not open_ones.any():
            break
        from_ids = np.where(open_ones, np.take_along_axis(ids, next_ones, 1), -1)
        np.put_along_axis(ready, next_ones, True, 1)
        new = np.where(from_ids[:, :, None] >= 0, links[from_ids], -1).reshape(rows, -1)
        ids, sims, ready = add(ids, sims, ready, new.astype(np.int64))
    order = np.lexsort((ids, -sims), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _both_ways(links: np.ndarray, vectors: np.ndarray, new: np.ndarray, most: int) -> None:
    """Link the neighbours of the new nodes back to them; a full list is chosen anew."""
    to, back = links[new].ravel(), np.repeat(new, links.shape[1])
    back, to = back[to >= 0], to[to >= 0]
    # A node that very many chose hears of the nearest ones.
    sims = np.einsum("nd,nd->n", vectors[to], vectors[back])
    order = np.lexsort((-sims, to))
    to, back = to[order], back[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, counts)
    keep = place < most
    heard = np.full((len(targets), most), -1, np.int64)
    heard[np.repeat(np.arange(len(targets)), counts)[keep], place[keep]] = back[keep]
    for at in range(0, len(targets), 1024):
        part = targets[at : at + 1024]
        both = np.sort(np.concatenate((links[part].astype(np.int64), heard[at : at + 1024]), 1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        links[part] = chosen(both, vectors, part, most)


def _full_level(vectors: np.ndarray, n: int, most: int) -> np.ndarray:
    """Links among the first n nodes, from all their pairs, in blocks."""
    links = np.full((n, most), -1, np.int32)
    width = min(n - 1, BUILD_WIDTH)
    if width > 0:
        for at in range(0, n, 512):
            part = np.arange(at, min(at + 512, n))
            sims = vectors[part] @ vectors[:n].T
            sims[np.arange(len(part)), part] = -np.inf
            near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            links[part] = chosen(near, vectors, part, most)
        _both_ways(links, vectors, np.arange(n), most)
    return links


def build(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> list[np.ndarray]:
    """Neighbour arrays of the levels, the ground first; a level holds the first nodes only, as many as its array is long.

    ``vectors`` are of equal length and in random order, so the first nodes are a random choice.
    """
    n = len(vectors)
    half = max(2, links // 2)
    sizes = [n]
    while sizes[-1] > half:
        sizes.append(max(1, sizes[-1] // half))
    above = [_full_level(vectors, k, half) for k in sizes[1:]]
    start = sizes[1] if above else n
    ground = np.full((n, links), -1, np.int32)
    ground[:start] = _full_level(vectors, start, links)
    at = start
    while at < n:
        to = min(n, at + min(_BATCH, max(8, at // 2)))
        part = np.arange(at, to)
        entries = _descend(above, vectors, vectors[part])
        near, _ = nearest(ground[:at], vectors[:at], vectors[part], entries, width)
        # Nodes of one batch don't find each other in the graph.
        among = vectors[part] @ vectors[part].T
        np.fill_diagonal(among, -np.inf)
        some = min(links, len(part) - 1)
        fellows = np.argpartition(-among, some - 1, axis=1)[:, :some] + at if some > 0 else np.zeros((len(part), 0), np.int64)
        ground[part] = chosen(np.concatenate((near, fellows), 1), vectors, part, links)
        _both_ways(ground, vectors, part, links)
        at = to
    return [ground, *above]


def _descend(above: list[np.ndarray], vectors: np.ndarray, queries: np.ndarray, width: int = 8) -> np.ndarray:
    """Entries to the ground: the best nodes of each level lead to the next."""
    entries = np.zeros((len(queries), 1), np.int64)
    for level in reversed(above):
        entries, _ = nearest(level, vectors[: len(level)], queries, entries, width)
    return entries


def search(levels: list[np.ndarray], vectors: np.ndarray, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """Nodes found for each query, best first; -1 where there are no more."""
    if len(levels[0]) <= width:  # the list holds the whole graph
        return np.broadcast_to(np.arange(len(levels[0])), (len(queries), len(levels[0])))
    made = [nearest(levels[0], vectors, queries[k : k + _BATCH], _descend(levels[1:], vectors, queries[k : k + _BATCH]), width)[0] for k in range(0, len(queries), _BATCH)]
    return np.concatenate(made) if made else np.zeros((0, width), np.int64)


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _equal_lengths(vectors: np.ndarray) -> np.ndarray:
    """Scaled to at most one, with a last component that makes every length one; in single precision."""
    scale = np.abs(vectors).max()
    vectors = vectors / scale
    squares = (vectors * vectors).sum(axis=1)
    last = np.sqrt(np.maximum(0, squares.max() - squares))
    return (np.column_stack((vectors, last)) / math.sqrt(squares.max())).astype(np.float32)


def _indexed(table: pa.Table) -> pa.Table:
    """One shard's rows to its index row."""
    size, shard = table.column("size")[0].as_py(), table.column("shard")[0].as_py()
    ids, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("vector"), size)
    order = np.argsort(ids, kind="stable")[np.random.default_rng(shard).permutation(len(ids))]
    ids, vectors = ids[order], vectors[order]
    _, first, node = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    # Distinct vectors in the rows' random order.
    rank = np.argsort(np.argsort(first))
    node = rank[node.ravel()]
    levels = build(_equal_lengths(vectors[np.sort(first)]))
    order = np.lexsort((ids, node))
    flat = np.concatenate([x.ravel() for x in levels])
    made = [[size], [shard], [ids[order].tobytes()], [vectors[order].tobytes()], [node[order].astype(np.int32).tobytes()], [flat.tobytes()], [[len(x) for x in levels]]]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
    return pa.table([pa.array(v, t) for v, t in zip(made, types)], ["size", "shard", "vec_ids", "vectors", "nodes", "links", "levels"])


def _searched(most: int, width: int):
    """One shard's index and a block of queries to the best rows of the shard."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if index.num_rows and asked.num_rows:
            shard = index.to_pylist()[0]
            ids, nodes = np.frombuffer(shard["vec_ids"], np.int64), np.frombuffer(shard["nodes"], np.int32)
            vectors = np.frombuffer(shard["vectors"], np.float64).reshape(-1, shard["size"])
            flat, levels, at = np.frombuffer(shard["links"], np.int32), [], 0
            for k, n in enumerate(shard["levels"]):
                size = LINKS if k == 0 else max(2, LINKS // 2)
                levels.append(flat[at : at + n * size].reshape(n, size))
                at += n * size
            first = np.searchsorted(nodes, np.arange(len(levels[0]) + 1))
            even = _equal_lengths(vectors[first[:-1]])
            query_ids, queries = asked.column("vec_id").to_numpy(), _matrix(asked.column("vector"), shard["size"])
            scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
            scaled /= np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
            reached = search(levels, even, np.column_stack((scaled, np.zeros(len(queries)))).astype(np.float32), width)
            for q in range(len(queries)):
                hits = reached[q][reached[q] >= 0]
                scores = (vectors[first[hits]] * queries[q]).sum(axis=1)
                # Of a node's equal rows the least ids come first; of more than asked for none can be among the best.
                counts = np.minimum(first[hits + 1] - first[hits], most + 1)
                rows = np.repeat(first[hits] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                scores, near = np.repeat(scores, counts), ids[rows]
                best = np.lexsort((near, -scores))
                best = best[near[best] != query_ids[q]][:most]
                found.append((np.full(len(best), query_ids[q]), near[best], scores[best]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vector, size)``, one row for each id, of the vectors that can be compared.

    Null ids, and vectors that are null, empty, zero or hold a null or
    non-finite component, are left out. Of several vectors of one id the least
    stays, component by component.
    """
    rows = table.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard of ``usable`` vectors, with its graph as flat arrays; vectors of different sizes have shards of their own."""
    ship(vectors.sparkSession)
    sizes = vectors.groupBy("size").agg(F.count(F.lit(1)).alias("rows"))
    held = F.least(F.lit(shard_rows).cast("long"), F.greatest(F.lit(1).cast("long"), (F.lit(SHARD_BYTES) / (8 * F.col("size"))).cast("long")))
    sizes = sizes.select("size", F.ceil(F.col("rows") / held).cast("int").alias("shards"))
    dealt = vectors.join(F.broadcast(sizes), "size").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    return dealt.select("vec_id", "vector", "size", "shard").groupBy("size", "shard").applyInArrow(_indexed, INDEX)


def neighbours(shards: DataFrame, queries: DataFrame, most: int = 20, width: int = SEARCH_WIDTH, block: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``most`` best rows found for each of the ``usable`` queries, its own id left out.

    ``shards`` is a staged ``index``. Every query visits every shard of its
    size, in blocks, and the shards' results are merged.
    """
    ship(shards.sparkSession)
    sizes = shards.groupBy("size").agg(F.max("shard").alias("last"))
    blocks = max(1, -(-queries.count() // block))
    asked = queries.join(F.broadcast(sizes), "size").select("vec_id", "vector", "size", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    copies = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["size", "shard", "block"]
    found = copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searched(most, width), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def search_table(table: DataFrame, every: int = 20, most: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``most`` nearest rows of each row whose id is divisible by ``every``, by largest inner product.

    All other rows are candidates; fewer than ``most`` of them are all returned.
    Rows that ``usable`` leaves out take no part, rows that repeat an id count
    once, equal scores go by the smaller id. Vectors are compared with those of
    their size only. An empty table gives an empty result; other columns are not
    read.
    """
    vectors = stage(usable(table, id_col, vector_col), "vectors")
    shards = stage(index(vectors, shard_rows), "shards")
    return neighbours(shards, vectors.filter(F.col("vec_id") % every == 0), most, width)


def exact(vectors: DataFrame, queries: DataFrame, most: int = 20, parts: int = 64) -> DataFrame:
    """The true neighbours of ``usable`` queries, to measure recall by: each of ``parts`` parts of the rows against the queries.

    The queries are sent to all tasks; take a bounded sample of them.
    """
    asked = queries.select("vec_id", "vector", "size").limit(10_000)
    sent: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for row in asked.collect():
        sent.setdefault(row.size, []).append((row.vec_id, row.vector))
    sent = {k: (np.array([x[0] for x in v], np.int64), np.array([x[1] for x in v])) for k, v in sent.items()}

    def run(part: pa.Table) -> pa.Table:
        size = part.column("size")[0].as_py()
        made = []
        if size in sent:
            ids, rows = part.column("vec_id").to_numpy(), _matrix(part.column("vector"), size)
            for q, vector in zip(*sent[size]):
                scores = (rows * vector).sum(axis=1)
                best = np.lexsort((ids, -scores))
                best = best[ids[best] != q][:most]
                made.append((np.full(len(best), q), ids[best], scores[best]))
        columns = [np.concatenate(x) for x in zip(*made)] if made else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    found = dealt.groupBy("size", "part").applyInArrow(run, FOUND).withColumn("rank", F.row_number().over(best))
    return found.filter(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    hits = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, true.count())
