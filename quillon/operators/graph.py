"""Graph index: layered small-world graphs, one for each block of vectors.

A block's vectors are nodes of a graph on each layer, a node reaching layer l with probability DEGREE ** -l. Edges go
to near nodes that are nearer to the node than to each other, filled up with the nearest of the others, and back. A
search descends the layers to the best node of each and then keeps a pool of the best nodes found so far, opening the
best that are still shut until none is left. Blocks are built and searched by themselves and their hits merged, so
neither a build nor a search holds more than a block; the table has a row for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.dense import _blocks
from quillon.operators.ranking import DIGITS

#: Vectors of a block, edges that a node of the lowest layer takes up itself (half as many above; as many again come back), and a search's pool.
BLOCK_ROWS, DEGREE, POOL = 4096, 8, 16
#: Nodes of the pool that a step opens, queries that are searched together, rows that are compared at once.
OPENED, TOGETHER, SLAB = 2, 128, 256
SCHEMA = "block int, ids array<long>, flat array<float>, layers array<struct<nodes:array<int>,edges:array<int>>>"


def node_levels(ids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The highest layer of each node, drawn by a hash of its id."""
    mixed = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    drawn = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return (-np.log(np.maximum(drawn, 1e-300)) / np.log(degree)).astype(np.int64)


def _spread(similar: np.ndarray, near: np.ndarray, x: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates near, the nearest first, degree that are not nearer to each other than to it, then the nearest of the rest; -1 where there are fewer."""
    at = x[near]
    between = np.einsum("nid,njd->nij", at, at)
    closest, kept = np.full(near.shape, -np.inf), np.zeros(near.shape, bool)
    for t in range(near.shape[1]):
        keep = (closest[:, t] < similar[:, t]) & (kept.sum(axis=1) < degree)
        kept[:, t] = keep
        closest = np.where(keep[:, None], np.maximum(closest, between[:, t]), closest)
    order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(near, order, axis=1)


def layer_edges(x: np.ndarray, degree: int) -> np.ndarray:
    """(n, 2 * degree) neighbours of each of n vectors, -1 where there are fewer: their own edges and those back, the nearest ones."""
    n = len(x)
    wide = min(n - 1, 3 * degree)
    if wide < 1:
        return np.full((n, 1), -1)
    own = []
    for a in range(0, n, SLAB):
        score = x[a : a + SLAB] @ x.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        near = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
        similar = np.take_along_axis(score, near, axis=1)
        order = np.lexsort((near, -similar), axis=1)
        own.append(_spread(np.take_along_axis(similar, order, axis=1), np.take_along_axis(near, order, axis=1), x, degree))
    own = np.concatenate(own)
    tail, head = np.repeat(np.arange(n), own.shape[1]), own.ravel()
    both = np.unique(np.concatenate((np.stack((tail, head), 1), np.stack((head, tail), 1))), axis=0)
    score = np.einsum("nd,nd->n", x[both[:, 0]], x[both[:, 1]])
    both = both[np.lexsort((both[:, 1], -score, both[:, 0]))]
    place = np.arange(len(both)) - np.searchsorted(both[:, 0], both[:, 0])
    out = np.full((n, 2 * degree), -1)
    fits = place < 2 * degree
    out[both[fits, 0], place[fits]] = both[fits, 1]
    return out[:, : max(1, int(place[fits].max()) + 1)]


def build_layers(ids: np.ndarray, x: np.ndarray, degree: int = DEGREE) -> list[dict]:
    """The block's layers from the lowest up: the nodes, and their neighbours in rows of equal width."""
    levels, layers = node_levels(ids, degree), []
    for level in range(int(levels.max()) + 1):
        nodes = np.flatnonzero(levels >= level) if level else np.arange(len(ids))
        edges = layer_edges(x[nodes], degree if level == 0 else max(2, degree // 2))
        layers.append({"nodes": nodes.astype(np.int32), "edges": np.where(edges >= 0, nodes[edges], -1).astype(np.int32)})
    return layers


def graph_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS, degree: int = DEGREE) -> DataFrame:
    """SCHEMA: a row for each block of vectors (key, vector) with its layers. Blocks are dealt by hash of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, flat = b.column(1)[r].values.to_numpy(), b.column(2)[r].values.to_numpy()
                layers = build_layers(ids, flat.reshape(len(ids), -1).astype(np.float64), degree)
                shown = [{"nodes": one["nodes"].tolist(), "edges": one["edges"].ravel().tolist()} for one in layers]
                kind = pa.list_(pa.struct([("nodes", pa.list_(pa.int32())), ("edges", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()], pa.int32()), pa.array([ids]), pa.array([flat]), pa.array([shown], kind)], ["block", "ids", "flat", "layers"])

    blocks = _blocks(vectors, "key", block_rows)
    return blocks.select(F.col("block").cast("int").alias("block"), "ids", "flat").mapInArrow(run, SCHEMA)


def beam_search(asked: np.ndarray, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, scores, products) of queries in one block: each query's pool, best first (-1 and -inf where it is short), and how many products it took."""
    n, every = len(asked), np.arange(len(asked))
    top_nodes, _ = layers[-1]
    best = np.full(n, top_nodes[0], np.int64)
    score, spent = asked @ x[top_nodes[0]], np.ones(n, np.int64)
    for nodes, edges in layers[:0:-1]:
        row_of = np.full(len(x), -1)
        row_of[nodes] = np.arange(len(nodes))
        moving = every
        while len(moving):
            near = edges[row_of[best[moving]]]
            value = np.where(near >= 0, np.einsum("qd,qed->qe", asked[moving], x[near]), -np.inf)
            spent[moving] += (near >= 0).sum(axis=1)
            at = value.argmax(axis=1)
            found = value[np.arange(len(moving)), at]
            better = found > score[moving]
            best[moving[better]], score[moving[better]] = near[np.arange(len(moving)), at][better], found[better]
            moving = moving[better]
    edges = layers[0][1]
    held, value, opened = np.full((n, pool), -1), np.full((n, pool), -np.inf), np.ones((n, pool), bool)
    held[:, 0], value[:, 0], opened[:, 0] = best, score, False
    seen = np.zeros((n, len(x)), bool)
    seen[every, best] = True
    going = every
    while len(going):
        shut = np.where(opened[going], -np.inf, value[going])
        at = np.argsort(-shut, axis=1, kind="stable")[:, :OPENED]
        usable = np.isfinite(np.take_along_axis(shut, at, axis=1))
        opened[going[:, None], at] = True
        near = np.where(usable[:, :, None], edges[held[going[:, None], at]], -1).reshape(len(going), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[going[:, None], near]
        rows, columns = np.nonzero(fresh)
        seen[going[rows], near[rows, columns]] = True
        spent[going] += fresh.sum(axis=1)
        new = np.full(near.shape, -np.inf)
        new[rows, columns] = np.einsum("nd,nd->n", asked[going[rows]], x[near[rows, columns]])
        all_nodes, all_values = np.concatenate((held[going], near), axis=1), np.concatenate((value[going], new), axis=1)
        all_opened = np.concatenate((opened[going], ~fresh), axis=1)
        order = np.argsort(-all_values, axis=1, kind="stable")[:, :pool]
        held[going], value[going], opened[going] = (np.take_along_axis(c, order, axis=1) for c in (all_nodes, all_values, all_opened))
        going = going[(~opened[going] & np.isfinite(value[going])).any(axis=1)]
    return np.where(np.isfinite(value), held, -1), value, spent


def graph_top_k(queries: DataFrame, index: DataFrame, k: int, pool: int = POOL) -> DataFrame:
    """(qid, key, score, rank, products) of queries (qid, vector) in a graph_index(): the best k of all blocks' pools.

    products is how many inner products a query took in all blocks. Blocks of queries meet those of vectors on the
    block's number, as in the exact search; a query hands on k hits a block.
    """
    sides = _blocks(queries, "qid").select(F.col("ids").alias("qids"), F.col("flat").alias("q"))
    blocks = index.select("block").distinct()
    pairs = sides.join(F.broadcast(blocks)).join(index, "block").select("block", "qids", "q", "ids", "flat", "layers")  # the blocks' numbers alone are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qids, left, keys, right = (b.column(i)[r].values.to_numpy() for i in (1, 2, 3, 4))
                left, right = left.reshape(len(qids), -1).astype(np.float64), right.reshape(len(keys), -1).astype(np.float64)
                layers = []
                for one in b.column(5)[r].values:
                    nodes = one["nodes"].values.to_numpy()
                    layers.append((nodes, one["edges"].values.to_numpy().reshape(len(nodes), -1)))
                for a in range(0, len(qids), TOGETHER):
                    nodes, value, spent = beam_search(left[a : a + TOGETHER], right, layers, min(max(pool, k), len(keys)))
                    order = np.lexsort((np.where(nodes >= 0, keys[nodes], 0), -np.round(value, DIGITS)), axis=1)[:, :k]
                    nodes, value = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(value, order, axis=1)
                    # a query's products in a block stand beside its first hit there
                    cost = np.zeros(nodes.shape, np.int64)
                    cost[:, 0] = spent
                    real = nodes >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[a : a + TOGETHER], nodes.shape[1])[real.ravel()]), pa.array(keys[nodes[real]]), pa.array(value[real]), pa.array(cost[real])], ["qid", "key", "score", "spent"])

    hits = pairs.mapInArrow(run, "qid long, key long, score double, spent long")
    whole = Window.partitionBy("qid")
    ranked = hits.select("qid", "key", "score", F.row_number().over(whole.orderBy(F.round("score", DIGITS).desc(), "key")).alias("rank"), F.sum("spent").over(whole).alias("products"))
    return ranked.filter(F.col("rank") <= k)
