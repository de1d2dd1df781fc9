"""The graph index against the exact search."""

import numpy as np

from quillon.operators import dense, graph


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<float>")


def test_edges_go_to_near_nodes_and_back():
    x = np.random.default_rng(1).normal(size=(300, 12))
    edges = graph.layer_edges(x, 5)
    assert edges.shape[1] <= 10 and all(i not in row for i, row in enumerate(edges))
    nearest = (x @ x.T - np.diag((x * x).sum(axis=1) + 1e9)).argmax(axis=1)
    assert np.mean([nearest[i] in edges[i] for i in range(len(x))]) > 0.95
    assert graph.layer_edges(x[:1], 5).tolist() == [[-1]] and sorted(graph.layer_edges(x[:2], 5).ravel().tolist()) == [0, 1]


def test_search_of_a_block_finds_the_nearest_at_a_tenth_of_the_products():
    """Queries that are no nodes, over vectors of eight dimensions in 64."""
    rng = np.random.default_rng(0)
    spread = rng.normal(size=(8, 64))
    x, q = (rng.normal(size=(n, 8)) @ spread for n in (4096, 200))
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    layers = [(one["nodes"], one["edges"]) for one in graph.build_layers(np.arange(len(x)), x, 8)]
    assert len(layers) > 2
    nodes, score, spent = graph.beam_search(q, x, layers, 32)
    exact = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(exact, nodes)]) >= 0.95 and spent.mean() <= 0.1 * len(x)
    assert np.allclose(score[:, :10], np.take_along_axis(q @ x.T, nodes[:, :10], axis=1))


def test_blocks_are_searched_apart_and_merged(spark):
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(6, 32))
    x, q = rng.normal(size=(1500, 6)) @ spread, rng.normal(size=(40, 6)) @ spread
    x[7] = x[8]  # a tie
    index = graph.graph_index(vectors(spark, x), block_rows=400).cache()
    asked = vectors(spark, q, 5000).withColumnRenamed("key", "qid")
    assert index.count() == 4
    got = graph.graph_top_k(asked, index, 10, pool=48).collect()
    want = {(r.qid, r.key) for r in dense.exact_top_k(asked, vectors(spark, x), 10).collect()}
    assert len(got) == 400 and len({(r.qid, r.key) for r in got} & want) >= 0.95 * len(want)
    by_query = {r.qid: r.products for r in got}
    assert all(0 < n < 1500 for n in by_query.values())


def test_few_vectors_and_none(spark):
    asked = vectors(spark, np.eye(3), 9).withColumnRenamed("key", "qid")
    got = graph.graph_top_k(asked, graph.graph_index(vectors(spark, np.eye(3)[:2])), 5).collect()
    assert {(r.qid, r["rank"]) for r in got} == {(q, r) for q in (9, 10, 11) for r in (1, 2)}
    assert graph.graph_top_k(asked, graph.graph_index(vectors(spark, np.zeros((0, 3)))), 5).collect() == []
