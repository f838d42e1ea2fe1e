from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecweave.operators import graph as G
from vecweave.operators.search import search


def vectors(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    if clusters:
        v = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 2 + v
    return v.astype("float32")


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<float>").repartition(4)


def scores_of(v, metric):
    v = v.astype(float)
    if metric == "euclidean":
        return -np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    dot = v @ v.T
    n = np.linalg.norm(v, axis=1)
    return dot / np.outer(n, n) if metric == "cosine" else dot


def checked(rows, v, metric, k):
    """Recall, after checking that scores are exact, ranks in order and nobody its own neighbour."""
    s = scores_of(v, metric)
    by = {}
    for r in rows:
        assert r["id"] != r["neighbour"] and r["score"] == pytest.approx(s[r["id"], r["neighbour"]], abs=1e-9)
        by.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["score"]))
    np.fill_diagonal(s, -np.inf)
    good = 0
    for i, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, min(k, len(v) - 1) + 1)) and len({f[1] for f in found}) == len(found)
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        worst = np.sort(s[i])[-len(found)]
        good += sum(f[2] >= worst - 1e-9 for f in found)
    assert len(by) == len(v)
    return good / (len(v) * min(k, len(v) - 1))


@pytest.mark.parametrize(("metric", "clusters"), [("cosine", 12), ("euclidean", 12), ("dot_product", 0)])
def test_graph_reaches_recall(spark, metric, clusters):
    v = vectors(900, 16, 3, clusters)
    found = G.knn_graph(frame(spark, v), 8, metric, block=32, orders=3).collect()
    assert checked(found, v, metric, 8) >= 0.9


def test_descent_improves_the_first_graph_and_is_repeatable(spark):
    v = vectors(800, 16, 5)
    s = frame(spark, v)
    first = checked(G.knn_graph(s, 8, rounds=0, block=16, orders=2).collect(), v, "cosine", 8)
    one, two = (G.knn_graph(rows, 8, block=16, orders=2).collect() for rows in (s, s.repartition(7)))
    assert checked(one, v, "cosine", 8) >= 0.9 > first
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_copies_do_not_all_point_to_the_same_rows(spark):
    v = vectors(300, 8, 7)
    v[:150] = v[0]
    rows = G.knn_graph(frame(spark, v), 5, block=32).collect()
    assert checked(rows, v, "cosine", 5) >= 0.9
    pointed = np.bincount([r["neighbour"] for r in rows], minlength=300)
    assert pointed.max() < 60


def test_small_tables_and_rows_that_are_no_nodes(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, 1.0])]
    s = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    got = sorted((r["id"], r["rank"], r["neighbour"]) for r in G.knn_graph(s, 10).collect())
    assert got == [(1, 1, 6), (1, 2, 2), (2, 1, 6), (2, 2, 1), (6, 1, got[4][2]), (6, 2, got[5][2])]
    assert G.knn_graph(s.filter("id = 1")).count() == 0 and G.knn_graph(s.limit(0)).columns == ["id", "neighbour", "score", "rank"]
    named = s.withColumn("id", F.concat(F.lit("n"), "id"))
    assert G.knn_graph(named, 1).filter("id = 'n1'").first()["neighbour"] == "n6"
    for bad in ({"k": 0}, {"metric": "x"}):
        with pytest.raises(ValueError):
            G.knn_graph(s, **bad)


def test_recall_counts_scores(spark):
    v = vectors(200, 8, 9)
    s = frame(spark, v)
    exact = search(s.withColumnRenamed("id", "query_id"), s, 6).filter("query_id <> id")
    exact = exact.select(F.col("query_id").alias("id"), F.col("id").alias("neighbour"), F.col("similarity_score").alias("score"))
    assert {r["recall"] for r in G.graph_recall(exact, exact).collect()} == {1.0}
    none = G.graph_recall(exact.limit(0), exact)
    assert none.count() == 200 and none.agg(F.max("recall")).first()[0] == 0.0


def test_nothing_is_crossed(spark):
    v = vectors(300, 8, 1)
    s = frame(spark, v)
    edges = G._block_edges(G._in_order(s, 0, 1, 8, 300, 32), 5, "cosine", 32, "bigint")
    graph = G._k_best(edges.withColumn("fresh", F.lit(True)), 5)
    plan = G._around(graph, 5).join(s, "id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_blocks_do_not_depend_on_batches():
    import pyarrow as pa

    table = pa.table({"id": list(range(70)), "embedding": [[0.0]] * 70, "_range": [0] * 33 + [1] * 4 + [5] * 33})
    want = [list(range(0, 16)), list(range(16, 32)), [32], [33, 34, 35, 36], list(range(37, 53)), list(range(53, 69)), [69]]
    for size in (1, 7, 33, 70):
        assert [b.column(0).to_pylist() for b in G._blocks(iter(table.to_batches(size)), 16)] == want


def test_only_centres_with_something_new_get_vectors(spark):
    edges = [("a", "b", True), ("b", "a", False), ("c", "d", False), ("d", "c", False)]
    graph = spark.createDataFrame([(i, n, 0.5, f) for i, n, f in edges], "id string, neighbour string, score double, fresh boolean")
    got = sorted((r["centre"], r["id"], r["fresh"]) for r in G._around(graph, 4).collect())
    assert got == [("a", "a", False), ("a", "b", True), ("b", "a", True), ("b", "b", False)]
