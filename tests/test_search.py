from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecweave.operators import ann
from vecweave.operators.search import expand_neighbours, expanded_context, hybrid_search, nest_matches, recall_at_k, search


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    store = rng.normal(size=(600, 12))
    store[100:200] = store[100]  # a group of copies
    store[5] = 0.0
    queries = np.vstack([rng.normal(size=(20, 12)), store[100:101], store[7:8]])
    rows = [(i, [float(x) for x in v], f"src{i % 3}", {"page": str(i % 4)}) for i, v in enumerate(store.astype("float32"))]
    rows += [(1000, None, "src0", {}), (1001, [], "src0", {})]
    s = spark.createDataFrame(rows, "id int, embedding array<float>, source string, metadata map<string,string>").repartition(5)
    q = spark.createDataFrame([(f"q{i:02d}", [float(x) for x in v]) for i, v in enumerate(queries)], "query_id string, embedding array<double>")
    return q, s, queries, store.astype("float32").astype("float64")


def brute(queries, store, metric, keep=lambda i: True, k=10, threshold=None):
    out = {}
    for qi, q in enumerate(queries):
        found = []
        for i, v in enumerate(store):
            if not keep(i):
                continue
            if metric == "dot_product":
                s = float(q @ v)
            elif metric == "euclidean":
                s = -float(np.sqrt(((q - v) ** 2).sum()))
            else:
                n = np.linalg.norm(q) * np.linalg.norm(v)
                s = float(q @ v / n) if n else 0.0
            if threshold is None or s >= threshold:
                found.append((-s, i))
        out[f"q{qi:02d}"] = [i for _, i in sorted(found)[:k]]
    return out


def ids(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
@pytest.mark.parametrize("k", [1, 10, 150])
def test_exact(data, metric, k):
    q, s, queries, store = data
    assert ids(search(q, s, k, metric)) == brute(queries, store, metric, k=k)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_query_blocks_equal_one_scan(data, metric):
    q, s, queries, store = data
    assert ids(search(q, s, 10, metric, max_queries=4)) == brute(queries, store, metric)
    assert ids(search(q, s, 10, metric, max_components=40, max_queries=5)) == brute(queries, store, metric)


def test_blocks_with_any_payload(data):
    q, s, queries, store = data
    # Results of blocks are told apart by folders, which must not add or hide columns.
    rows = search(q, s.select("id", "embedding", F.lit("x").alias("block"), F.lit(7).alias("_home")), 3, max_queries=3).collect()
    assert {(r["block"], r["_home"]) for r in rows} == {("x", 7)} and len(rows) == 3 * len(ids(search(q, s, 3)))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_few_slices_are_ordered_as_a_whole(metric, monkeypatch):
    import pyarrow as pa

    from vecweave.plans import topk

    rng = np.random.default_rng(5)
    rows, asked = np.round(rng.standard_normal((6000, 8)), 1), rng.standard_normal((50, 8))
    rows[3000:3100] = rows[:100]
    done = {"partition": 0, "lexsort": 0}

    def counted(name, f):
        def run(*a, **b):
            done[name] += 1
            return f(*a, **b)

        monkeypatch.setattr(topk.np, name, run)

    counted("partition", np.partition)
    counted("lexsort", np.lexsort)
    monkeypatch.setattr(topk, "MAX_SLICE_SCORES", 50 * 50)
    best = topk.LocalTopK(asked, 5, metric, None, "id", "embedding")
    table = pa.table({"id": pa.array(range(6000)), "embedding": pa.array(rows.tolist(), pa.list_(pa.float64()))})
    for batch in table.to_batches(max_chunksize=1000):
        best.feed(batch)
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("_score", pa.float64())])
    found = best.result(pa.array(range(50)), schema).to_pydict()
    # 120 slices.
    assert done["partition"] < 30 and done["lexsort"] < 60, done
    for i in range(50):
        x = np.repeat(asked[i : i + 1], 6000, axis=0)
        dot = (rows * x).sum(axis=1)
        score = {"cosine": dot / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((x * x).sum(axis=1))), "euclidean": -np.sqrt(((rows - x) ** 2).sum(axis=1)), "dot_product": dot}[metric]
        want = np.lexsort((np.arange(6000), -topk.significant(score)))[:5]
        assert [j for q, j in zip(found["query_id"], found["id"]) if q == i] == want.tolist()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_copies_go_by_id(spark, metric, monkeypatch):
    from vecweave.plans import topk

    monkeypatch.setattr(topk, "MAX_SLICE_SCORES", 50)
    rng = np.random.default_rng(1)
    names = [f"n{i:04d}" for i in rng.permutation(500)]
    s = spark.createDataFrame([(n, [0.3, 0.7]) for n in names] + [("best", [1.0, 0.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.3, 0.7])], "query_id int, embedding array<double>")
    got = ids(search(q, s.repartition(3), 6, metric))
    assert got == {1: ["best"] + [f"n{i:04d}" for i in range(5)], 2: [f"n{i:04d}" for i in range(6)]}


def test_small_slices(data, monkeypatch):
    from vecweave.plans import topk

    monkeypatch.setattr(topk, "MAX_SLICE_SCORES", 100)
    q, s, queries, store = data
    assert ids(search(q, s.coalesce(1), 10)) == brute(queries, store, "cosine")


def test_threshold_filters_and_more_than_the_store(data):
    q, s, queries, store = data
    assert ids(search(q, s, 10, threshold=0.5)) == {
        n: v for n, v in brute(queries, store, "cosine", threshold=0.5).items() if v
    }
    assert ids(search(q, s, 10, filters={"source": "src1"})) == brute(queries, store, "cosine", lambda i: i % 3 == 1)
    assert ids(search(q, s, 10, filters={"metadata.page": 2})) == brute(queries, store, "cosine", lambda i: i % 4 == 2)
    assert ids(search(q, s, 10000)) == brute(queries, store, "cosine", k=10000)


def test_post_filter_keeps_ranks(data):
    q, s, queries, store = data
    top = brute(queries, store, "cosine", k=10)
    got = search(q, s, 10, filters={"source": "src1"}, filter_mode="post")
    assert ids(got) == {n: [i for i in v if i % 3 == 1] for n, v in top.items() if any(i % 3 == 1 for i in v)}
    assert all(top[r["query_id"]][r["rank"] - 1] == r["id"] for r in got.collect())


def test_pre_filter_reaches_the_scan(data, spark, tmp_path):
    q, s, _, _ = data
    s.write.parquet(f"{tmp_path}/s")
    found = search(q, spark.read.parquet(f"{tmp_path}/s").select("id", "embedding", "source"), filters={"source": "src1"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan and "metadata" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_errors(data):
    q, s, _, _ = data
    for bad in ({"metric": "manhattan"}, {"k": 0}, {"filters": {"colour": 1}}, {"filter_mode": "x"}, {"score_scale": "x"}):
        with pytest.raises(ValueError):
            search(q, s, **bad)
    with pytest.raises(Exception, match="vector lengths differ"):
        search(q, s.withColumn("embedding", F.slice("embedding", 1, 5))).collect()


def test_no_queries(data):
    q, s, _, _ = data
    assert search(q.limit(0), s).count() == 0


def test_shape(data):
    q, s, _, _ = data
    named = s.withColumn("embedding_model", F.lit(None).cast("string"))
    got = search(q, named, 2, score_scale="unit")
    assert got.columns == ["query_id", "rank", "id", "source", "metadata", "embedding_model", "similarity_score", "distance"]
    row = got.first()
    assert row["embedding_model"] == "unknown" and row["similarity_score"] == pytest.approx(1 - row["distance"] / 2)
    nested = nest_matches(got, ["id"]).collect()
    assert len(nested) == 22 and all([m["rank"] for m in r["matches"]] == [1, 2] for r in nested)


def test_ivf_full_probe_is_exact_and_recall(data):
    q, s, queries, store = data
    index = ann.train_ivf(s, lists=8, metric="euclidean")
    listed = ann.assign_lists(s, index)
    assert listed.count() == 600
    exact = search(q, s, metric="euclidean")
    assert ids(ann.ivf_search(q, listed, index, nprobe=8)) == brute(queries, store, "euclidean")
    full = recall_at_k(ann.ivf_search(q, listed, index, nprobe=8), exact)
    assert {r["recall"] for r in full.collect()} == {1.0}
    some = recall_at_k(ann.ivf_search(q, listed, index, nprobe=3), exact).agg(F.avg("recall")).first()[0]
    assert 0.3 < some <= 1.0


def test_ivf_prunes_partitions(data, spark, tmp_path):
    q, s, _, _ = data
    index = ann.train_ivf(s, lists=9)
    assert len(index.tops) == 3 and 6 <= len(index.centroids) <= 9 and index.bounds[-1] == len(index.centroids)
    ann.write_lists(ann.assign_lists(s, index), f"{tmp_path}/ivf")
    listed = spark.read.parquet(f"{tmp_path}/ivf")
    found = ann.ivf_search(q.limit(1), listed, index, nprobe=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan) and "BroadcastNestedLoopJoin" not in plan
    assert found.count() > 0
    # On the written layout, with every list probed, the search is exact.
    assert ids(ann.ivf_search(q, listed, index, nprobe=9)) == ids(search(q, s))


def test_ivf_lists_are_given_or_near(data):
    q, s, queries, store = data
    given = ann.IvfIndex.given(store[:12], "euclidean")
    lists = {r["id"]: r["list_id"] for r in ann.assign_lists(s, given).collect()}
    far = ((store[:, None, :] - store[None, :12, :]) ** 2).sum(axis=2)
    assert all(far[i, c] <= far[i].min() + 1e-9 for i, c in lists.items())
    near = np.argsort(((queries[:, None, :] - store[None, :12, :]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :3]
    home = np.array([lists[i] for i in range(len(store))])
    want = {}
    for n, probe in enumerate(near):
        mine = {i for i in range(len(store)) if home[i] in probe}
        want[f"q{n:02d}"] = brute(queries[n : n + 1], store, "euclidean", keep=mine.__contains__)["q00"]
    got = ids(ann.ivf_search(q, ann.assign_lists(s, given), given, nprobe=3))
    assert got == want
    # In several query blocks, each written before the next is sent.
    assert ids(ann.ivf_search(q, ann.assign_lists(s, given), given, nprobe=3, max_queries=4)) == want


def test_probes_are_chosen_for_recall(spark):
    rng = np.random.default_rng(11)
    spread_out = rng.normal(size=(1500, 16))
    clustered = rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] * 5 + rng.normal(size=(1500, 16)) * 0.3
    probes = []
    for v in (spread_out, clustered):
        s = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, embedding array<double>")
        index = ann.train_ivf(s, lists=36)
        q = s.filter("id % 50 = 1").withColumnRenamed("id", "query_id")
        recall = recall_at_k(ann.ivf_search(q, ann.assign_lists(s, index), index), search(q, s)).agg(F.avg("recall")).first()[0]
        assert recall >= 0.9
        probes.append(index.nprobe)
    assert probes[1] < probes[0] < 36


def test_k_means_of_few_and_equal_rows():
    assert len(ann.k_means(np.ones((50, 3)), 4)) == 1
    rows = np.repeat(np.eye(3), 20, axis=0)[np.random.default_rng(0).permutation(60)]
    assert sorted(map(tuple, ann.k_means(rows, 3).round(6).tolist())) == sorted(map(tuple, np.eye(3).tolist()))


def test_lsh_finds_copies_and_close_vectors(data):
    q, s, queries, store = data
    model = ann.train_lsh(s, bucket_length=1.0, tables=6)
    got = ids(ann.lsh_search(q, s, model))
    assert got["q20"] == list(range(100, 110))
    assert got["q21"][0] == 7
    recall = recall_at_k(ann.lsh_search(q, s, model), search(q, s)).agg(F.avg("recall")).first()[0]
    assert recall > 0.5


def test_hybrid(spark):
    store = spark.createDataFrame([(i, [1.0, float(i)], "Cat" if i % 2 else "dog") for i in range(30)], "id int, embedding array<double>, content string")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    got = hybrid_search(q, store, ["CAT"])
    assert ids(got)["q"] == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 11))


def test_neighbours_stop_at_both_ends(spark):
    chunks = spark.createDataFrame([("a", i, f"a{i}") for i in range(5)] + [("b", 0, "b0")], "source string, chunk_index int, content string")
    hits = spark.createDataFrame([("q", 1, "a", 0), ("q", 2, "a", 4), ("q", 3, "b", 0)], "query_id string, rank int, source string, chunk_index int")
    got = {r["rank"]: r["context"] for r in expand_neighbours(hits, chunks, 2).collect()}
    assert got == {1: "a0\na1\na2", 2: "a2\na3\na4", 3: "b0"}
    assert expanded_context(hits, chunks, 1).first()["context"] == "a0\na1\n\n---\n\na3\na4\n\n---\n\nb0"


@pytest.mark.parametrize(("metric", "scale"), [("dot_product", 1e-6), ("euclidean", 1e-10), ("cosine", 1e-9)])
def test_small_scores_rank(spark, metric, scale):
    rng = np.random.default_rng(3)
    store, query = rng.normal(size=(30, 8)) * scale, rng.normal(size=(1, 8)) * scale
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(store)], "id int, embedding array<double>")
    q = spark.createDataFrame([("q00", query[0].tolist())], "query_id string, embedding array<double>")
    assert ids(search(q, s, 5, metric)) == brute(query, store, metric, k=5)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_nonfinite_rows_have_no_hits(spark, metric):
    rng = np.random.default_rng(4)
    store, query = rng.normal(size=(50, 8)), rng.normal(size=(1, 8))
    store[:20, 3] = [np.nan, np.inf, -np.inf, np.nan] * 5
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(store)], "id int, embedding array<double>")
    q = spark.createDataFrame([("q00", query[0].tolist()), ("bad", [float("nan")] * 8)], "query_id string, embedding array<double>")
    assert ids(search(q, s, 10, metric)) == brute(query, store, metric, keep=lambda i: i >= 20)
    with pytest.raises(Exception, match="not finite"):
        search(q, s, 10, metric, nonfinite="error").collect()
