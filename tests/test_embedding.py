from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vecweave.catalog import MODELS, model_catalog, quota_presets
from vecweave.catalogue import embeds
from vecweave.operators import embedding as E

TEXTS = ["The quick brown fox.", "Größe, Größe und größe!", "", "   ", "x y z 1 2 3", "The quick brown fox."]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_mock_is_deterministic_and_bounded(frame):
    a, b = by_id(E.embed_mock(frame, 16)), by_id(E.embed_mock(frame.repartition(3), 16))
    assert {k: v["embedding"] for k, v in a.items()} == {k: v["embedding"] for k, v in b.items()}
    assert all(len(r["embedding"]) == 16 and all(-1 <= x < 1 for x in r["embedding"]) for r in a.values())
    assert a[0]["embedding"] == a[5]["embedding"] != a[1]["embedding"]


def test_hashing_unit_length_and_null_without_tokens(frame):
    got = by_id(E.embed_hashing(frame, 32))
    assert got[2]["embedding"] is None and got[3]["embedding"] is None
    for i in (0, 1, 4):
        assert sum(x * x for x in got[i]["embedding"]) == pytest.approx(1.0)
    assert got[0]["embedding"] == got[5]["embedding"]


@pytest.mark.parametrize("name, native", [("mock", E.embed_mock), ("hashing", E.embed_hashing)])
def test_providers_agree_with_the_columns(frame, name, native):
    want = by_id(native(frame, dim=16))
    got = by_id(E.embed_with(frame, name, "m", batch_size=2, dim=16))
    for i in range(len(TEXTS)):
        if want[i]["embedding"] is None:
            assert got[i]["status"] == "failed" and got[i]["embedding"] is None
        else:
            assert got[i]["embedding"] == pytest.approx(want[i]["embedding"], abs=1e-6)


def test_order_and_batches_are_kept(spark):
    sizes = []

    def factory(model):
        def embed(texts):
            assert len(texts) <= 7
            return [[float(t)] for t in texts]

        return embed

    E.register_provider("echo", factory)
    df = spark.createDataFrame([(i, str(i)) for i in range(100)], "id int, text string").coalesce(1)
    rows = E.embed_with(df, "echo", "m", batch_size=50, max_batch_size=7).collect()
    assert [r["id"] for r in rows] == list(range(100)) and not sizes
    assert all(r["embedding"] == [float(r["id"])] and r["status"] == "completed" and r["attempts"] == 1 for r in rows)


def test_failures_stay_in_their_rows(spark):
    def factory(model):
        def embed(texts):
            if "bad" in texts:
                raise RuntimeError("refused")
            return [[1.0]] * len(texts)

        return embed

    E.register_provider("picky", factory)
    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "b"), (3, None)], "id int, text string").coalesce(1)
    got = by_id(E.embed_with(df, "picky", "m"))
    assert [got[i]["status"] for i in range(4)] == ["completed", "failed", "completed", "failed"]
    assert got[1]["embedding"] is None and got[1]["error"] == "refused" and got[1]["attempts"] == 2
    assert got[3]["error"] == "text is null"
    assert E.failed_rows(E.embed_with(df, "picky", "m")).count() == 2
    with pytest.raises(Exception, match="refused"):
        E.embed_with(df, "picky", "m", on_error="raise").collect()


def test_short_answers_are_failures(spark):
    E.register_provider("short", lambda model: lambda texts: [])
    df = spark.createDataFrame([(0, "a")], "id int, text string")
    assert "0 vectors for 1 texts" in E.embed_with(df, "short", "m").first()["error"]


def test_unknown_provider(frame):
    with pytest.raises(ValueError, match="unknown provider"):
        E.embed_with(frame, "nobody", "m")
    with pytest.raises(TypeError):
        E.register_provider("x", "not callable")


def test_validation(spark):
    long = "word " * 500
    df = spark.createDataFrame(
        [(0, "fine", "cohere.embed-english-v3"), (1, None, "x"), (2, " \n", "x"), (3, long, "cohere.embed-english-v3"), (4, long, "x")],
        "id int, text string, model string",
    )
    got = by_id(E.validate_inputs(df))
    assert [got[i]["valid"] for i in range(5)] == [True, False, False, False, True]
    assert got[1]["is_null"] and got[2]["is_blank"] and got[3]["too_long"] and got[4]["max_input_tokens"] == 8192


def test_batches_cover_every_row_once(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(1000)], "id int, text string")
    plan = E.plan_batches(df, 30, buckets=4).collect()
    assert sum(r["n_chunks"] for r in plan) == 1000 and max(r["n_chunks"] for r in plan) == 30
    assert sum(r["n_chunks"] < 30 for r in plan) <= 4
    assert all(r["status"] == "pending" for r in plan)
    assert max(r["n_chunks"] for r in E.plan_batches(df, 30, buckets=4, max_batch_size=9).collect()) == 9


def test_cache_embeds_each_text_once(spark):
    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(50)], "id int, text string")
    first = E.embed_cached(df, None, lambda d: E.embed_mock(d, 4))
    assert first.count() == 50 and first.filter("cache_hit").count() == 0
    cache = E.cache_entries(first)
    assert cache.count() == 5
    more = spark.createDataFrame([(0, "t1"), (1, "new"), (2, "t1")], "id int, text string")
    got = by_id(E.embed_cached(more, cache, lambda d: E.embed_mock(d, 4)))
    assert [got[i]["cache_hit"] for i in range(3)] == [True, False, True]
    want = by_id(E.embed_mock(more, 4))
    assert all(got[i]["embedding"] == want[i]["embedding"] for i in range(3))


def test_salted_join_keeps_every_row(spark):
    from vecweave.plans.skew import salted_join

    left = spark.range(2000).select("id", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 7).alias("k"))
    right = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k long, v string")
    want = left.join(right, "k", "left")
    got = salted_join(left, right, "k", F.col("id"), rows_per_salt=100)
    assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()
    plain = salted_join(left, right, "k", F.col("id"))
    assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, want.select("id", "k", "v").collect()))


def test_cost(spark):
    df = spark.createDataFrame([("a b c d", "text-embedding-3-small"), ("a", "other")], "text string, model string")
    got = {r["model"]: r for r in E.embedding_usage(df, []).collect()}
    assert got["text-embedding-3-small"]["tokens"] == 5
    assert got["text-embedding-3-small"]["cost"] == pytest.approx(5 * 0.00002 / 1000)
    assert got["other"]["cost"] == 0.0


def test_dimensions(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, None)], "id int, embedding array<double>")
    assert [(r["id"], r["dimensions"]) for r in E.check_dimensions(df, 1).collect()] == [(1, 2)]


def test_catalogs(spark):
    models = {r["model"]: r for r in model_catalog(spark).collect()}
    assert len(models) == len(MODELS) and models["text-embedding-3-large"]["dimensions"] == 3072
    assert models["amazon.titan-embed-text-v1"]["supports_batch"] is False
    assert quota_presets(spark).count() == 13


def test_python_vectors_are_made_once(frame):
    """A filter on the vector must not run the function a second time."""
    plan = E.embed_hashing(frame, 8).filter(F.size("embedding") > 0).select(F.posexplode("embedding"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 1


def test_a_provider_is_asked_once_whatever_is_read(spark):
    asked = spark.sparkContext.accumulator(0)

    class Client:
        def __call__(self, texts):
            asked.add(len(texts))
            return [[float(len(t))] for t in texts]

    E.register_provider("asked", lambda model: Client())
    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(40)] + [(99, None)], "id int, text string")
    done = E.embed_cached(df, None, lambda d: E.embed_with(d, "asked", "m"))
    assert done.count() == 41 and done.filter("embedding IS NULL").count() == 1
    cache = E.cache_entries(done)
    assert cache.count() == 5 and asked.value == 5
    more = E.embed_cached(df.union(spark.createDataFrame([(100, "new")], df.schema)), cache, lambda d: E.embed_with(d, "asked", "m"))
    assert more.filter("cache_hit").count() == 40 and E.cache_entries(more).count() == 1 and asked.value == 6


def test_accounting_of_calls(spark):
    def provider(model):
        def embed(texts):
            if "bad" in texts:
                raise ValueError("no")
            return E.Embedded([[1.0]] * len(texts), {"total_tokens": 7 * len(texts)}) if model == "reports" else [[1.0]] * len(texts)

        return embed

    E.register_provider("told", provider)
    rows = [(i, "bad" if i == 3 else "two words", {"k": "v"}, [i]) for i in range(10)] + [(10, None, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, meta map<string,string>, error array<int>").coalesce(1)
    vectors, calls = E.embed_accounted(df, "told", "reports", 5)
    got = {r["id"]: r for r in vectors.collect()}
    assert len(got) == 11 and got[3]["status"] == got[10]["status"] == "failed" and got[4]["meta"] == {"k": "v"} and got[4]["error"] is None
    done = sorted((r["success"], r["n_embedded"], (r["token_usage"] or {}).get("total_tokens"), r["error"]) for r in calls.collect())
    assert done == [(False, 0, None, "no")] + [(True, 1, 7, None)] * 4 + [(True, 5, 35, None)]
    assert calls.select("job_id").distinct().count() == 6 and calls.filter("processing_time >= 0").count() == 6
    # Without a report, from words: 2 * 1.3, whole.
    assert {r["token_usage"]["total_tokens"] for r in E.embed_accounted(df.filter("id < 3"), "told", "m", 1)[1].collect()} == {2}


def test_the_catalogue_caps_batches(spark):
    df = spark.createDataFrame([(i, "x") for i in range(130)], "id int, text string").coalesce(1)
    sizes = lambda model, **o: sorted(r["n_embedded"] for r in E.embed_accounted(df, "mock", model, 100, **o)[1].collect())
    assert sizes("llamacpp/default") == [30, 50, 50] and sizes("unknown") == [30, 100]
    assert sizes("llamacpp/default", max_batch_size=60) == [10, 60, 60]
    with pytest.raises(ValueError):
        E.embed_with(df, "mock", "m", 0)


def test_more_text_is_sorted_by_more_tasks(spark, tmp_path, monkeypatch):
    texts = [(i, "x" * (i % 90 + 1)) for i in range(2000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tasks = []
    accounted = E.embed_accounted
    monkeypatch.setattr(E, "embed_accounted", lambda df, *a, **o: tasks.append(df.rdd.getNumPartitions()) or accounted(df, *a, **o))
    monkeypatch.setattr(embeds, "SORTED_BYTES", 20_000)
    told = embeds.embed_accounting(spark, str(tmp_path)).first()
    total = sum(len(t) for _, t in texts)
    assert tasks == [-(-total // 20_000)] and (told["total_chunks"], told["n_vectors"], told["total_tokens"], told["largest_call"]) == (2000, 2000, total, 50)
