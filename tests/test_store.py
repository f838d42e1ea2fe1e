from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vecweave.operators import store as S
from vecweave.schemas import CHUNK

COLUMNS = "id string, content string, source string, embedding array<double>, seq int"


@pytest.fixture
def store(spark, tmp_path):
    return S.VectorStore(spark, f"{tmp_path}/vectors")


def rows(spark, *data):
    return spark.createDataFrame([(i, c, "s", v, n) for i, c, v, n in data], COLUMNS)


def contents(store):
    return sorted((r["id"], r["content"]) for r in store.read().collect())


def test_append_skips_rows_without_vector_and_keeps_copies(spark, store):
    store.append(rows(spark, ("a", "1", [1.0], 0), ("b", "2", None, 0), ("c", "3", [], 0)))
    store.append(rows(spark, ("a", "1", [1.0], 0)))
    assert contents(store) == [("a", "1"), ("a", "1")]
    assert store.read().first()["vector_id"] == "a"


def test_upsert_replaces_and_the_last_of_a_batch_wins(spark, store):
    store.upsert(rows(spark, ("a", "old", [1.0], 0), ("b", "keep", [1.0], 0)))
    batch = rows(spark, ("a", "x", [1.0], 1), ("a", "y", [2.0], 2), ("c", "new", [1.0], 0), ("d", "no vector", None, 0))
    store.upsert(batch, order=[F.col("seq")])
    want = [("a", "y"), ("b", "keep"), ("c", "new")]
    assert contents(store) == want
    store.upsert(batch, order=[F.col("seq")])
    assert contents(store) == want
    assert store.snapshots() == [1, 2, 3]


def test_delete(spark, store):
    store.append(rows(spark, ("a", "1", [1.0], 0), ("b", "2", [1.0], 0)))
    gone = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert store.delete(gone) is True
    assert contents(store) == [("b", "2")]
    assert store.delete(gone) is False


def test_unfinished_snapshot_is_ignored(spark, store, tmp_path):
    store.append(rows(spark, ("a", "1", [1.0], 0)))
    (tmp_path / "vectors" / "snapshot=2").mkdir()
    assert contents(store) == [("a", "1")]
    store.upsert(rows(spark, ("b", "2", [1.0], 0)))
    assert contents(store) == [("a", "1"), ("b", "2")]


def test_empty_store(spark, store):
    assert store.read().count() == 0
    assert store.stats().first()["document_count"] == 0


def test_vector_id_is_the_key(spark, store):
    df = rows(spark, ("a", "1", [1.0], 0)).withColumn("vector_id", F.lit("v1"))
    store.append(df)
    assert contents(store) == [("v1", "1")]


def test_partitioned_store_prunes(spark, tmp_path):
    store = S.VectorStore(spark, f"{tmp_path}/p", partition_by=["source"])
    store.append(rows(spark, ("a", "1", [1.0], 0)))
    plan = store.read().filter("source = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def test_stats(spark, store):
    store.append(rows(spark, ("a", "1", [1.0, 2.0], 0)).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    got = store.stats().first()
    assert got["document_count"] == 1 and got["dimension"] == 2 and got["size_bytes"] > 0
    assert str(got["earliest"]) == "2024-01-01 00:00:00"


def test_round_trip_and_missing_time(spark):
    df = spark.createDataFrame(
        [("a", "x\ny", "s", {"k": "v"}, None, [0.5], "m", None)], CHUNK
    ).withColumn("created_at", F.lit("2024-01-01 01:02:03.456789").cast("timestamp"))
    assert S.from_records(S.to_records(df)).collect() == df.collect()
    bare = spark.createDataFrame([('{"id":"a","content":"c","source":"s","metadata":{}}',)], "record string")
    assert S.from_records(bare).first()["created_at"] is not None


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    for kind in ("jsonl", "parquet"):
        S.export(df, f"{tmp_path}/{kind}", kind)
    assert spark.read.json(f"{tmp_path}/jsonl").count() == spark.read.parquet(f"{tmp_path}/parquet").count() == 1
    with pytest.raises(ValueError, match="output format"):
        S.export(df, f"{tmp_path}/csv", "csv")


def test_facets(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "x string, y int")
    got = {(r["facet"], r["value"]): r["n"] for r in S.facets(df, ["x", "y"]).collect()}
    assert got == {("x", "a"): 2, ("y", "1"): 1, ("y", "2"): 1}
    with pytest.raises(ValueError):
        S.facets(df, ["z"])


def test_vector_ids(spark):
    df = rows(spark, ("a", "1", [1.0], 0), ("b", "2", None, 0)).withColumn("vector_id", F.lit(None).cast("string"))
    assert [r["vector_id"] for r in S.assign_vector_ids(df).orderBy("id").collect()] == ["vec_a", None]


def test_missing_and_compact(spark, store):
    store.append(rows(spark, ("a", "1", [1.0], 0)))
    store.append(rows(spark, ("b", "1", [1.0], 0)))
    new = store.missing(rows(spark, ("a", "x", [1.0], 0), ("c", "x", [1.0], 0), ("c", "x", [1.0], 1)))
    assert [r["id"] for r in new.collect()] == ["c"]
    store.compact()
    assert contents(store) == [("a", "1"), ("b", "1")] and store.snapshots() == [1, 2]


def test_incoming_rows_are_computed_once(spark, store):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    store.upsert(rows(spark, ("a", "1", [1.0], 0)))
    incoming = rows(spark, ("a", "2", [1.0], 0), ("b", "2", [1.0], 0))
    store.upsert(incoming.mapInPandas(count, incoming.schema))
    assert contents(store) == [("a", "2"), ("b", "2")] and seen.value == 2


def test_columns_of_a_snapshot_agree(spark, store):
    store.append(rows(spark, ("a", "1", [1.0], 0)))
    wider = rows(spark, ("b", "1", [1.0], 0)).withColumn("page", F.lit(3))
    with pytest.raises(ValueError, match="no column page"):
        store.append(wider)
    store.upsert(wider)
    store.append(rows(spark, ("c", "1", [1.0], 0)).drop("seq"))
    got = {r["id"]: (r["page"], r["seq"]) for r in store.read().collect()}
    assert got == {"a": (None, 0), "b": (3, 0), "c": (None, None)}


def test_by_time(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "id string, n int").withColumn("created_at", F.timestamp_seconds("n"))
    assert [r["id"] for r in S.by_time(df).collect()] == ["b", "c", "a"]
    assert [r["id"] for r in S.by_time(df, newest_first=False).collect()] == ["a", "c", "b"]
