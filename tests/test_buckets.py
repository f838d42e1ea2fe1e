from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from vecweave.operators.buckets import BucketedVectors

COLUMNS = "id string, content string, source string, embedding array<double>, seq int"


def rows(spark, *data):
    return spark.createDataFrame([(i, c, "s", v, n) for i, c, v, n in data], COLUMNS)


def contents(store):
    return sorted((r["id"], r["content"]) for r in store.read().collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def folders(paths):
    return {os.path.dirname(p) for p in paths}


@pytest.fixture
def store(spark, tmp_path):
    return BucketedVectors(spark, f"{tmp_path}/v", 8)


def many(spark, n=60):
    return rows(spark, *[(f"id{i}", f"c{i}", [float(i), 1.0], 0) for i in range(n)])


def test_one_changed_id_rewrites_one_bucket(spark, store, tmp_path):
    assert store.upsert(many(spark)) == 8
    before = files(tmp_path)
    assert store.upsert(rows(spark, ("id7", "new", [9.0, 9.0], 0), ("id7", "newer", [8.0, 8.0], 1)), [F.col("seq")]) == 1
    after = files(tmp_path)
    assert len(folders(before - after)) == 1 and folders(before - after) == folders(after - before)
    assert contents(store) == sorted([(f"id{i}", f"c{i}") for i in range(60) if i != 7] + [("id7", "newer")])
    assert store.read().filter("id = 'id7'").first()["embedding"] == [8.0, 8.0]


def test_delete_touches_what_it_removes(spark, store, tmp_path):
    store.upsert(many(spark))
    before = files(tmp_path)
    assert store.delete(spark.createDataFrame([("nobody",)], "id string")) is False and files(tmp_path) == before
    assert store.delete(spark.createDataFrame([("id3",), ("id3",), ("nobody",)], "id string")) is True
    assert len(folders(before - files(tmp_path))) == 1 and len(contents(store)) == 59
    # A bucket that is emptied goes.
    assert store.delete(store.read().select("id")) is True
    assert contents(store) == [] and files(tmp_path) == set()
    assert store.upsert(rows(spark, ("a", "x", [1.0], 0))) == 1 and contents(store) == [("a", "x")]


def test_lookups_and_statistics_read_little(spark, store):
    store.append(many(spark))
    store.append(rows(spark, ("id5", "copy", [1.0, 2.0], 0), ("none", "no vector", None, 0)))
    assert sorted(r["content"] for r in store.rows_of(spark.createDataFrame([("id5",), ("id6",)], "id string")).collect()) == ["c5", "c6", "copy"]
    plan = store.rows_of(spark.createDataFrame([("id5",)], "id string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    stats = store.stats()
    assert "embedding" not in stats._jdf.queryExecution().executedPlan().toString()
    assert stats.first()["document_count"] == 61 and stats.first()["dimension"] == 2


def test_columns_may_differ_and_empty_input(spark, store, tmp_path):
    assert store.read().count() == 0 and store.stats().first()["document_count"] == 0
    assert store.upsert(many(spark, 0)) == 0 and store.delete(spark.createDataFrame([], "id string")) is False
    store.upsert(many(spark, 20))
    store.upsert(rows(spark, ("id2", "wide", [1.0, 1.0], 0)).withColumn("page", F.lit(3)))
    got = {r["id"]: r["page"] for r in store.read().collect()}
    assert got["id2"] == 3 and got["id1"] is None and len(got) == 20
    with pytest.raises(ValueError, match="other buckets"):
        BucketedVectors(spark, f"{tmp_path}/v", 16)


def test_incoming_rows_are_computed_once(spark, store):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    store.upsert(many(spark, 10))
    incoming = rows(spark, ("id1", "2", [1.0], 0), ("b", "2", [1.0], 0))
    store.upsert(incoming.mapInArrow(count, incoming.schema))
    assert seen.value == 2 and len(contents(store)) == 11
