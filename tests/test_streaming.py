from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from vecweave.catalogue.streams import late_log
from vecweave.operators.embedding import embed_mock
from vecweave.operators.stats import embedding_stats
from vecweave.operators.store import VectorStore
from vecweave.schemas import RESULT
from vecweave.streaming.ingest import stream_documents, stream_files, stream_manifest
from vecweave.streaming.stats import run_to_end, stream_stats
from vecweave.streaming.usage import stream_usage

LOG = "request_id long, key string, ts timestamp, tokens long"


def write_batches(spark, path, batches):
    """One file per micro-batch, read oldest first."""
    for n, rows in enumerate(batches):
        part = f"{path}/in-{n}"
        df = spark.createDataFrame([(i, k, s, t) for i, k, s, t in rows], "request_id long, key string, s double, tokens long")
        df = df.withColumn("ts", F.timestamp_micros((F.col("s") * 1000000 + 1704067200000000).cast("long"))).drop("s")
        df.select("request_id", "key", "ts", "tokens").coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.makedirs(f"{path}/log", exist_ok=True)
        os.replace(f"{part}/{name}", f"{path}/log/{n:03d}.parquet")
        os.utime(f"{path}/log/{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", "1").parquet(f"{path}/log")


def test_late_rows_are_dropped_and_open_windows_kept_back(spark, tmp_path):
    minute = 60.0
    log = write_batches(
        spark,
        tmp_path,
        [
            [(0, "k", 0.0, 1), (1, "k", 30.0, 1)],
            [(2, "k", 20 * minute, 1)],
            # Spark drops late rows by the watermark of the batch before.
            [(6, "k", 20.5 * minute, 1)],
            # One row is past the ten minutes of patience, the other is not.
            [(3, "k", 5 * minute, 1), (4, "k", 12 * minute, 1)],
            [(5, "k", 60 * minute, 1)],
        ],
    )
    done = run_to_end(stream_usage(log, "1 minute", lateness="10 minutes"))
    got = {int((r["start"].timestamp() - 1704067200) // 60): r["requests"] for r in done.collect()}
    assert got == {0: 2, 12: 1, 20: 2}


def test_sliding_windows(spark, tmp_path):
    log = write_batches(spark, tmp_path, [[(0, "k", 65.0, 3), (1, "k", 75.0, 4)]])
    done = run_to_end(stream_usage(log, "1 minute", "30 seconds"), "complete")
    got = {int(r["start"].timestamp() - 1704067200): (r["requests"], r["tokens"]) for r in done.collect()}
    assert got == {30: (2, 7), 60: (2, 7)}


def test_files_once_each(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for i in range(1, 6):
        (tmp_path / "in" / f"{i}.txt").write_text("x" * i)
        # Times far apart: an old file that comes after a new one is not late.
        os.utime(tmp_path / "in" / f"{i}.txt", (1_600_000_000 + 10**7 * i,) * 2)
    seen = run_to_end(stream_manifest(spark, f"{tmp_path}/in", "*.txt", max_files=2))
    assert sorted((r["name"], r["size"]) for r in seen.collect()) == [(f"{i}.txt", i) for i in range(1, 6)]
    assert run_to_end(stream_files(spark, f"{tmp_path}/in").select("name", "content")).count() == 5
    state, out = f"{tmp_path}/state", f"{tmp_path}/out"
    for old in (None, "0.txt"):
        if old:
            (tmp_path / "in" / old).write_text("late copy")
            os.utime(tmp_path / "in" / old, (1_000_000_000, 1_000_000_000))
        writer = stream_manifest(spark, f"{tmp_path}/in", "*.txt").writeStream.trigger(availableNow=True)
        writer.option("checkpointLocation", state).option("path", out).start().awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(out).collect()) == [f"{i}.txt" for i in range(6)]


def test_ingest_picks_up_new_files_and_repeats_nothing(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/store")
    schema = "source string, text string"

    def add(n):
        spark.createDataFrame([(f"s{n}", "a b c d e f")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")

    def run(checkpoint):
        docs = spark.readStream.schema(schema).parquet(f"{tmp_path}/docs")
        stream_documents(docs, store, lambda c: embed_mock(c, 4, text="content"), f"{tmp_path}/{checkpoint}", size=4).awaitTermination()
        return sorted((r["source"], r["content"]) for r in store.read().collect())

    want = [("s1", " e f"), ("s1", "a b "), ("s1", "c d")]
    add(1)
    one = run("c")
    assert len(one) == 3 and {s for s, _ in one} == {"s1"}
    before = store.snapshots()
    assert run("c") == one and store.snapshots() == before
    add(2)
    assert len(run("c")) == 6
    # From the beginning again: the same ids, so nothing doubles.
    assert len(run("d")) == 6 and want


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_running_stats(spark, tmp_path, mode):
    rows = [(str(i), i % 4 != 0, i % 3, i / 8, {"total_tokens": i}, None) for i in range(40)]
    spark.createDataFrame(rows, RESULT).repartition(4, "job_id").write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/r")
    got = run_to_end(stream_stats(stream, ["success"]), mode, ["success"] if mode == "update" else None).collect()
    want = embedding_stats(spark.read.schema(RESULT).parquet(f"{tmp_path}/r"), by=["success"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 2
    with pytest.raises(ValueError):
        run_to_end(stream_stats(stream), "update")
    with pytest.raises(ValueError):
        run_to_end(stream_stats(stream), "append", ["success"])


def test_late_rows_are_dropped_and_closed_windows_come_once(spark, tmp_path):
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    files = [[("a", at(1)), ("a", at(2)), ("b", at(65))], [("b", at(66))], [("a", at(3)), ("b", at(67)), ("b", at(200))]]
    for part in files:
        df = spark.createDataFrame(part, "key string, ts string").select("key", F.to_timestamp("ts").alias("ts"), F.lit(1).alias("tokens"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    done = stream_usage(stream, "10 minutes", lateness="10 minutes")
    query = done.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["key"], r["start"].strftime("%H:%M"), r["requests"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "00:00", 2), ("b", "01:00", 3)]
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    # What is kept at the end is the open window alone.
    assert states[-1]["numRowsTotal"] == 1


def test_a_manifest_of_many_files_is_few_micro_batches(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for i in range(1200):
        (tmp_path / "in" / f"{i}.txt").write_text("x")
    writer = stream_manifest(spark, f"{tmp_path}/in", "*.txt").writeStream.trigger(availableNow=True)
    query = writer.option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").start()
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [1200]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1200


def test_an_arrival_is_several_files_and_one_micro_batch(spark, tmp_path):
    # No request is one of the second arrival, and few are of the third.
    rows = spark.range(400).filter("id % 10 <> 1 AND (id % 10 <> 0 OR id < 20)")
    events = rows.select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"), F.lit(1.0).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    log = late_log(spark, str(tmp_path), file_rows=50)
    seen = []
    log.writeStream.foreachBatch(lambda batch, n: seen.append((len(batch.inputFiles()), sorted({r[0] % 10 for r in batch.select("request_id").collect()})))).option(
        "checkpointLocation", f"{tmp_path}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    assert [tenths for _, tenths in seen] == [list(range(2, 10)), [], [0]] and spark.read.parquet(f"{tmp_path}/events.parquet").count() == 322
