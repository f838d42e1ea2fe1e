from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from vecweave.operators import stats as T
from vecweave.operators.prompts import assemble_context, history_window, render_prompt
from vecweave.schemas import RESULT


def test_values_are_not_read_as_variables(spark):
    df = spark.createDataFrame([("see {metadata} and {x}", {"type": "pdf", "b": "2"})], "content string, metadata map<string,string>")
    got = render_prompt(df, "[{document_type}] {content} / {metadata} / {x}", {"x": "{content}"}).first()["prompt"]
    assert got == '[pdf] see {metadata} and {x} / {"b":"2","type":"pdf"} / {content}'
    assert render_prompt(df, "plain").first()["prompt"] == "plain"
    with pytest.raises(ValueError, match="{nobody}"):
        render_prompt(df, "{nobody}")


def test_context(spark):
    results = spark.createDataFrame([("q", 2, "second"), ("q", 1, "first")], "query_id string, rank int, content string")
    questions = spark.createDataFrame([("q", "why?"), ("r", "what?")], "query_id string, question string")
    got = {r["query_id"]: r["prompt"] for r in assemble_context(results, questions).collect()}
    assert got["q"] == "Context:\nfirst\n\nsecond\n\nQuestion: why?\nAnswer:"
    assert got["r"] == "Context:\n\n\nQuestion: what?\nAnswer:"
    asked = questions.withColumn("history", F.lit("user: hi"))
    chat = assemble_context(results, asked, "\n", "{context}|{history}|{question}", prefix="Document: ")
    assert chat.filter("query_id = 'q'").first()["prompt"] == "Document: first\nDocument: second|user: hi|why?"


@pytest.mark.parametrize("max_rows", [1, 5, 10**6])
def test_history(spark, max_rows):
    turns = [("a", t, "user" if t % 2 == 0 else "bot", f"m{t}") for t in list(range(12)) + [40, 41, 90]] + [("b", 3, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["history"] for r in history_window(df, 4, width=5, max_rows=max_rows).collect()}
    assert len(got) == len(turns) and got["b", 3] == ""
    own = [t for t in turns if t[0] == "a"]
    for i, t in enumerate(own):
        assert got["a", t[1]] == "\n".join(f"{r}: {m}" for _, _, r, m in own[max(0, i - 4) : i])


def results(spark, rows):
    return spark.createDataFrame([(str(i), ok, n, s, {"total_tokens": t} if t is not None else {}, None) for i, (ok, n, s, t) in enumerate(rows)], RESULT)


def test_stats(spark):
    got = T.embedding_stats(results(spark, [(True, 2, 1.5, 500), (True, 1, 2.5, 800), (False, 0, 0.5, None)])).first()
    assert (got["embedded_chunks"], got["failed_chunks"], got["total_tokens"]) == (3, 1, 1300)
    assert got["total_processing_time"] == pytest.approx(4.5) and got["average_embedding_time"] == pytest.approx(1.125)


def test_success_rate(spark):
    some = results(spark, [(True, 1, 0.1, 100), (True, 1, 0.1, 200), (True, 1, 0.1, 300), (False, 0, 0.1, None), (False, 0, 0.1, None)])
    got = T.embedding_stats(some, total=5).first()
    assert got["total_tokens"] == 600 and got["success_rate"] == pytest.approx(60.0)
    assert T.embedding_stats(some).first()["success_rate"] == pytest.approx(60.0)
    none = T.embedding_stats(results(spark, [(True, 0, 0.0, 0)]).limit(0)).first()
    assert none["success_rate"] == 0.0 and none["average_embedding_time"] == 0.0 and none["embedded_chunks"] == 0


def test_batches(spark):
    df = spark.createDataFrame([("a", 3), ("b", 4)], "batch_id string, n_chunks int").withColumn("status", F.lit("processing"))
    df = df.withColumn("processed_at", F.lit(None).cast("timestamp")).withColumn("error", F.lit(None).cast("string"))
    failures = spark.createDataFrame([("b", "boom")], "batch_id string, error string")
    got = {r["status"]: r for r in T.batch_status(T.mark_batches(df, failures, F.lit("2024-01-01").cast("timestamp"))).collect()}
    assert got["completed"]["n_chunks"] == 3 and got["failed"]["sample_error"] == "boom" and got["failed"]["last_processed_at"] is not None


def test_run_summary(spark):
    df = spark.createDataFrame([("m", [1.0]), ("m", None), (None, [])], "embedding_model string, embedding array<double>")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = {r["model"]: r for r in T.run_summary(df, at, at + F.expr("interval 90 seconds")).collect()}
    assert got["m"]["chunks_processed"] == 2 and got["m"]["embeddings_generated"] == 1 and got["m"]["seconds"] == 90.0
    assert got["unknown"]["embeddings_generated"] == 0


def test_rows_are_counted_on_the_way(spark):
    seen = Observation("stage")
    assert T.observed_counts(spark.range(7), seen).filter("id < 3").count() == 3
    assert seen.get == {"rows": 7}
