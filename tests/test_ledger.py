from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vecweave.operators import ledger as L
from vecweave.schemas import LEDGER, TRANSITION

NOW = "2024-01-01 12:00:00"


def log(spark, *rows):
    """Rows of (file, minute, status)."""
    data = [(f, i, m, "w1", s, "boom" if s == "failed" else None) for i, (f, m, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "fingerprint string, seq bigint, m int, instance_id string, status string, error_message string")
    return df.select("fingerprint", "seq", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins="m")).alias("ts"), "instance_id", "status", "error_message")


def now():
    return F.lit(NOW).cast("timestamp")


def verdicts(spark, ledger, names, **options):
    manifest = spark.createDataFrame([(n,) for n in names], "fingerprint string")
    rows = L.pending_verdict(manifest, ledger, now(), "me", **options).collect()
    return {r["fingerprint"]: (r["can_process"], r["reason"]) for r in rows}


FOUR_FAILURES = [("f", i, s) for i, s in enumerate(["processing", "failed"] * 4)]


@pytest.mark.parametrize("max_rows", [1, 1000])
def test_four_failures(spark, max_rows):
    history = L.ledger_history(log(spark, *FOUR_FAILURES), block_seconds=60, max_rows=max_rows)
    assert [r["retry_count"] for r in history.orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_pending_after_each_failure(spark):
    allowed = []
    for n in (2, 4, 6, 8):
        state = L.ledger_state(log(spark, *FOUR_FAILURES[:n]))
        allowed.append(verdicts(spark, state, ["f"])["f"][0])
    assert allowed == [True, True, True, False]


def test_reset_makes_a_file_new(spark):
    transitions = log(spark, *FOUR_FAILURES, ("g", 1, "processing"), ("g", 2, "completed"))
    state = L.ledger_state(transitions)
    assert verdicts(spark, L.reset_failed(state), ["f", "g"]) == {"f": (True, "new"), "g": (False, "completed")}
    assert L.reset_failed_transitions(transitions).select("fingerprint").distinct().collect()[0][0] == "g"


def plain_history(rows):
    """The state machine as a loop."""
    state, out = {}, {}
    for i, (f, _, s) in enumerate(rows):
        last, count = state.get(f, (None, 0))
        if s == "processing":
            count = count + 1 if last == "failed" else 0
        state[f] = (s, count)
        out[i] = count
    return out


@pytest.mark.parametrize("max_rows", [1, 25, 10**6])
def test_history_against_a_loop(spark, max_rows):
    rnd = random.Random(3)
    names = ["hot"] * 6 + ["a", "b", "c"]
    rows = sorted([(rnd.choice(names), rnd.randrange(300), rnd.choice(["processing", "failed", "completed"])) for _ in range(400)], key=lambda r: r[1])
    history = L.ledger_history(log(spark, *rows), block_seconds=600, max_rows=max_rows)
    want = plain_history(rows)
    # A file that was never started has no count to add to.
    assert {r["seq"]: r["retry_count"] for r in history.collect()} == want


def test_more_large_keys_than_are_listed(spark, monkeypatch):
    from vecweave.plans import blocks

    rows = sorted([(f"f{i % 7}", i, ["processing", "failed", "completed"][i * i % 3]) for i in range(200)], key=lambda r: r[1])
    want = plain_history(rows)
    monkeypatch.setattr(blocks, "MAX_HOT_KEYS", 2)
    history = L.ledger_history(log(spark, *rows), block_seconds=600, max_rows=5)
    assert {r["seq"]: r["retry_count"] for r in history.collect()} == want


def test_null_keys_stay(spark):
    df = log(spark, *FOUR_FAILURES).withColumn("fingerprint", F.lit(None).cast("string"))
    for max_rows in (1, 1000):
        history = L.ledger_history(df, block_seconds=60, max_rows=max_rows)
        assert sorted(r["retry_count"] for r in history.collect()) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_verdicts(spark):
    def entry(f, status, owner, started, retries=0):
        return (f, status, owner, started, None, None, retries)

    rows = [
        entry("done", "completed", "other", "2024-01-01 00:00:00"),
        entry("busy", "processing", "other", "2024-01-01 11:00:01"),
        entry("stale", "processing", "other", "2024-01-01 11:00:00"),
        entry("mine", "processing", "me", "2024-01-01 11:59:00"),
        entry("retry", "failed", "other", "2024-01-01 00:00:00", 2),
        entry("spent", "failed", "other", "2024-01-01 00:00:00", 3),
    ]
    ledger = spark.createDataFrame(rows, LEDGER.replace("timestamp", "string")).withColumn("started_at", F.col("started_at").cast("timestamp"))
    got = verdicts(spark, ledger, [r[0] for r in rows] + ["unseen"])
    assert {k: v[0] for k, v in got.items()} == {
        "done": False, "busy": False, "stale": True, "mine": True, "retry": True, "spent": False, "unseen": True
    }
    manifest = spark.createDataFrame([("done",), ("unseen",)], "fingerprint string")
    assert [r[0] for r in L.pending(manifest, ledger, now(), "me").collect()] == ["unseen"]
    assert [r[0] for r in L.completed_files(manifest, ledger).collect()] == ["done"]
    assert L.ledger_summary(ledger).first().asDict() == {"total": 6, "processing": 3, "completed": 1, "failed": 2}


def test_fingerprint(spark):
    df = spark.createDataFrame([("/a", 5)], "p string, n int").withColumn("t", now())
    f = L.fingerprint(F.col("p"), F.col("t"), F.col("n"))
    a, b = df.select(f).first()[0], df.withColumn("n", F.lit(6)).select(f).first()[0]
    assert len(a) == 16 and a == df.select(f).first()[0] and a != b
    assert len(df.select(L.content_fingerprint(F.col("p"))).first()[0]) == 16


def test_outcomes_become_transitions(spark):
    outcomes = spark.createDataFrame([("a", None), ("b", "bad")], "fingerprint string, error string")
    t = L.outcome_transitions(outcomes, "w", now(), now())
    assert set(t.columns) == set(c.split()[0] for c in TRANSITION.split(", "))
    state = {r["fingerprint"]: r for r in L.ledger_state(t).collect()}
    assert state["a"]["status"] == "completed" and state["b"]["status"] == "failed" and state["b"]["error_message"] == "bad"
