from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vecweave.operators import usage as U


def log(spark, rows):
    """Rows of (key, second, tokens, latency)."""
    data = [(i, k, float(s), t, r) for i, (k, s, t, r) in enumerate(rows)]
    df = spark.createDataFrame(data, "request_id int, key string, s double, tokens long, response_time double")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1000000 + 1704067200000000).cast("long"))).drop("s")


def by_id(df):
    return {r["request_id"]: r for r in df.collect()}


def test_third_request_is_over_a_limit_of_two(spark):
    got = by_id(U.trailing_usage(log(spark, [("k", 0, 1, 1.0), ("k", 10, 1, 1.0), ("k", 20, 1, 1.0), ("k", 61, 1, 1.0)]), requests_limit=2))
    assert [got[i]["over_limit"] for i in range(4)] == [False, False, True, True]
    assert [got[i]["wait_seconds"] for i in range(4)] == [0.0, 0.0, 40.0, 9.0]


def test_both_ends_of_the_window(spark):
    got = by_id(U.trailing_usage(log(spark, [("k", 0, 1, 1.0), ("k", 60, 2, 1.0), ("k", 60.000001, 4, 1.0)]), burst_seconds=60, burst_limit=1))
    assert [got[i]["requests_in_window"] for i in range(3)] == [1, 2, 2]
    assert [got[i]["tokens_in_window"] for i in range(3)] == [1, 3, 6]
    # The far end of the burst window is open.
    assert [got[i]["burst_requests"] for i in range(3)] == [1, 1, 2]
    assert [got[i]["over_burst"] for i in range(3)] == [False, False, True]


def random_log(n=500):
    rnd = random.Random(11)
    return [(rnd.choice(["hot", "hot", "hot", "a", "b"]), rnd.randrange(0, 3000) / 4, rnd.randrange(100), rnd.randrange(0, 1600) / 64) for _ in range(n)]


@pytest.mark.parametrize("max_rows", [1, 200, 10**6])
def test_against_loops(spark, max_rows):
    rows = random_log()
    df = log(spark, rows)
    got = by_id(U.trailing_usage(df, 30, tokens_limit=300, max_rows=max_rows))
    short = by_id(U.burst_usage(df, 7, 2, max_rows=max_rows))
    for i, (k, s, _, _) in enumerate(rows):
        inside = [r for r in rows if r[0] == k and s - 30 <= r[1] <= s]
        assert got[i]["requests_in_window"] == len(inside)
        assert got[i]["tokens_in_window"] == sum(r[2] for r in inside)
        assert got[i]["over_limit"] == (sum(r[2] for r in inside) > 300)
        assert short[i]["burst_requests"] == sum(1 for r in rows if r[0] == k and s - 7 < r[1] <= s)


@pytest.mark.parametrize("max_rows", [1, 10**6])
def test_adaptation_against_a_loop(spark, max_rows, monkeypatch):
    monkeypatch.setattr(U, "_HISTORIES_PER_BLOCK", 3)
    rows = random_log()
    got = by_id(U.latency_adaptation(log(spark, rows), history=20, block_seconds=100, max_rows=max_rows))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], i))
    for i, (k, _, _, r) in enumerate(rows):
        past = [rows[j][3] for j in order[: order.index(i) + 1] if rows[j][0] == k][-20:]
        mean = sum(past) / len(past)
        want = mean * 0.7 + r * 0.3 if r else mean
        assert got[i]["smoothed_latency"] == pytest.approx(want)


def test_slow_responses_lower_the_rate(spark):
    got = by_id(U.latency_adaptation(log(spark, [("k", i, 1, 15.0) for i in range(10)]), base_rpm=60))
    assert all(r["suggested_rpm"] == 48 for r in got.values())
    bands = log(spark, [("a", 0, 1, 11.0), ("b", 0, 1, 3.0), ("c", 0, 1, 1.5), ("d", 0, 1, 0.5), ("e", 0, 1, 0.0)])
    assert [r["adjustment"] for _, r in sorted(by_id(U.latency_adaptation(bands)).items())] == [-0.2, -0.1, 0.0, 0.1, 0.1]


def test_report(spark):
    df = log(spark, [("k", 0, 5, 1.0), ("k", 1, 5, 3.0), ("k", 100, 7, 2.0), ("j", 0, 1, 1.0)])
    now = F.timestamp_seconds(F.lit(1704067200 + 120))
    got = {r["key"]: r for r in U.usage_report(df, now, requests_limit=1).collect()}
    assert got["k"].asDict() == {
        "key": "k", "total_requests": 3, "total_tokens": 17, "limit_hits": 1, "mean_latency": 2.0,
        "requests_in_last_window": 1, "tokens_in_last_window": 7,
    }
    assert got["j"]["requests_in_last_window"] == 0 and got["j"]["tokens_in_last_window"] == 0


def test_quota(spark):
    df = log(spark, [("k", i / 10, 1000, 1.0) for i in range(100)])
    got = {r["preset"]: r for r in U.quota_fit(df).collect()}
    assert len(got) == 13
    assert not got["conservative"]["fits"] and got["balanced"]["fits"] and not got["balanced"]["fits_burst"]
    assert got["local_providers"]["fits"] and got["local_providers"]["fits_burst"]


def test_counts_are_one_pass(spark):
    """Twice the requests of one caller in one minute must not take four times as long."""
    import time

    def took(n):
        df = spark.range(n).select(
            F.col("id").cast("int").alias("request_id"), F.lit("k").alias("key"), F.timestamp_micros(F.col("id") * 50).alias("ts"),
            F.lit(1).cast("bigint").alias("tokens"), F.lit(1.0).alias("response_time"),
        )
        start = time.perf_counter()
        top = U.trailing_usage(df, 60).agg(F.max("requests_in_window")).first()[0]
        assert top == n
        return time.perf_counter() - start

    took(20_000)
    assert took(400_000) < 4 * took(200_000)
