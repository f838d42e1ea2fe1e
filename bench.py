"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores. Each query runs
once to warm up and then ``RUNS`` times, the best of which counts. The SQL twins are timed as
well, on as many threads, unless ``--no-duckdb`` is given; ``--all`` takes every query.

"""

from __future__ import annotations

import json
import os
import sys
import time

from vecweave.catalogue import ORACLES, QUERIES
from vecweave.session import local_session

RUNS = 3
HEADLINE = [
    "cosine_topk",
    "l2_topk",
    "document_search",
    "hybrid_search",
    "neighbor_context",
    "rag_context",
    "chunk_fixed",
    "chunk_sentence",
    "chunk_semantic",
    "chunk_stats",
    "hashing_embedding",
    "embed_provider",
    "embed_cache_hits",
    "token_cost",
    "plan_batches",
    "ledger_state",
    "trailing_usage",
    "latency_adaptation",
    "quota_fit",
    "embedding_stats",
    "history_window",
    "split_by_bytes",
    "store_upsert",
    "extract_mixed",
    "stream_tumbling",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    spark = local_session(cpus, "16g")
    # Start the JVM paths and the Python workers once before the clock runs.
    for name in ("chunk_fixed", "cosine_topk"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        # The first run warms the plan's code up; the best of the others is the plan's time.
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs[1:]), 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    if "--no-duckdb" not in sys.argv:
        line["duckdb"] = time_duckdb(sf_dir, [n for n in names if n in ORACLES], int(cpus))
    print(json.dumps(line))


def time_duckdb(sf_dir: str, names: list[str], cpus: int) -> dict[str, float]:
    from check_oracles import connect

    con = connect(sf_dir)
    con.execute(f"SET threads = {cpus}")
    times = {}
    for name in names:
        start = time.perf_counter()
        con.execute(f"CREATE OR REPLACE TEMP TABLE out AS {ORACLES[name]}")
        times[name] = round(time.perf_counter() - start, 3)
    return times


if __name__ == "__main__":
    main()
