"""Run every named query and its SQL side by side and compare the rows.

Usage: python check_oracles.py [folder of the tables] [query ...]
"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb

from vecweave.catalogue import ORACLES, QUERIES
from vecweave.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    return str(value) if value is not None else None


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(normal(row[i]) for i in order) for row in rows], key=str)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when both agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in ORACLES:
        return None if got else "no rows"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, want)
    if a == b:
        return None
    extra, lost = sorted(set(a) - set(b), key=str), sorted(set(b) - set(a), key=str)
    return f"{len(a)} and {len(b)} rows; only Spark {len(extra)} {extra[:2]}; only SQL {len(lost)} {lost[:2]}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        kind = "oracle" if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.2f}s {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{len(chosen) - bad} of {len(chosen)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
