from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vecweave.operators import sampling as P


def frame(spark, sizes):
    rows = [(k, i, "é" * (n // 2) + "x" * (n % 2)) for k, ns in sizes.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "source string, doc_id long, text string")


def check_parts(sizes, limit, parts):
    """Parts count up from 1 without gaps; each is full; each is within the limit or one line."""
    assert len(parts) == len(sizes) and parts[:1] == [1][: len(parts)]
    assert all(b - a in (0, 1) for a, b in zip(parts, parts[1:]))
    bytes_of, lines_of = Counter(), Counter(parts)
    for n, p in zip(sizes, parts):
        if p > 1 and not bytes_of[p]:
            # The first line of a part did not fit the part before.
            assert bytes_of[p - 1] + n + 1 > limit
        bytes_of[p] += n + 1
    assert all(bytes_of[p] <= limit or lines_of[p] == 1 for p in lines_of)


def got(df, **options):
    out = {}
    for r in sorted(P.split_by_bytes(df, **options).collect(), key=lambda r: (r["source"], r["doc_id"])):
        out.setdefault(r["source"], []).append(r["part"])
    return out


def test_five_lines(spark):
    parts = got(frame(spark, {"f": [39] * 5}), max_bytes=100)["f"]
    assert parts == [1, 1, 2, 2, 3]


@pytest.mark.parametrize("max_rows", [1, 10**6])
@pytest.mark.parametrize("limit, fan", [(100, 4), (300, 2), (500, 64), (1, 8)])
def test_parts_are_full_and_within_the_limit(spark, monkeypatch, max_rows, limit, fan):
    monkeypatch.setattr(P, "_FAN", fan)
    rnd = random.Random(limit)
    sizes = {
        "mixed": [rnd.choice([0, 1, 5, 20, 60, 99, 100, 250]) for _ in range(40 if limit == 1 else 400)],
        "even": [9] * (20 if limit == 1 else 200),
        "giants": [400] * 3 + [1] * 20 + [900],
        "one": [5],
    }
    found = got(frame(spark, sizes), max_bytes=limit, max_rows=max_rows, block_rows=50)
    assert set(found) == set(sizes)
    for k, v in sizes.items():
        check_parts(v, limit, found[k])


def test_split_needs_a_size(spark):
    with pytest.raises(ValueError):
        P.split_by_bytes(frame(spark, {"a": [1]}), 0)


def test_sample(spark):
    df = spark.range(10)
    a, b = (sorted(r[0] for r in P.sample_exact(df.repartition(n), 3).collect()) for n in (1, 4))
    assert a == b and len(a) == 3
    assert P.sample_exact(df, 0).count() == 0 and P.sample_exact(df, 10).count() == 10
    with pytest.raises(ValueError, match="only 10 are available"):
        P.sample_exact(df, 11)
    with pytest.raises(ValueError):
        P.sample_exact(df, -1)
    assert sorted(r[0] for r in P.sample_exact(df, 3, seed=1).collect()) != a


def test_large_sample_is_the_same(spark):
    df = spark.range(5000)
    for n in (1, 700, 5000):
        plain = {r[0] for r in P.sample_exact(df, n).collect()}
        assert {r[0] for r in P.sample_exact(df, n, small=0).collect()} == plain and len(plain) == n


def test_sparse_ids_are_cut_into_equal_blocks(spark, tmp_path):
    rnd = random.Random(8)
    ids = sorted(rnd.sample(range(10**15), 300)) + [10**15 + i for i in range(200)]
    sizes = [rnd.choice([3, 20, 60]) for _ in ids]
    rows = [("one" if i % 5 else "two", n, "x" * size) for i, (n, size) in enumerate(zip(ids, sizes))]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(6)
    lines = P._line_bytes(df, "source", "doc_id", "text").withColumn("b", P._equal_blocks(df, "doc_id", 50))
    per_block = [r["n"] for r in lines.groupBy("b").count().withColumnRenamed("count", "n").collect()]
    assert len(per_block) == 10 and max(per_block) <= 60
    assert got(df, max_bytes=200, max_rows=1, block_rows=50) == got(df, max_bytes=200)
    P.write_parts(P.split_by_bytes(df, 200, max_rows=1, block_rows=50), f"{tmp_path}/parts")
    files = spark.read.text(f"{tmp_path}/parts", wholetext=True).collect()
    assert all(len(r["value"]) <= 200 for r in files) and len(files) == sum(max(p) for p in got(df, max_bytes=200).values())
    text = "".join(r["value"] for r in sorted(files, key=lambda r: r["part"]) if r["source"] == "two")
    assert text == "".join(t + "\n" for s, _, t in rows if s == "two")


def test_parts_are_written_once_and_found_by_their_keys(spark, tmp_path):
    keys = ["a/b=c", "50%", "ü", None, "", "plain"]
    rows = [(k, i, f"line {i}" if i % 7 else None, 1 + i // 20) for k in keys for i in range(50)]
    parted = spark.createDataFrame(rows, "source string, doc_id long, text string, part long")
    P.write_parts(parted, f"{tmp_path}/parts")
    parted.select("source", "part", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source", "part").text(f"{tmp_path}/spark")
    folders = [{os.path.relpath(d, f"{tmp_path}/{n}") for d, _, names in os.walk(f"{tmp_path}/{n}") if any(x.endswith(".txt") for x in names)} for n in ("parts", "spark")]
    assert folders[0] == folders[1] and len(folders[0]) == 15
    read = spark.read.text(f"{tmp_path}/parts", wholetext=True).collect()
    # Null and the empty key share a folder, not a file.
    assert len(read) == 18
    wanted = {(k or None, p): "".join(("" if i % 7 == 0 else f"line {i}") + "\n" for i in range(50) if 1 + i // 20 == p) for k in keys for p in (1, 2, 3)}
    assert all(r["value"] == wanted[r["source"], r["part"]] for r in read)
    with pytest.raises(FileExistsError):
        P.write_parts(parted, f"{tmp_path}/parts")


def test_thousands_of_blocks_are_cut_by_one_literal(spark):
    rows = spark.range(6000).select(F.lit("k").alias("source"), F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    blocks = rows.select(P._equal_blocks(P._line_bytes(rows, "source", "doc_id", "text"), "doc_id", 2).alias("b"))
    sizes = blocks.groupBy("b").count()
    assert sizes.count() == 3000 and sizes.agg(F.max("count")).first()[0] <= 4
