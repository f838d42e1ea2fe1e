from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecweave.operators import chunking as C


def chunked(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = [[] for _ in texts]
    for r in sorted(fn(df).collect(), key=lambda r: (r["i"], r["chunk_index"])):
        assert r["chunk_index"] == len(out[r["i"]])
        out[r["i"]].append(r["content"])
    return out


def slices(text, size, stride):
    out = []
    for i in range(0, len(text), stride):
        if i == 0 or i + (size - stride) < len(text):
            out.append(text[i : i + size])
    return out


def pieces(text):
    """The sentences of a text: it is cut at spaces that follow an end mark."""
    return re.split(r"(?<=[.!?]) +", text)


def check_packing(text, size, chunks):
    """What a packing of sentences must hold, whatever way it is made."""
    sentences = [x for x in pieces(text)]
    # Lossless and in order: the chunks' sentences are the text's sentences.
    assert [x for x in re.split(r"(?<=[.!?]) +", " ".join(chunks)) if x] == [x for x in sentences if x]
    spaces = [c.count(" ") for c in chunks]
    for i, c in enumerate(chunks):
        own = [x for x in pieces(c)]
        joins = len(own) - 1
        assert c != ""
        # Over the limit only by the joining space of the last sentence, or by one long sentence.
        assert len(c) <= size + 1 or joins == 0 or len(c) - len(own[-1]) - 1 == 0, (c, size)
        if i:
            # The first sentence of a chunk did not fit the chunk before.
            assert len(chunks[i - 1]) + len(own[0]) > size
    assert len(spaces) == len(chunks)


EDGES = ["", "abc", "x" * 512, "x" * 513, "y" * 2000, "One. Two! Three. ", "Größe è un ça. Ñandú? Sí!", "a\nb\n\nc. d", "😀" * 600]


def test_fixed_edges(spark):
    assert chunked(spark, EDGES, lambda d: C.chunk_fixed(d, 512)) == [slices(t, 512, 512) for t in EDGES]


def test_overlap_edges(spark):
    for size, overlap in ((512, 64), (10, 9), (7, 3)):
        got = chunked(spark, EDGES, lambda d: C.chunk_fixed(d, size, overlap))
        assert got == [slices(t, size, size - overlap) for t in EDGES]


def test_sentence_edges(spark):
    for size in (5, 10, 512):
        for text, chunks in zip(EDGES, chunked(spark, EDGES, lambda d: C.chunk_sentence(d, size))):
            check_packing(text, size, chunks)
    by_hand = {
        "One. Two! Three. ": (10, ["One. Two!", "Three. "]),
        "aa. bb. cc.": (6, ["aa. bb.", "cc."]),
        "aa. bb. cc.": (5, ["aa.", "bb.", "cc."]),
        "a long sentence. b.": (4, ["a long sentence.", "b."]),
        "": (4, []),
    }
    for text, (size, want) in by_hand.items():
        assert chunked(spark, [text], lambda d: C.chunk_sentence(d, size)) == [want]


def test_sentence_packing_may_exceed_by_the_space(spark):
    assert chunked(spark, ["ab. cd."], lambda d: C.chunk_sentence(d, 6)) == [["ab. cd."]]
    assert chunked(spark, ["One. ", "x" * 600 + ". "], lambda d: C.chunk_sentence(d, 512)) == [["One. "], ["x" * 600 + "."]]


def test_many_chunks_of_one_document(spark):
    text = " ".join(f"Sentence number {i}." for i in range(3000))
    check_packing(text, 30, chunked(spark, [text], lambda d: C.chunk_sentence(d, 30))[0])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.!? \né", max_size=60), min_size=1, max_size=30), st.integers(1, 20))
def test_invariants_hold(spark, texts, size):
    for text, chunks in zip(texts, chunked(spark, texts, lambda d: C.chunk_sentence(d, size))):
        check_packing(text, size, chunks)
    assert chunked(spark, texts, lambda d: C.chunk_fixed(d, size)) == [slices(t, size, size) for t in texts]


def test_semantic_cuts_at_the_change_of_topic(spark):
    text = "The cat sat. The cat ran. The cat ate. Stocks rose today. Stocks fell today. Stocks closed today."
    (got,) = chunked(spark, [text], lambda d: C.chunk_semantic(d, 512, threshold_pct=80, dim=256))
    assert got == ["The cat sat. The cat ran. The cat ate.", "Stocks rose today. Stocks fell today. Stocks closed today."]


def test_semantic_keeps_every_sentence(spark):
    got = chunked(spark, EDGES, lambda d: C.chunk_semantic(d, 100000))
    for text, chunks in zip(EDGES, got):
        sentences = re.split(r"(?<=[.!?]) +", text)
        assert " ".join(chunks) == " ".join(sentences)


def test_semantic_slices_long_segments(spark):
    (got,) = chunked(spark, ["z" * 1200], lambda d: C.chunk_semantic(d, 512))
    assert [len(c) for c in got] == [512, 512, 176]


def test_dispatch(spark):
    df = spark.createDataFrame([(1, "a. b. c.")], "i int, text string")
    assert C.chunk(df, "semantic", 3, fallback="fixed").count() == 3
    assert C.chunk(df, "sentence", 3).count() == 3
    with pytest.raises(ValueError, match="chunking strategy"):
        C.chunk(df, "paragraph")
    for bad in ({"size": 0}, {"size": 5, "overlap": 5}, {"size": 5, "overlap": -1}):
        with pytest.raises(ValueError):
            C.chunk_fixed(df, **bad)


def test_ids_are_stable_and_can_be_given(spark):
    df = spark.createDataFrame([("s", "hello world")], "source string, text string")
    once, twice = (C.build_chunks(C.chunk_fixed(df, 5), "fixed").select("id").collect() for _ in range(2))
    assert once == twice and len({r["id"] for r in once}) == 3
    given_ids = C.build_chunks(C.chunk_fixed(df, 50), "fixed", chunk_id=F.lit("mine")).first()
    assert given_ids["id"] == "mine"
    assert given_ids["metadata"] == {"type": "txt", "chunk_index": "0", "chunking_strategy": "fixed", "file_size": "0"}


def test_stats_truncate_after_summing(spark):
    df = spark.createDataFrame([("s", "one"), ("s", "two three"), ("t", "  ")], "source string, content string")
    got = {r["source"]: r for r in C.chunk_stats(df, "source").collect()}
    assert got["s"]["est_tokens"] == 3 and got["s"]["n_chunks"] == 2 and got["s"]["max_chars"] == 9
    assert got["t"]["est_tokens"] == 0


def test_chunking_does_not_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for strategy in ("fixed", "sentence", "semantic"):
        plan = C.chunk(docs.select("doc_id", "text"), strategy, 512)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
