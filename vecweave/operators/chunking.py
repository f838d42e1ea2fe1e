"""Splitting texts into chunks. Every strategy is a projection: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecweave.functions.binding import let
from vecweave.functions.hashing import adjacent_distances
from vecweave.functions.text import estimated_tokens, sentences, word_count
from vecweave.schemas import CHUNKING_STRATEGIES, require

DEFAULT_SIZE = 512
# Finished chunks move to an outer list in groups of this many, so that appending
# does not copy the whole list of a very long document each time.
_GROUP = 256


def _check_size(size: int, overlap: int = 0) -> None:
    if size < 1:
        raise ValueError("size must be at least 1")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")


def fixed_slices(text: Column, size: int, overlap: int = 0) -> Column:
    """Slices of ``size`` characters that start every ``size - overlap`` characters.

    A last slice that lies wholly inside the one before it is left out. One regular
    expression pass, linear in the text.
    """
    _check_size(size, overlap)
    if overlap == 0:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    stride = size - overlap
    slices = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{stride}}}"), F.lit(1))
    kept = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / stride)).cast("int")
    return F.slice(slices, F.lit(1), kept)


def _packed_ranges(lengths: Column, size: int) -> Column:
    """Greedy packing of sentence lengths: array of (first sentence, number of sentences).

    A sentence joins the current chunk unless the two lengths, without the joining
    space, exceed ``size``.
    """
    span = "struct<first:int,n:int>"
    start = F.struct(
        F.lit(0).alias("used"),
        F.lit(1).alias("first"),
        F.lit(0).alias("n"),
        F.array().cast(f"array<{span}>").alias("recent"),
        F.array().cast(f"array<array<{span}>>").alias("older"),
    )

    def step(acc: Column, length: Column) -> Column:
        done = F.struct(acc["first"].alias("first"), acc["n"].alias("n"))
        cut = (acc["used"] + length > size) & (acc["n"] > 0)
        full = cut & (F.size(acc["recent"]) >= _GROUP)
        return F.struct(
            F.when(cut | (acc["n"] == 0), length).otherwise(acc["used"] + 1 + length).alias("used"),
            F.when(cut, acc["first"] + acc["n"]).otherwise(acc["first"]).alias("first"),
            F.when(cut, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, F.array(done))
            .when(cut, F.concat(acc["recent"], F.array(done)))
            .otherwise(acc["recent"])
            .alias("recent"),
            F.when(full, F.concat(acc["older"], F.array(acc["recent"]))).otherwise(acc["older"]).alias("older"),
        )

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n")))
        return F.concat(F.flatten(acc["older"]), acc["recent"], last)

    return F.aggregate(lengths, start, step, finish)


def sentence_packs(text: Column, size: int) -> Column:
    """Sentences packed into chunks of about ``size`` characters; an over-long sentence stays whole."""
    _check_size(size)
    packs = let(
        sentences(text),
        lambda s: F.transform(
            _packed_ranges(F.transform(s, lambda x: F.length(x)), size),
            lambda r: F.array_join(F.slice(s, r["first"], r["n"]), " "),
        ),
    )
    return F.filter(packs, lambda c: c != "")


def interpolated_percentile(values: Column, share: float) -> Column:
    """Linear-interpolation percentile of the numbers in one row's array."""

    def pick(ordered: Column) -> Column:
        at = (F.size(ordered) - 1) * F.lit(share)
        low = F.floor(at).cast("int")
        a = F.element_at(ordered, low + 1)
        b = F.element_at(ordered, F.least(low + 2, F.size(ordered)))
        return a + (b - a) * (at - low)

    return let(F.sort_array(values), lambda o: F.when(F.size(o) > 0, pick(o)))


def topic_segments(sents: Column, gaps: Column, threshold_pct: float, size: int) -> Column:
    """Runs of sentences cut where neighbours differ more than the document's percentile.

    Segments longer than ``size`` are sliced.
    """
    _check_size(size)
    if not 0 <= threshold_pct <= 100:
        raise ValueError("threshold_pct must lie between 0 and 100")

    def cut_positions(limit: Column) -> Column:
        # 1-based index of the last sentence of each segment but the final one.
        marks = F.transform(gaps, lambda g, i: F.when(g > limit, i + 1))
        return F.filter(marks, lambda m: m.isNotNull())

    def segments(cuts: Column) -> Column:
        firsts = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda c: c + 1))
        lasts = F.concat(cuts, F.array(F.size(sents)))
        return F.zip_with(firsts, lasts, lambda a, b: F.array_join(F.slice(sents, a, b - a + 1), " "))

    whole = let(
        interpolated_percentile(gaps, threshold_pct / 100.0),
        lambda limit: let(cut_positions(limit), segments),
    )
    return F.flatten(F.transform(whole, lambda seg: fixed_slices(seg, size)))


def _explode(df: DataFrame, chunks: Column, text: str) -> DataFrame:
    keep = [c for c in df.columns if c not in (text, "_sents", "_gaps")]
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "content"))


def chunk_fixed(df: DataFrame, size: int = DEFAULT_SIZE, overlap: int = 0, text: str = "text") -> DataFrame:
    return _explode(df, fixed_slices(F.col(text), size, overlap), text)


def chunk_sentence(df: DataFrame, size: int = DEFAULT_SIZE, text: str = "text") -> DataFrame:
    return _explode(df, sentence_packs(F.col(text), size), text)


def chunk_semantic(
    df: DataFrame,
    size: int = DEFAULT_SIZE,
    threshold_pct: float = 90.0,
    dim: int = 64,
    text: str = "text",
) -> DataFrame:
    """Chunks that end where the topic changes: see ``topic_segments``.

    A document is one row, so its sentences never leave that row and nothing is shuffled.
    """
    measured = df.withColumn("_sents", sentences(F.col(text))).withColumn(
        "_gaps", adjacent_distances(F.col("_sents"), dim)
    )
    cut = topic_segments(F.col("_sents"), F.col("_gaps"), threshold_pct, size)
    return _explode(measured, cut, text)


def chunk(
    df: DataFrame,
    strategy: str = "semantic",
    size: int = DEFAULT_SIZE,
    overlap: int = 0,
    fallback: str | None = None,
    text: str = "text",
    **semantic: float,
) -> DataFrame:
    """Chunk by strategy name. ``fallback="fixed"`` makes ``semantic`` cut fixed slices."""
    require(strategy, CHUNKING_STRATEGIES, "chunking strategy")
    if strategy == "sentence":
        return chunk_sentence(df, size, text)
    if strategy == "fixed" or fallback == "fixed":
        return chunk_fixed(df, size, overlap, text)
    return chunk_semantic(df, size, text=text, **semantic)


def build_chunks(
    chunks: DataFrame,
    strategy: str,
    doc_type: Column | str = "txt",
    file_size: Column | None = None,
    created_at: Column | None = None,
    chunk_id: Column | None = None,
) -> DataFrame:
    """Chunk rows with a deterministic id and the standard metadata.

    Re-running gives the same ids, so a repeated load replaces rows instead of
    doubling them.
    """
    kind = F.lit(doc_type) if isinstance(doc_type, str) else doc_type
    size = F.lit(0) if file_size is None else file_size
    default_id = F.sha2(
        F.concat_ws("\u0001", "source", F.lit(strategy), F.col("chunk_index").cast("string"), "content"), 256
    )
    return chunks.select(
        (default_id if chunk_id is None else F.coalesce(chunk_id, default_id)).alias("id"),
        "content",
        "source",
        F.create_map(
            F.lit("type"),
            kind,
            F.lit("chunk_index"),
            F.col("chunk_index").cast("string"),
            F.lit("chunking_strategy"),
            F.lit(strategy),
            F.lit("file_size"),
            size.cast("string"),
        ).alias("metadata"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(None).cast("string").alias("embedding_model"),
        F.lit(None).cast("string").alias("vector_id"),
        *[c for c in chunks.columns if c not in ("content", "source")],
    )


def chunk_stats(chunks: DataFrame, by: str) -> DataFrame:
    """Chunks, lengths and estimated tokens per ``by``; partial sums precede the shuffle."""
    length = F.length("content")
    return chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min(length).alias("min_chars"),
        F.avg(length).alias("avg_chars"),
        F.max(length).alias("max_chars"),
        estimated_tokens(F.sum(word_count(F.col("content")))).alias("est_tokens"),
    )
