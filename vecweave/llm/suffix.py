"""Repeated byte strings, found with a logarithmic family of sampled suffix arrays.

Suffixes are sampled so that no match of ``SPAN`` bytes can be missed: every window of that
length is represented by the gram (``GRAM`` bytes) of smallest hash in it, which two equal
windows hold at the same place. Neighbouring windows with the same gram form one entry: the
gram's fingerprint, the fingerprint of all bytes the windows cover, the document and the place.

The entries of a batch, sorted by fingerprints, are its suffix array; equal strings stand next
to each other in it. A new batch is merge-scanned against the arrays that exist: an entry that
also occurs earlier is a repeat. Entries that share the gram but not all bytes around it are
compared window by window on the bytes themselves. Arrays of equal size are merged before the
next batch, so there are never more than log2(batches) of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecweave.llm.arrays import Rolling, mix, text_slices
from vecweave.llm.components import stored

SPAN, GRAM = 100, 32
PIECE = 1 << 22
# A gram with more distinct surroundings than this is compared window by window, each window
# value a group of its own, instead of gram by gram.
HOT = 200_000
LAST = (1 << 63) - 1

_ENTRY = "key bigint, ctx bigint, doc bigint, at bigint, n int, repeat boolean"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    padded = np.full(-(-len(x) // w) * w, np.uint64(2**64 - 1))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: len(x) - w + 1], before[w - 1 : len(x)])


def sample(data: np.ndarray, offsets: np.ndarray, hashes: tuple[Rolling, Rolling], span: int = SPAN, gram: int = GRAM):
    """``(gram, surroundings, first window, number of windows)`` of each entry, within texts."""
    n = len(data)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = hashes[0].sums(data)
    grams = hashes[0].spans(sums, np.arange(n - gram + 1), np.arange(gram, n + 1))
    low = np.uint64(0xFFFFFF)
    # The place in the low bits makes the leftmost of equal grams the smallest.
    least = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), span - gram + 1)
    place = np.arange(n - span + 1)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    place = place[place + span <= end]
    chosen = (least & low).astype(np.int64)[place]
    fresh = np.ones(len(place), bool)
    fresh[1:] = chosen[1:] != chosen[:-1]
    at = np.flatnonzero(fresh)
    first, count = place[at], np.diff(np.append(at, len(place)))
    around = hashes[1].spans(hashes[1].sums(data), first, first + count + span - 1) ^ mix(count.astype(np.uint64))
    return grams[chosen[at]], around, first, count


def _pieces(data: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A slice as it is, or one very long text in pieces that share no window."""
    if len(data) <= PIECE + span:
        yield 0, data, offsets
        return
    for start in range(0, len(data) - span + 1, PIECE):
        piece = data[start : start + PIECE + span - 1]
        yield start, piece, np.array([0, len(piece)])


def _entries(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = (Rolling(91), Rolling(92))
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for first, end, whole, bounds in text_slices(batch.column(1)):
                found = []
                for shift, data, offsets in _pieces(whole, bounds, span):
                    key, ctx, at, n = sample(data, offsets, hashes, span, gram)
                    row = np.searchsorted(offsets, at, "right") - 1
                    found.append((key, ctx, docs[first + row], at - offsets[row] + shift, n))
                key, ctx, doc, at, n = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0)] * 5
                order = np.lexsort((at, doc, ctx, key))
                key, ctx, doc, at, n = key[order], ctx[order], doc[order], at[order], n[order]
                # Of equal entries within the slice only the earliest can be the earliest of all.
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
                lead = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
                repeat = (doc != doc[lead]) | (at != at[lead])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.uint64).view(np.int64)), pa.array(ctx.astype(np.uint64).view(np.int64)), pa.array(doc.astype(np.int64)),
                     pa.array(at.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(repeat)],
                    names=["key", "ctx", "doc", "at", "n", "repeat"],
                )

    return run


class SuffixIndex:
    """A family of sorted entry tables in the shared folder; batches come in document order."""

    def __init__(self, spark: SparkSession, span: int = SPAN, gram: int = GRAM):
        self.spark, self.span, self.gram = spark, span, gram
        self.levels: list[tuple[int, DataFrame]] = []  # (batches, entries), largest first

    def merge(self) -> None:
        """Merges the last two levels while they are equal in size; repeats go."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, b), (m, a) = self.levels.pop(), self.levels.pop()
            both = a.unionByName(b).repartition("key").groupBy("key", "ctx", "n").agg(F.min(F.struct("doc", "at")).alias("f"))
            both = both.select("key", "ctx", "f.doc", "f.at", "n").sortWithinPartitions("key", "ctx")
            self.levels.append((n + m, stored(both, "level")))

    def add(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Indexes ``doc, text`` rows; their repeats, and the entries to compare by bytes.

        Repeats are ``doc, at, n``: n windows from ``at`` on start earlier as well.
        """
        self.merge()
        rows = stored(batch.mapInArrow(_entries(self.span, self.gram), _ENTRY), "entries")
        own = rows.filter("NOT repeat").drop("repeat")
        every = own.withColumn("new", F.lit(True))
        for _, level in self.levels:
            every = every.unionByName(level.withColumn("new", F.lit(False)))
        same = Window.partitionBy("key", "ctx")
        gram = Window.partitionBy("key")
        seen = (
            every.repartition("key")
            .withColumn("lead", F.min(F.struct("doc", "at")).over(same))
            .withColumn("lo", F.min("ctx").over(gram))
            .withColumn("hi", F.max("ctx").over(gram))
            .withColumn("fresh", F.max("new").over(gram))
        )
        leads = (F.col("doc") == F.col("lead.doc")) & (F.col("at") == F.col("lead.at"))
        open_ = leads & F.col("fresh") & (F.col("lo") != F.col("hi"))
        found = seen.select("key", "doc", "at", "n", (~leads & F.col("new")).alias("repeat"), open_.alias("open")).filter("repeat OR open")
        found = stored(found, "scan")
        self.levels.append((1, own))
        repeats = rows.filter("repeat").select("doc", "at", "n").unionByName(found.filter("repeat").select("doc", "at", "n"))
        return repeats, found.filter("open").select("key", "doc", "at", "n")


def _surroundings(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = batch.column(1), batch.column(0).to_numpy()
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            key, at, n = (flat.field(i).to_numpy() for i in range(3))
            out, keys, places, owner = [], [], [], []
            size = 0
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer() if texts[i].is_valid else pa.py_buffer(b"")
                for k in range(bounds[i], bounds[i + 1]):
                    out.append(raw.slice(at[k], max(0, min(n[k] + span - 1, raw.size - at[k]))).to_pybytes() if at[k] < raw.size else b"")
                    keys.append(key[k])
                    places.append(at[k])
                    owner.append(docs[i])
                    size += len(out[-1])
                if size > 1 << 22 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(owner, pa.int64()), pa.array(places, pa.int64()), pa.array(out, pa.binary())],
                        names=["key", "doc", "at", "bytes"],
                    )
                    out, keys, places, owner, size = [], [], [], [], 0

    return run


def _compare(span: int):
    """Repeats among rows ``key, doc, at, bytes`` sorted by key, document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Rolling(93)
        open_key, seen = None, np.zeros(0, np.uint64)
        for batch in batches:
            key, doc, at = (batch.column(i).to_numpy() for i in range(3))
            for first, end, data, offsets in text_slices(batch.column(3)):
                k, d, a = key[first:end], doc[first:end], at[first:end]
                size = np.diff(offsets)
                count = np.maximum(size - span + 1, 0)
                row = np.repeat(np.arange(len(k)), count)
                begin = np.cumsum(count) - count
                start = offsets[row] + np.arange(len(row)) - begin[row]
                value = mix(hashes.spans(hashes.sums(data), start, start + span) + k[row].view(np.uint64))
                order = np.argsort(value, kind="stable")
                later = np.zeros(len(row), bool)
                later[order[1:][value[order][1:] == value[order][:-1]]] = True
                if open_key is not None and k[0] == open_key:
                    mine = k[row] == open_key
                    later[mine] |= np.isin(value[mine], seen)
                else:
                    seen = np.zeros(0, np.uint64)
                if k[-1] != open_key:
                    seen = np.zeros(0, np.uint64)
                open_key = k[-1]
                seen = np.union1d(seen, value[k[row] == open_key])
                # Runs of repeats within a row.
                hit = np.flatnonzero(later)
                if len(hit):
                    cut = np.ones(len(hit), bool)
                    cut[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
                    head = np.flatnonzero(cut)
                    n = np.diff(np.append(head, len(hit)))
                    h = hit[head]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d[row[h]]), pa.array(a[row[h]] + h - begin[row[h]]), pa.array(n.astype(np.int32))], names=["doc", "at", "n"]
                    )

    return run


def _single_windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Rolling(94)
        for batch in batches:
            doc, at = (batch.column(i).to_numpy() for i in (1, 2))
            for first, end, data, offsets in text_slices(batch.column(3), 1 << 18):
                count = np.maximum(np.diff(offsets) - span + 1, 0)
                row = np.repeat(np.arange(end - first), count)
                step = np.arange(len(row)) - (np.cumsum(count) - count)[row]
                start = offsets[row] + step
                value = hashes.spans(hashes.sums(data), start, start + span)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(doc[first:end][row]), pa.array(at[first:end][row] + step),
                     pa.array([raw[s : s + span] for s in start.tolist()], pa.binary())],
                    names=["key", "doc", "at", "bytes"],
                )

    return run


def compare_bytes(texts: DataFrame, open_entries: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """``doc, at, n``: windows of the open entries that an earlier entry of the same gram holds.

    Each entry's bytes are cut from its text and meet by gram, in order; a task holds the
    distinct windows of one gram at most. Grams with more than ``hot`` entries meet by window.
    """
    entry = "key bigint, doc bigint, at bigint, bytes binary"
    per_doc = open_entries.distinct().groupBy("doc").agg(F.collect_list(F.struct("key", "at", "n")).alias("e"))
    around = texts.join(per_doc, "doc").select("doc", "text", "e").mapInArrow(_surroundings(span), entry)
    around = stored(around.dropDuplicates(["key", "doc", "at"]), "around")
    many = stored(open_entries.distinct().groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > hot).select("key"), "hot")
    if not many.isEmpty():
        apart = around.join(many, "key", "left_semi").mapInArrow(_single_windows(span), entry)
        around = around.join(many, "key", "left_anti").unionByName(apart)
    ordered = around.repartition("key").sortWithinPartitions("key", "doc", "at")
    return ordered.mapInArrow(_compare(span), "doc bigint, at bigint, n int")


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            rows = []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_buffer().to_pybytes() if batch.column(1)[i].is_valid else b""
                edge = np.zeros(len(raw) + 1, np.int64)
                if lists[i].is_valid:
                    own = lists[i].values
                    at, n = own.field(0).to_numpy(), own.field(1).to_numpy()
                    inside = at < len(raw)
                    at, n = at[inside], n[inside]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + n + span - 1, len(raw)), -1)
                gone = np.cumsum(edge)[: len(raw)] > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rest = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
            size, removed, spans, sha, rest = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(rest, pa.binary())],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
            )

    return run


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", batches: int = 3, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes``, one row per row of ``docs``.

    A byte goes if it lies in a string of ``span`` bytes that also starts earlier: in a document
    of smaller doc_id, or in the same one further left. Strings are judged on the input. The
    documents are indexed in ``batches`` batches of about equal count, in the order of doc_id.

    A null text is empty; a null doc_id comes last, and such rows count as one document; so do
    rows repeated whole. Different texts under one doc_id get the union of their cuts. Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST)).alias("doc"), F.col(f"`{text}`").alias("text"))
    shares = [i / batches for i in range(1, batches)]
    cuts = rows.agg(F.percentile_approx("doc", F.lit(shares), 10_000).alias("c")).first().c if shares else None
    edges = sorted(set(cuts or []))
    index, repeats, open_entries = SuffixIndex(spark, span, gram), None, None
    for i in range(len(edges) + 1):
        batch = rows
        if i:
            batch = batch.filter(F.col("doc") > edges[i - 1])
        if i < len(edges):
            batch = batch.filter(F.col("doc") <= edges[i])
        again, unsure = index.add(batch)
        repeats = again if repeats is None else repeats.unionByName(again)
        open_entries = unsure if open_entries is None else open_entries.unionByName(unsure)
    repeats = repeats.unionByName(compare_bytes(rows, open_entries, span, hot))
    per_doc = repeats.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("r"))
    out = rows.join(per_doc, "doc", "left").select("doc", "text", "r")
    out = out.mapInArrow(_cut(span), "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary")
    doc_id = F.when(F.col("doc") != LAST, F.col("doc")).cast(kind).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
