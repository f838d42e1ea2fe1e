"""Ranked lexical search over posting lists cut into blocks of similar documents.

The index holds the terms of a set of items (the queries). Documents are dealt into shards, where
each term's posting list is clustered by document similarity: every document goes to the nearest
of some documents of the list, by random projections of the weighted terms. A block keeps the
coordinatewise maximum of its documents' impacts, rounded up to a byte; frequent terms have a
coordinate of their own, rare ones share some. Weights are not negative, so the product of an item's
weights with a block's maxima is at least the score of each of its documents. A document that holds
a term of an item is in a block of the list of its heaviest one, and there only terms up to that
weight can add to its score: a block is passed over only where the product over these is below the
item's k-th best score so far. Documents of the other blocks are scored exactly, in integers, from
all their terms.

A shard is bounded in documents; a task keeps k hits per item; items are taken in blocks of a bounded
number of terms. Statistics count all documents.

Null and empty texts have no terms and are in no count; null ids come last among equal scores; repeated
rows are documents of their own. Rows of one item id are one item with the terms of all of them; items
without hits give no rows, like empty tables. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vecweave.llm.arrays import Rolling, owners, text_slices, words_of
from vecweave.session import shared_dir

K = 50
SHARD_DOCS = 1024
# Documents per block, on average, of a list that is longer than this.
BLOCK_DOCS = 32
# Coordinates of a summary; three quarters belong to one term each, the most frequent ones.
COORDINATES = 256
PROJECTIONS = 16
# One byte of a summary counts for this much impact; impacts are below 1,000,000.
UNIT = 4096
# Items are searched together as long as they have this many terms, and terms times items are within the second bound.
ITEM_TERMS = 20_000
MAX_CELLS = 8_000_000
# Terms of pairs scored at once.
MAX_EXPANSION = 200_000
MERGE_WAYS = 32
# A shard's arrays are compressed before they become a row, so that a batch of rows stays small.
PACKED = "zstd"
ROW_GROUP_BYTES = 16 << 20

_APART = np.ones(256, bool)
_APART[0x80:] = False
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Items:
    """Items and their terms: numbers in place of both."""

    ids: list
    terms: list[str]
    # (item, term) pairs as two arrays of numbers.
    item: np.ndarray
    term: np.ndarray
    # The Spark type of an id.
    kind: str = "bigint"

    @classmethod
    def of(cls, rows: Sequence[tuple], kind: str = "bigint") -> Items:
        """From distinct (item id, term) rows."""
        ids = list(dict.fromkeys(r[0] for r in rows))
        terms = sorted({r[1] for r in rows})
        place, number = {x: i for i, x in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
        return cls(ids, terms, np.array([place[r[0]] for r in rows], np.int64), np.array([number[r[1]] for r in rows], np.int64), kind)


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items in blocks whose terms fit a task, one block at a time on the driver."""
    words = F.regexp_extract_all(F.translate(f"`{text}`", _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    pairs = items.select(F.col(f"`{item_id}`").alias("_item"), F.explode(words).alias("_term")).distinct()
    parts = max(1, math.ceil(pairs.count() / ITEM_TERMS))
    home = F.pmod(F.xxhash64("_item"), F.lit(parts))
    for part in range(parts):
        rows = [tuple(r) for r in pairs.filter(home == part).collect()]
        todo = [rows] if rows else []
        while todo:
            block = Items.of(todo.pop(), pairs.schema["_item"].dataType.simpleString())
            if len(block.ids) > 1 and len(block.ids) * len(block.terms) > MAX_CELLS:
                half = set(range(len(block.ids) // 2))
                named = [(int(i), block.terms[t]) for i, t in zip(block.item, block.term)]
                for side in (True, False):
                    todo.append([(block.ids[i], t) for i, t in named if (i in half) == side])
                continue
            yield block


def term_counts(docs: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """``doc_id, n, terms, counts``: a text's number of words, and its words among ``terms`` with their numbers.

    Words are told apart by 64-bit hashes and their lengths.
    """
    chosen = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    names = [t.encode() for t in terms]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Rolling(11, fold=True)
        data = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(x) for x in names])
        sizes = np.diff(np.concatenate([[0], ends])).astype(np.int64)
        known = hashes.spans(hashes.sums(data), ends - sizes, ends)
        order = np.argsort(known)
        known = known[order]
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                starts, ends_, bounds = words_of(data, offsets, _APART)
                keys = hashes.spans(hashes.sums(data), starts, ends_)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                number = order[at]
                held = (known[at] == keys) & (sizes[number] == ends_ - starts)
                pair, n = np.unique(owners(bounds)[held] * len(names) + number[held], return_counts=True)
                cut = np.searchsorted(pair, np.arange(end - first + 1) * len(names)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array((pair % len(names)).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(n.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return chosen.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


@dataclass
class Statistics:
    """``documents`` with a term, their ``words``, and how many hold each term."""

    documents: int
    words: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        """Per term: a thousand times the logarithm of how rare it is, in whole numbers."""
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(df) + 1))) for df in self.holding], np.int64)

    def impacts(self, n: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What each (document, term) adds to a score, per unit of weight; in whole numbers of any size."""
        longs = np.array([50 + (50 * int(x) * self.documents) // max(self.words, 1) for x in n], np.int64)
        counts = counts.astype(np.int64)
        return (1_000_000_000 * counts) // (1000 * counts + 20 * longs[owner])

    def coordinates(self, width: int) -> np.ndarray:
        """The coordinate of each term: its own for the most frequent ones, shared ones behind them."""
        rank = np.empty(len(self.holding), np.int64)
        rank[np.argsort(-self.holding, kind="stable")] = np.arange(len(rank))
        if len(rank) <= width:
            return rank
        own = width * 3 // 4
        return np.where(rank < own, rank, own + (rank - own) % (width - own))


def statistics(counted: DataFrame, terms: int) -> Statistics:
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    holding = np.zeros(terms, np.int64)
    # One row per term at most.
    for row in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        holding[row.t] = row.df
    return Statistics(total.docs, total.words, holding)


@dataclass
class Shard:
    """Some documents, their terms, and the blocks of the shard's posting lists."""

    # Document i has the entries ends[i]:ends[i + 1] of terms and impacts.
    ends: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    # Block b is of the list of block_terms[b] and has the documents block_docs[block_ends[b]:block_ends[b + 1]].
    block_terms: np.ndarray
    block_ends: np.ndarray
    block_docs: np.ndarray
    # Blocks x coordinates: the largest impact of its documents there, in UNITs, rounded up.
    summaries: np.ndarray

    ARRAYS = ("ends", "terms", "impacts", "block_terms", "block_ends", "block_docs")

    @classmethod
    def build(cls, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray, coordinates: np.ndarray, axes: np.ndarray) -> Shard:
        docs = owners(ends)
        pull = (weights[terms] * impacts).astype(np.float32)
        place = np.zeros((len(ends) - 1, axes.shape[1]), np.float32)
        np.add.at(place, docs, pull[:, None] * axes[terms])
        place /= np.maximum(np.sqrt((place * place).sum(axis=1, keepdims=True)), 1e-30)
        order = np.argsort(terms, kind="stable")
        listed, held = terms[order], docs[order]
        cuts = np.flatnonzero(np.diff(listed, prepend=-1))
        sizes = np.diff(np.append(cuts, len(listed)))
        starts = [cuts]
        for at, size in zip(cuts[sizes > BLOCK_DOCS].tolist(), sizes[sizes > BLOCK_DOCS].tolist()):
            mine = held[at : at + size]
            pivots = mine[:: BLOCK_DOCS]
            nearest = (place[mine] @ place[pivots].T).argmax(axis=1)
            by = np.argsort(nearest, kind="stable")
            held[at : at + size] = mine[by]
            starts.append(at + 1 + np.flatnonzero(np.diff(nearest[by])))
        starts = np.sort(np.concatenate(starts))
        width = int(coordinates.max()) + 1 if len(coordinates) else 0
        dense = np.zeros((len(ends) - 1, width), np.uint8)
        np.maximum.at(dense, (docs, coordinates[terms]), (-(-impacts // UNIT)).astype(np.uint8))
        if len(starts):
            summaries = np.maximum.reduceat(dense[held], starts, axis=0)
        else:
            summaries = np.zeros((0, width), np.uint8)
        return cls(ends, terms, impacts, listed[starts], np.append(starts, len(held)), held, summaries)

    def row(self) -> list[bytes]:
        """The arrays, each behind its length in bytes."""
        raw = [getattr(self, a).astype("<i4").tobytes() for a in self.ARRAYS] + [self.summaries.tobytes()]
        return [len(b).to_bytes(8, "little") + pa.compress(b, PACKED, asbytes=True) for b in raw]

    @classmethod
    def of_row(cls, row: Sequence[bytes]) -> Shard:
        raw = [pa.decompress(b[8:], int.from_bytes(b[:8], "little"), PACKED) for b in row]
        arrays = [np.frombuffer(b, "<i4").astype(np.int64) for b in raw[:-1]]
        blocks = len(arrays[3])
        return cls(*arrays, np.frombuffer(raw[-1], np.uint8).reshape(blocks, -1 if blocks else 0))


@dataclass
class Index:
    """A written index: its shards, the items it serves, and the weights of their terms."""

    shards: DataFrame
    items: Items
    weights: np.ndarray
    coordinates: np.ndarray


_BINARY = [*Shard.ARRAYS, "summaries"]


def build_index(docs: DataFrame, items: Items, path: str | None = None, text: str = "text") -> Index:
    """Reads the texts once, counts, and writes the shards to ``path`` (by default, to the shared folder)."""
    spark = docs.sparkSession
    counted_path = shared_dir(spark, "terms")
    term_counts(docs, items.terms, text).write.parquet(counted_path)
    counted = spark.read.parquet(counted_path)
    stats = statistics(counted, len(items.terms))
    weights, coordinates = stats.weights(), stats.coordinates(COORDINATES)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = np.random.default_rng(11).standard_normal((len(weights), PROJECTIONS)).astype(np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_DOCS):
                part = batch.slice(at, SHARD_DOCS)
                terms, counts = part.column(2), part.column(3)
                ends = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))]).astype(np.int64)
                impacts = stats.impacts(part.column(1).to_numpy(), owners(ends), counts.flatten().to_numpy())
                shard = Shard.build(ends, terms.flatten().to_numpy().astype(np.int64), impacts, weights, coordinates, axes)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([b], pa.binary()) for b in shard.row()]], names=["ids", *_BINARY])

    path = path or shared_dir(spark, "lexical")
    built = counted.mapInArrow(shards, "ids array<bigint>, " + ", ".join(f"{c} binary" for c in _BINARY))
    built.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return Index(spark.read.parquet(path), items, weights, coordinates)


class Best:
    """The k best documents of each item among the shards one task has seen."""

    def __init__(self, items: Items, weights: np.ndarray, coordinates: np.ndarray, k: int):
        self.k, n_items = k, len(items.ids)
        self.weights = np.zeros((len(weights), n_items))
        self.weights[items.term, items.item] = weights[items.term]
        # Each item's terms by rising weight, their weights in UNITs, and their coordinates.
        order = np.lexsort((items.term, weights[items.term], items.item))
        cuts = np.searchsorted(items.item[order], np.arange(n_items + 1))
        self.terms = [items.term[order[a:b]] for a, b in zip(cuts, cuts[1:])]
        self.pulls = [weights[t] * float(UNIT) for t in self.terms]
        self.columns = [coordinates[t] for t in self.terms]
        self.place = np.full(len(weights), -1)
        # A hit scores at least 1.
        self.floor = np.ones(n_items)
        self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.blocks = self.opened = 0

    def reached(self, shard: Shard, item: int) -> np.ndarray:
        """Blocks of the item's lists whose bound reaches its floor. All numbers are whole and below 2**53.

        A document is looked for in the list of its heaviest term only, so the bound of a block
        leaves out the terms that are heavier than its list's.
        """
        self.place[self.terms[item]] = np.arange(len(self.terms[item]))
        place = self.place[shard.block_terms]
        self.place[self.terms[item]] = -1
        blocks = np.flatnonzero(place >= 0)
        most = np.cumsum(shard.summaries[np.ix_(blocks, self.columns[item])] * self.pulls[item], axis=1)
        reach = blocks[most[np.arange(len(blocks)), place[blocks]] >= self.floor[item]]
        self.blocks, self.opened = self.blocks + len(blocks), self.opened + len(reach)
        return reach

    def candidates(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs of the blocks that may hold one of the k best."""
        sizes = np.diff(shard.block_ends)
        wanted = np.zeros((self.weights.shape[1], len(shard.ends) - 1), bool)
        for item in range(len(wanted)):
            block = self.reached(shard, item)
            wanted[item, shard.block_docs[_ranges(shard.block_ends[block], sizes[block])]] = True
        item, doc = np.nonzero(wanted)
        return doc, item

    def scores(self, shard: Shard, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        sizes = np.diff(shard.ends)[doc]
        out = np.zeros(len(doc))
        for at in _chunks(sizes, MAX_EXPANSION):
            entry = _ranges(shard.ends[doc[at]], sizes[at])
            each = shard.impacts[entry] * self.weights[shard.terms[entry], np.repeat(item[at], sizes[at])]
            # Candidates hold a term, so none is empty.
            out[at] = np.add.reduceat(each, np.cumsum(sizes[at]) - sizes[at])
        return out

    def feed(self, ids: pa.Array, shard: Shard) -> None:
        doc, item = self.candidates(shard)
        score = self.scores(shard, doc, item)
        good = score >= self.floor[item]
        doc, item, score = doc[good], item[good], score[good]
        if not len(doc):
            return
        null = ids.is_null().to_numpy(zero_copy_only=False)
        known = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        id_, null = np.concatenate([self.id, known[doc]]), np.concatenate([self.null, null[doc]])
        order = np.lexsort((id_, null, -score, item))
        begins = np.searchsorted(item[order], np.arange(len(self.floor)))
        rank = np.arange(len(order)) - begins[item[order]]
        last = order[rank == self.k - 1]
        self.floor[item[last]] = score[last]
        kept = order[rank < self.k]
        self.item, self.score, self.id, self.null = item[kept], score[kept], id_[kept], null[kept]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of ``starts[i]`` to ``starts[i] + sizes[i]``."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


def _chunks(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of items whose sizes are about ``limit`` together."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right"))
        end = max(end, at + 1)
        yield slice(at, end)
        at = end


def search(index: Index, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item of the index."""
    items, weights, coordinates = index.items, index.weights, index.coordinates
    schema = f"item_id {items.kind}, doc_id bigint, score bigint"
    ids = pa.array(items.ids, to_arrow_schema(StructType.fromDDL(schema)).field(0).type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, weights, coordinates, k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(1, batch.num_columns)]
                best.feed(batch.column(0)[i].values, Shard.of_row(row))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(best.item)), pa.array(best.id, mask=best.null), pa.array(best.score.astype(np.int64))], names=["item_id", "doc_id", "score"]
        )

    found = index.shards.mapInArrow(scan, schema)
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # In two steps, so that the hits of very many tasks do not meet in one.
    ways = found.withColumn("_way", F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)))
    first = Window.partitionBy("item_id", "_way").orderBy(*by)
    last = Window.partitionBy("item_id").orderBy(*by)
    few = ways.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("_way")
    return few.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text") -> DataFrame:
    """The k best documents of every item: each block of items has an index of its own."""
    found = None
    for block in item_blocks(items):
        hits = search(build_index(docs, block, text=text), k)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return found
