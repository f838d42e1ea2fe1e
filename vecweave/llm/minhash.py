"""Near-duplicates by DartMinHash signatures and banding.

A document is a weighted set: its shingles of five words, each with the number of its
occurrences. Every unit of weight throws hashed darts at the axis of ranks; a dart falls on
one of ``COORDS`` coordinates, and each coordinate keeps its earliest dart. Two signatures
agree in a coordinate with probability equal to the weighted Jaccard similarity. Darts are
drawn in strips of growing rank until all coordinates of a document are hit, so long documents
throw few darts per shingle and short ones many: the cost follows size + k log k.

``BANDS`` bands of ``ROWS`` coordinates find candidates (a pair at 0.8 shares none with
probability 2e-4); candidates are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecweave.llm.arrays import Rolling, mix, owners, text_slices, windows, words_of
from vecweave.llm.components import components, stored

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 28
COORDS = ROWS * BANDS
# Strips of ranks: [0, 1/16), then each 1.6 times as high as the one before.
_STRIPS = [0.0] + [1.6**i / 16 for i in range(60)]
# A pair of similarity s agrees in a sketch bit with probability (1 + s) / 2. At 0.8 fewer than
# 136 of 168 bits agree with probability 5e-5.
SKETCH_BITS = 136
# Rounds of hubs before the rest is compared pair by pair. They only save comparisons.
HUB_ROUNDS = 5


def units_of(data: np.ndarray, offsets: np.ndarray, hashes: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of weight (shingle, occurrence number), and where each text's begin.

    Letters A-Z count as a-z. A text of one to four words has one shingle; of none, none.
    """
    starts, ends, bounds = words_of(data, offsets)
    word = hashes.spans(hashes.sums(data), starts, ends)
    first = windows(bounds, SHINGLE)
    key = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        key = mix(key + word[first + k])
    text = owners(bounds)[first]
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHINGLE))
    whole = np.array([_fold(word[bounds[i] : bounds[i + 1]]) for i in short], np.uint64)
    key, text = np.concatenate([key, whole]), np.concatenate([text, short])
    order = np.argsort(key ^ mix(text.astype(np.uint64)), kind="stable")
    key, text = key[order], text[order]
    run = np.ones(len(key), bool)
    run[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(run)
    number = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    unit = np.where(number > 0, mix(key + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), key)
    order = np.argsort(text, kind="stable")
    return unit[order], np.searchsorted(text[order], np.arange(len(offsets)))


def _fold(words: np.ndarray) -> int:
    key = np.zeros(1, np.uint64)
    for w in words:
        key = mix(key + w)
    return int(mix(key ^ np.uint64(len(words)))[0])


def darts(units: np.ndarray, bounds: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Signatures, one row per set; a set without units has a row of zeros."""
    n = len(bounds) - 1
    signature = np.zeros((n, coords), np.uint64)
    best = np.full(n * coords, np.inf)
    owner = owners(bounds)
    open_units = np.arange(len(units))
    for strip, (low, high) in enumerate(zip(_STRIPS[:-1], _STRIPS[1:])):
        if not len(open_units):
            break
        u = units[open_units]
        seed = mix(u ^ np.uint64((strip + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        # The number of darts in the strip is Poisson with the strip's height as mean.
        mean, term, total, cdf = high - low, np.exp(-(high - low)), 0.0, []
        while total < 1 - 1e-12 and len(cdf) < 40 + 4 * mean:
            total += term
            cdf.append(total)
            term *= mean / len(cdf)
        count = np.searchsorted(np.array(cdf[:-1]), (seed >> np.uint64(11)) * 2.0**-53, "right")
        thrown = np.repeat(np.arange(len(u)), count)
        begin = np.cumsum(count) - count
        nth = (np.arange(len(thrown)) - begin[thrown]).astype(np.uint64)
        dart = mix(seed[thrown] + (nth + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        slot = owner[open_units[thrown]] * coords + ((dart >> np.uint64(40)) % np.uint64(coords)).astype(np.int64)
        rank = low + (high - low) * ((mix(dart) >> np.uint64(11)) * 2.0**-53)
        # Later strips have later ranks: a coordinate that was hit before is settled.
        free = np.isinf(best[slot])
        slot, rank, dart = slot[free], rank[free], dart[free]
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        signature.reshape(-1)[slot[won]] = dart[won]
        full = ~np.isinf(best.reshape(n, coords)).any(axis=1) if coords else np.ones(n, bool)
        open_units = open_units[~full[owner[open_units]]]
    return signature


_SIGNED = "doc_id bigint, text_hash bigint, n_units bigint, f1 bigint, f2 bigint, s0 bigint, s1 bigint, s2 bigint, bands array<bigint>"


def prints_of(units: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set, whatever the order of its units."""
    sums = np.zeros((2, len(units) + 1), np.uint64)
    np.cumsum(mix(units ^ np.uint64(0x5851F42D4C957F2D)), out=sums[0, 1:])
    np.cumsum(mix(units ^ np.uint64(0x14057B7EF767814F)), out=sums[1, 1:])
    return sums[:, bounds[1:]] - sums[:, bounds[:-1]]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Rolling(10, fold=True)
    band_salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for batch in batches:
        for first, end, data, offsets in text_slices(batch.column(1)):
            units, bounds = units_of(data, offsets, hashes)
            size = np.diff(bounds)
            prints = prints_of(units, bounds)
            signature = darts(units, bounds)
            key = np.repeat(band_salt[None, :], end - first, axis=0)
            for r in range(ROWS):
                key = mix(key + signature[:, r::ROWS][:, :BANDS])
            bits = np.zeros((end - first, 192), np.uint8)
            bits[:, :COORDS] = signature & np.uint64(1)
            sketch = np.packbits(bits, axis=1).view(np.int64)
            held = size > 0
            offs = np.concatenate([[0], np.cumsum(np.where(held, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, end - first),
                    batch.column(2).slice(first, end - first),
                    pa.array(size.astype(np.int64)),
                    *[pa.array(p.view(np.int64)) for p in prints],
                    *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(3)],
                    pa.ListArray.from_arrays(pa.array(offs), pa.array(key[held].reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "text_hash", "n_units", "f1", "f2", "s0", "s1", "s2", "bands"],
            )


def _list_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Rolling(10, fold=True)
    for batch in batches:
        for first, end, data, offsets in text_slices(batch.column(1)):
            units, bounds = units_of(data, offsets, hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, end - first),
                    *[pa.array(p.view(np.int64)) for p in prints_of(units, bounds)],
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(units.view(np.int64))),
                ],
                names=["doc_id", "f1", "f2", "units"],
            )


def _plain(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    whole = F.col(f"`{text}`")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_hash"))


def signatures(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, size, content fingerprints, bit sketch and band keys of each document."""
    return _plain(docs, text, id_col).mapInArrow(_sign, _SIGNED)


def _class_links(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: the classes of the pairs (x, y) whose similarity reaches the threshold; one row per two classes."""
    left = units.select(F.col("node").alias("x"), F.col("units").alias("ux"))
    right = units.select(F.col("node").alias("y"), F.col("units").alias("uy"))
    joined = pairs.join(left, "x").join(right, "y").filter(_reaches(F.col("ux"), F.col("uy"), threshold))
    return joined.groupBy(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b")).agg(F.count("*").alias("n"))


def _contracted(classes: DataFrame, links: DataFrame) -> DataFrame | None:
    """``classes`` (node, comp) after joining linked classes; None where no link is left."""
    links = stored(links, "links")
    if links.isEmpty():
        return None
    merged = components(links).select(F.col("node").alias("_was"), F.col("comp").alias("_now"))
    joined = classes.join(merged, F.col("comp") == F.col("_was"), "left")
    return stored(joined.select("node", F.coalesce("_now", "comp").alias("comp")), "classes")


def _reaches(x: Column, y: Column, threshold: float) -> Column:
    """Is the Jaccard similarity of two sets at least the threshold; sizes are compared first."""
    total = F.size(x) + F.size(y)
    enough = F.size(F.array_intersect(x, y)) * (1 + threshold) >= threshold * total
    return (F.least(F.size(x), F.size(y)) * (1 + threshold) >= threshold * total) & enough


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, n_units, kept``.

    ``class_id`` is the smallest doc_id of the documents connected by links of similarity
    ``threshold`` or more; ``kept`` marks that document.
    """
    return _classified(docs, text, id_col, threshold).drop("text_hash")


def _classified(docs: DataFrame, text: str, id_col: str, threshold: float) -> DataFrame:
    """``near_duplicates`` with a hash of the text, which tells rows of one doc_id apart.

    Documents of equal shingles are one node from the start. In a bucket (documents equal in one
    band) a hub is drawn, and each node compared with the hub it shares most bands with. In the
    rounds that follow, every bucket that still holds several classes draws a new hub, and nodes
    of other classes are compared with it; of what is found one link per two classes is kept,
    and classes are joined, so the links a round hands on are as many as its classes, not as its
    similar pairs. What is then still in different classes of one bucket is compared pair by pair,
    in the first band of the two and where their bit sketches allow the threshold.

    Banding loses a pair at exactly 0.8 with probability 2e-4, the sketch (in the last step only) with 5e-5.

    A document without words is a class of its own. A row without doc_id is not linked and has a
    null class, kept. Rows of one doc_id and one text share their fate; rows of one doc_id and
    different texts are different documents. Other columns are not read; an empty table gives no rows.
    """
    signed = stored(signatures(docs, text, id_col), "signatures")
    prints = ["f1", "f2", "n_units"]
    known = signed.filter("n_units > 0 AND doc_id IS NOT NULL")
    alike = known.groupBy(*prints).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("s0", "s1", "s2", "bands")])
    # Numbered once, then read from the written table.
    nodes = stored(alike.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", "s0", "s1", "s2", "bands", F.posexplode("bands").alias("band", "key")).drop("bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    buckets = stored(bands.join(shared, "key"), "buckets")
    asked = buckets.select("node").distinct()
    classes = stored(asked.withColumn("comp", F.col("node")), "classes")
    asked = nodes.join(asked, "node", "left_semi").select("node", "doc_id", *prints)
    texts = _plain(docs, text, id_col).join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    listed = texts.mapInArrow(_list_units, "doc_id bigint, f1 bigint, f2 bigint, units array<bigint>")
    units = asked.join(listed, ["doc_id", "f1", "f2"]).dropDuplicates(["node"]).select("node", "units")
    units = stored(units, "units")

    for turn in range(HUB_ROUNDS):
        pairs = _hub_pairs(buckets, classes, turn)
        if turn == 0:
            pairs = pairs.groupBy("x").agg(F.max_by(F.struct("y", "cx", "cy"), F.struct("n", F.xxhash64("x", "y"))).alias("p")).select("x", "p.*")
        joined = _contracted(classes, _class_links(pairs, units, threshold))
        if joined is None and turn > 0:
            break
        classes = joined or classes
    left = buckets.join(classes, "node")
    split = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    bandlists = nodes.select("node", "bands")
    open_rows = stored(left.join(split, "key").join(units, "node").join(bandlists, "node"), "open")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    agree = F.lit(192) - sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in ("s0", "s1", "s2")), F.lit(0))
    other = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    same_band = F.zip_with("x.bands", "y.bands", lambda a, b: a == b)
    first_band = F.array_position(same_band, True) == F.col("x.band") + 1
    near = other & (agree >= SKETCH_BITS + 24) & first_band & _reaches(F.col("x.units"), F.col("y.units"), threshold)
    cx, cy = F.col("x.comp"), F.col("y.comp")
    found = x.join(y, near).groupBy(F.least(cx, cy).alias("a"), F.greatest(cx, cy).alias("b")).agg(F.count("*").alias("n"))
    classes = _contracted(classes, found) or classes

    # Classes by their smallest doc_id; a node holds all rows of its shingles.
    of_node = nodes.select("node", "doc_id", "rows", *prints).join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = of_node.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size"))
    first = of_node.join(sizes, "comp").select(*prints, "class_id", "class_size")
    out = signed.join(first, prints, "left")
    known_id, alone = F.col("doc_id").isNotNull(), F.col("n_units") == 0
    class_id = F.when(known_id, F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")))
    return out.select(
        "doc_id",
        class_id.alias("class_id"),
        F.when(known_id, F.coalesce("class_size", F.lit(1))).otherwise(1).alias("class_size"),
        "n_units",
        (~known_id | (F.col("doc_id") == class_id)).alias("kept"),
        "text_hash",
    )


def _hub_pairs(buckets: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """``x, y, cx, cy, n``: nodes and hubs of other classes in their buckets; of a class's hubs the one with most bands in common."""
    rows = buckets.select("key", "node").join(classes, "node")
    drawn = F.min_by(F.struct("node", "comp"), F.xxhash64("node", "key", F.lit(turn)))
    hubs = rows.groupBy("key").agg(drawn.alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    met = rows.join(hubs, "key").filter(F.col("comp") != F.col("hub.comp"))
    each = met.groupBy(F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("hub.node").alias("y"), F.col("hub.comp").alias("cy")).agg(F.count("*").alias("n"))
    best = each.groupBy("x", "cx", "cy").agg(F.max_by("y", F.struct("n", F.xxhash64("x", "y"))).alias("y"), F.max("n").alias("n"))
    return best.select("x", "y", "cx", "cy", "n")


def keep_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, but one document of each class only."""
    rows = _classified(docs, text, id_col, threshold).filter("NOT kept")
    gone = stored(rows.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    same = (docs[f"`{id_col}`"] == F.col("_gone")) & (F.xxhash64(docs[f"`{text}`"]) == F.col("_hash"))
    return docs.join(gone, same, "left_anti")
