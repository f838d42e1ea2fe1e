"""A k-nearest-neighbour graph of a whole vector table, by neighbour descent.

No row meets all others. A first graph comes from several orders of the rows along random
projections, in which blocks of consecutive rows are scored against each other. Then rounds: a
row's neighbours, and the rows that have it as neighbour, are scored against each other wherever one
of the two is new, and each row keeps its best. What moves per round is bounded by the number of
rows: 2k neighbours and at most 2k of the rows that point back, with their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecweave.functions.binding import once
from vecweave.plans.topk import significant, unit, vector_matrix
from vecweave.schemas import METRICS, require
from vecweave.session import shared_dir, stored

DEFAULT_NEIGHBOURS = 10
# Rows of a first block, all scored against each other; orders to cut into blocks.
BLOCK_ROWS = 128
ORDERS = 4
# Bits of the first key of an order: one per random hyperplane.
PLANES = 12
# Orders are cut into ranges at the keys of about this many rows, drawn by a hash of their ids.
SAMPLE_ROWS = 50_000
MAX_RANGES = 4096
# While the graph is built a row keeps this many neighbours for each one asked for.
WIDTH = 2
# Rounds at most, and the share of edges that must change for another one.
ROUNDS = 12
TOLERANCE = 0.001
# Groups whose neighbours are scored side by side.
GROUPS_AT_ONCE = 256

_EDGE = "id {0}, neighbour {0}, score double"


def pair_scores(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows of ``x`` with rows of ``y``, summed in one order, so a pair scores the same wherever it is met."""
    if metric == "euclidean":
        return significant(-np.sqrt(((x - y) * (x - y)).sum(axis=1)))
    dot = (x * y).sum(axis=1)
    if metric == "cosine":
        length = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
        dot = np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)
    return significant(dot)


def _products(m: np.ndarray, metric: str) -> np.ndarray:
    """All scores within each group of a (groups, rows, dimensions) array; good enough to choose by."""
    if metric == "cosine":
        flat = unit(m.reshape(-1, m.shape[2])).reshape(m.shape)
        return flat @ flat.transpose(0, 2, 1)
    dot = m @ m.transpose(0, 2, 1)
    if metric == "dot_product":
        return dot
    square = (m * m).sum(axis=2)
    return 2.0 * dot - square[:, :, None] - square[:, None, :]


def _best_pairs(m: np.ndarray, allowed: np.ndarray, k: int, metric: str, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, row and partner of the k best allowed partners of each row, if they score above its floor."""
    scores = _products(m, metric)
    if floor is not None:
        # Products of distances are their squares; what is no better than rounding is no better.
        least = -(floor * floor) if metric == "euclidean" else floor
        allowed = allowed & (scores > (least + 1e-9 * np.maximum(1.0, np.where(np.isfinite(least), np.abs(least), 0.0)))[:, :, None])
    scores = np.where(allowed, scores, -np.inf)
    k = min(k, scores.shape[2])
    partner = np.argpartition(-scores, k - 1, axis=2)[:, :, :k]
    group, row, place = np.nonzero(np.take_along_axis(scores, partner, axis=2) > -np.inf)
    return group, row, partner[group, row, place]


def _in_order(vectors: DataFrame, order: int, seed: int, dim: int, n: int, block: int) -> DataFrame:
    """``id, embedding, range`` along random projections, each range together and sorted.

    The key is the cell of a row between random hyperplanes, neighbouring cells next to each
    other, then its place along one more direction, then a hash, which spreads equal vectors over
    ranges. Which rows share a range depends on the data and the seed, not on partitions.
    """
    planes = np.random.default_rng([seed, order]).standard_normal((PLANES + 1, dim))
    weights = 1 << np.arange(PLANES)[::-1]

    @F.arrow_udf("double")
    def place(column: pa.Array) -> pa.Array:
        seen = unit(vector_matrix(column, dim)) @ planes.T
        cell = (seen[:, :PLANES] > 0) @ weights
        # Cells whose numbers follow each other differ in one plane.
        for shift in (1, 2, 4, 8):
            cell = cell ^ (cell >> shift)
        return pa.array(cell + 1.0 / (1.0 + np.exp(-seen[:, PLANES])))

    draw = F.pmod(F.xxhash64("id", F.lit(seed + order)), F.lit(1 << 32))
    keyed = vectors.withColumn("_key", once(place)("embedding") + draw / float(1 << 32) * 1e-6)
    ranges = int(min(MAX_RANGES, max(1, n // (8 * block))))
    share = min(1.0, SAMPLE_ROWS / n)
    drawn = sorted(r[0] for r in keyed.filter(draw < int(share * (1 << 32))).select("_key").collect()) if ranges > 1 else []
    cuts = np.array([drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else [])

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, keys.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    ranged = keyed.withColumn("_range", once(range_of)("_key")).repartition("_range").sortWithinPartitions("_range", "_key")
    return ranged.select("id", "embedding", "_range")


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Consecutive rows of one range, ``block`` of them, wherever batches begin."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        ranges = table.column(2).to_numpy()
        starts = np.append(np.flatnonzero(np.diff(ranges, prepend=ranges[:1] - 1)), len(ranges))
        for start, end in zip(starts[:-1], starts[1:]):
            last = end == len(ranges)
            full = start + (end - start) // block * block
            for at in range(start, full, block):
                yield table.slice(at, block)
            if not last and full < end:
                yield table.slice(full, end - full)
        held = table.slice(full) if len(ranges) else None
    if held is not None and held.num_rows:
        yield held


def _block_edges(rows: DataFrame, k: int, metric: str, block: int, id_type: str) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, block):
            m = vector_matrix(part.column(1))
            _, row, partner = _best_pairs(m[None], ~np.eye(len(m), dtype=bool)[None], k, metric)
            yield _edges(part.column(0).combine_chunks(), m, row, partner, metric)

    return rows.mapInArrow(score, _EDGE.format(id_type))


def _edges(ids: pa.Array, m: np.ndarray, row: np.ndarray, partner: np.ndarray, metric: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row)), ids.take(pa.array(partner)), pa.array(pair_scores(m[row], m[partner], metric))], names=["id", "neighbour", "score"]
    )


def _local_joins(groups: DataFrame, k: int, metric: str, id_type: str) -> DataFrame:
    """Edges between the members of each group (a list of id, fresh, floor, embedding) where one of the two is fresh.

    ``floor`` is the score of a member's worst neighbour so far, null while it has too few.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUPS_AT_ONCE):
                members = batch.column(0).slice(start, GROUPS_AT_ONCE)
                sizes = members.value_lengths().to_numpy()
                flat = members.flatten()
                vectors = vector_matrix(flat.field("embedding"))
                fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
                # Groups of different sizes in one array; what fills them up pairs with nothing.
                most = int(sizes.max())
                at = np.full((len(sizes), most), -1)
                at[np.arange(most) < sizes[:, None]] = np.arange(len(vectors))
                m = np.where((at >= 0)[:, :, None], vectors[at], 0.0)
                new = (at >= 0) & fresh[at]
                floor = flat.field("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)[at]
                allowed = (new[:, :, None] | new[:, None, :]) & (at >= 0)[:, :, None] & (at >= 0)[:, None, :] & ~np.eye(most, dtype=bool)
                group, row, partner = _best_pairs(m, allowed, k, metric, floor)
                yield _edges(flat.field("id"), vectors, at[group, row], at[group, partner], metric)

    return groups.mapInArrow(score, _EDGE.format(id_type))


def _k_best(edges: DataFrame, k: int) -> DataFrame:
    """Each id's k best distinct neighbours. Ties are decided by a hash of the pair, or a group of copies would all point to the same few rows."""
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.xxhash64("id", "neighbour"), "neighbour")
    each = edges.groupBy("id", "neighbour").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _around(graph: DataFrame, k: int) -> DataFrame:
    """``centre, id, fresh``: each row, its neighbours, and at most k rows that have it as neighbour; only where one is fresh."""
    forth = graph.select(F.col("id").alias("centre"), F.col("neighbour").alias("id"), "fresh")
    drawn = Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("centre", "id"), "id")
    back = graph.select(F.col("neighbour").alias("centre"), "id", "fresh")
    back = back.withColumn("_n", F.row_number().over(drawn)).filter(F.col("_n") <= k).drop("_n")
    own = graph.select(F.col("id").alias("centre"), "id", F.lit(False).alias("fresh")).distinct()
    every = forth.unionByName(back).unionByName(own).repartition("centre").groupBy("centre", "id").agg(F.max("fresh").alias("fresh"))
    # No vector is sent to a centre that has nothing to compare.
    busy = F.max("fresh").over(Window.partitionBy("centre"))
    return every.withColumn("_busy", busy).filter("_busy").drop("_busy")


def knn_graph(
    store: DataFrame,
    k: int = DEFAULT_NEIGHBOURS,
    metric: str = "cosine",
    path: str | None = None,
    rounds: int = ROUNDS,
    seed: int = 42,
    block: int = BLOCK_ROWS,
    orders: int = ORDERS,
) -> DataFrame:
    """``id, neighbour, score, rank``: nearly the k nearest other rows of each row, written to ``path``.

    ``store`` has ``id`` (unique) and ``embedding``. Scores are exact and higher is better; only
    which rows are met is approximate, ``recall`` against exact search says how well. The result
    depends on the data and the seed alone. Rows without a vector, or with a component that
    is not finite, are no nodes; fewer than k + 1 rows have as many neighbours as there are.
    """
    require(metric, METRICS, "metric")
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = store.sparkSession
    finite = F.forall(F.transform("embedding", lambda x: F.abs(x.cast("double"))), lambda x: x < F.lit(float("inf")))
    vectors = stored(store.filter((F.size("embedding") > 0) & finite).select("id", "embedding"), "vectors")
    id_type = vectors.schema["id"].dataType.simpleString()
    path = path or shared_dir(spark, "knn-graph")
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if shape.n == 0:
        empty = spark.createDataFrame([], _EDGE.format(id_type) + ", rank int")
        empty.write.parquet(path)
        return spark.read.parquet(path)
    wide = WIDTH * k
    edges = None
    for order in range(orders):
        found = _block_edges(_in_order(vectors, order, seed, shape.dim, shape.n, block), wide, metric, block, id_type)
        edges = found if edges is None else edges.unionByName(found)
    graph = stored(_k_best(edges.withColumn("fresh", F.lit(True)), wide), "graph")
    for _ in range(rounds):
        if graph.filter("fresh").count() <= TOLERANCE * wide * shape.n:
            break
        floors = graph.groupBy("id").agg(F.when(F.count("*") >= wide, F.min("score")).alias("floor"))
        around = _around(graph, wide).join(vectors.join(floors, "id", "left"), "id")
        members = F.array_sort(F.collect_list(F.struct("id", "fresh", "floor", "embedding")))
        groups = around.groupBy("centre").agg(members.alias("members"))
        met = _local_joins(groups.select("members"), wide, metric, id_type).withColumn("fresh", F.lit(True))
        known = graph.select("id", "neighbour", "score", F.lit(False).alias("fresh"))
        graph = stored(_k_best(known.unionByName(met), wide), "graph")
    graph.filter(F.col("rank") <= k).select("id", "neighbour", "score", "rank").write.parquet(path)
    return spark.read.parquet(path)


def graph_recall(graph: DataFrame, exact: DataFrame) -> DataFrame:
    """Per id: how many of its exact neighbours' scores the graph reaches.

    ``exact`` has ``id, neighbour, score``. A neighbour counts if it scores at least as well as the worst of the
    exact ones, so among equally near rows any will do.
    """
    worst = exact.groupBy("id").agg(F.count("*").alias("n_exact"), F.min("score").alias("worst"))
    good = graph.join(worst, "id").filter(F.col("score") >= F.col("worst") - 1e-9).groupBy("id").agg(F.count("*").alias("n_found"))
    counted = worst.join(good, "id", "left").select("id", "n_exact", F.coalesce("n_found", F.lit(0)).alias("n_found"))
    return counted.withColumn("recall", F.col("n_found") / F.col("n_exact"))
