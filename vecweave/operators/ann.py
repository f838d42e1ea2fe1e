"""Approximate search: two-level coarse lists (IVF) and random projections (LSH).

Both narrow what is scored; the scoring and merging is that of exact search.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecweave.functions.binding import once
from vecweave.functions.vectors import normalize
from vecweave.operators.search import DEFAULT_K, filter_condition, shape_results
from vecweave.plans.topk import top_k, unit, vector_matrix
from vecweave.schemas import METRICS, require
from vecweave.session import stored

DEFAULT_LISTS = 100
DEFAULT_PROBES = 10
# Centroids are trained on at most about this many rows per list, drawn by a hash; every row is indexed and searched.
TRAIN_ROWS_PER_LIST = 256
ITERATIONS = 10
# Lists to probe are chosen with this many rows of the sample as queries, so that they find this share of their nearest rows.
TRIAL_QUERIES = 200
TARGET_RECALL = 0.93


@dataclass
class IvfIndex:
    """Coarse centroids in two levels, and the metric they serve.

    A vector goes to the nearest of ``tops`` and then to the nearest of that one's own lists,
    ``centroids[bounds[t]:bounds[t + 1]]``. Both matrices are bounded by the number of lists.
    """

    tops: np.ndarray
    centroids: np.ndarray
    bounds: np.ndarray
    metric: str
    # Lists a query looks into unless told otherwise.
    nprobe: int = DEFAULT_PROBES

    @classmethod
    def given(cls, centroids: Sequence[Sequence[float]] | np.ndarray, metric: str = "cosine") -> IvfIndex:
        """Lists that are known already; all of them under one top."""
        lists = np.asarray(centroids, float)
        return cls(lists.mean(axis=0, keepdims=True), lists, np.array([0, len(lists)]), metric)

    def scaled(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as they are compared with centroids."""
        return unit(vectors) if self.metric == "cosine" else vectors

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The list of each vector: about 2 * sqrt(lists) distances instead of all."""
        m = self.scaled(vectors)
        top = nearest(m, self.tops)
        out = np.empty(len(m), np.int64)
        for t in np.unique(top):
            mine = np.flatnonzero(top == t)
            out[mine] = self.bounds[t] + nearest(m[mine], self.centroids[self.bounds[t] : self.bounds[t + 1]])
        return out

    def probes(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first, among all lists."""
        return np.argsort(_far(self.scaled(vectors), self.centroids), axis=1, kind="stable")[:, :n]


def _far(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids * centroids).sum(axis=1)[None, :] - 2.0 * (m @ centroids.T)


def nearest(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return _far(m, centroids).argmin(axis=1)


def k_means(rows: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """At most k means of a small matrix; rows come in random order, and each round the emptiest mean moves to the farthest row."""
    centres = np.unique(rows[: 4 * k], axis=0)
    centres = centres[:: max(1, len(centres) // k)][:k]
    for _ in range(iterations):
        far = _far(rows, centres)
        home = far.argmin(axis=1)
        size = np.bincount(home, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        centres = np.divide(sums, size[:, None], out=centres.copy(), where=size[:, None] > 0)
        if (size == 0).any():
            centres[size.argmin()] = rows[far[np.arange(len(rows)), home].argmax()]
    return centres


def _coarse_vector(df: DataFrame, metric: str) -> DataFrame:
    v = normalize(F.col("embedding"), strict=False) if metric == "cosine" else F.col("embedding")
    return df.withColumn("_v", array_to_vector(F.coalesce(v, F.col("embedding")).cast("array<double>")))


def train_ivf(
    store: DataFrame,
    lists: int = DEFAULT_LISTS,
    metric: str = "cosine",
    seed: int = 42,
    max_iter: int = ITERATIONS,
    rows_per_list: int = TRAIN_ROWS_PER_LIST,
    target: float = TARGET_RECALL,
) -> IvfIndex:
    """Centroids in two levels from a sample of about ``lists * rows_per_list`` rows, drawn by a hash of their ids.

    The first level is k-means on Spark, sqrt(lists) of it. The second is trained for all tops
    at once, each in one task from at most its own lists' share of rows, so a top that holds
    much of the sample is no larger than the others. How many lists a search probes by default is
    measured on the sample: enough for a share of ``target`` of the nearest rows.
    """
    require(metric, METRICS, "metric")
    vectors = store.filter(F.size("embedding") > 0)
    key = F.xxhash64("id" if "id" in store.columns else "embedding", F.lit(seed))
    drawn = vectors.select("embedding", key.alias("_draw"))
    share = lists * rows_per_list / max(1, drawn.count())
    if share < 1.0:
        drawn = drawn.filter(F.pmod("_draw", F.lit(1 << 32)) < int(share * (1 << 32)))
    drawn = stored(drawn, "ivf-sample")
    n_tops = max(1, isqrt(lists))
    train = _coarse_vector(drawn, metric).select("_v")
    tops = np.array(KMeans(k=n_tops, seed=seed, maxIter=max_iter, featuresCol="_v").fit(train).clusterCenters())
    first = IvfIndex.given(tops, metric)
    per_top = ceil(lists / len(tops))
    mine = Window.partitionBy("list_id").orderBy("_draw")
    rows = assign_lists(drawn, first).withColumn("_n", F.row_number().over(mine)).filter(F.col("_n") <= per_top * rows_per_list)

    def second(group: pa.Table) -> pa.Table:
        ordered = group.take(pa.array(np.argsort(group.column("_n").to_numpy())))
        found = k_means(first.scaled(vector_matrix(ordered.column("embedding"))), per_top, max_iter)
        return pa.table({"list_id": pa.array(np.full(len(found), group.column("list_id")[0].as_py(), np.int32)), "centroid": pa.array(found.tolist(), pa.list_(pa.float64()))})

    # At most as many rows as there are lists.
    trained = rows.select("list_id", "_n", "embedding").groupBy("list_id").applyInArrow(second, "list_id int, centroid array<double>").collect()
    trained = sorted((r["list_id"], tuple(r["centroid"])) for r in trained)
    bounds = np.searchsorted([t for t, _ in trained], np.arange(len(tops) + 1))
    held = np.diff(bounds) > 0
    index = IvfIndex(tops[held], np.array([c for _, c in trained]), np.append(bounds[:-1][held], len(trained)), metric)
    index.nprobe = _enough_probes(index, drawn, target)
    return index


def _enough_probes(index: IvfIndex, sample: DataFrame, target: float) -> int:
    """The fewest lists in which rows of the sample find ``target`` of their nearest others in the sample.

    In the whole table nearest rows are nearer still, so they are in the same lists or in nearer ones.
    """
    rows = assign_lists(sample.withColumnRenamed("_draw", "id"), index)
    asked = rows.orderBy("id").limit(TRIAL_QUERIES).select(F.col("id").alias("query_id"), "embedding")
    found = top_k(asked, rows, DEFAULT_K + 1, index.metric).filter("query_id <> id").select("query_id", "list_id").collect()
    queries = asked.toArrow()
    if not found:
        return 1
    order = index.probes(vector_matrix(queries.column("embedding"), index.tops.shape[1]), len(index.centroids))
    place = dict(zip(queries.column("query_id").to_pylist(), np.argsort(order, axis=1)))
    needed = np.sort([place[r["query_id"]][r["list_id"]] for r in found])
    return int(needed[min(len(needed) - 1, ceil(target * len(needed)) - 1)]) + 1


def assign_lists(store: DataFrame, index: IvfIndex) -> DataFrame:
    """Add ``list_id``, the nearest list of the nearest top."""

    @F.arrow_udf("int")
    def home(vectors: pa.Array) -> pa.Array:
        return pa.array(index.assign(vector_matrix(vectors, index.tops.shape[1])).astype(np.int32))

    return store.filter(F.size("embedding") > 0).withColumn("list_id", once(home)("embedding"))


def write_lists(listed: DataFrame, path: str) -> None:
    """Write by list, so that a search reads only the probed ones.

    Files are balanced: rows of a list go together, and a list with much of the data is
    split over several tasks.
    """
    listed.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(path)


def probe_lists(queries: DataFrame, index: IvfIndex, nprobe: int) -> DataFrame:
    """Add ``codes``: the nprobe nearest lists of each query."""
    n = min(nprobe, len(index.centroids))

    @F.arrow_udf("array<bigint>")
    def near(vectors: pa.Array) -> pa.Array:
        lists = index.probes(vector_matrix(vectors, index.tops.shape[1]), n).astype(np.int64)
        ends = np.arange(len(lists) + 1, dtype=np.int32) * n
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.ravel()))

    return queries.filter(F.size("embedding") > 0).withColumn("codes", once(near)("embedding"))


def ivf_search(
    queries: DataFrame,
    listed_store: DataFrame,
    index: IvfIndex,
    k: int = DEFAULT_K,
    nprobe: int | None = None,
    filters: dict[str, object] | None = None,
    threshold: float | None = None,
    **limits: int,
) -> DataFrame:
    """Top k among the rows of each query's nearest lists, ``nprobe`` or the index's own number of them.

    The probed lists are a small table (no more rows than there are lists) that is joined to
    the scan: on a dataset written by ``write_lists`` Spark prunes the folders of all other
    lists while the query runs. A task multiplies the rows of a list with the queries that
    probe it only. A list with much of the data stays spread over its files: nothing is grouped by list.
    """
    probed = stored(probe_lists(queries, index, nprobe or index.nprobe).select("query_id", "embedding", "codes"), "probed")
    wanted = stored(probed.select(F.explode(F.col("codes").cast("array<int>")).alias("list_id")).distinct(), "lists")
    # The filter says nothing new; it marks the lists as a selection, which prunes the scan.
    source = listed_store.join(F.broadcast(wanted.filter("list_id >= 0")), "list_id", "left_semi")
    if filters:
        source = source.filter(filter_condition(source, filters))
    ranked = top_k(probed, source, k, index.metric, threshold, list_column="list_id", **limits)
    return shape_results(ranked, index.metric)


@dataclass
class LshIndex:
    """Random directions (tables x dimensions) and the width of a bucket along them."""

    directions: np.ndarray
    bucket_length: float

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A bucket and its table in one number for each table, so equal codes mean a shared bucket."""
        tables = len(self.directions)
        return np.floor(unit(vectors) @ self.directions.T / self.bucket_length).astype(np.int64) * tables + np.arange(tables)


def train_lsh(store: DataFrame, bucket_length: float = 2.0, tables: int = 5, seed: int = 42) -> LshIndex:
    """Random projections for Euclidean closeness (of unit vectors, so of cosine too)."""
    one = store.filter(F.size("embedding") > 0).select(F.size("embedding").alias("dim")).first()
    drawn = np.random.default_rng(seed).standard_normal((tables, one.dim if one else 1))
    return LshIndex(unit(drawn), bucket_length)


def _lsh_codes(df: DataFrame, index: LshIndex, out: str) -> DataFrame:
    tables = len(index.directions)

    @F.arrow_udf("array<bigint>")
    def codes(vectors: pa.Array) -> pa.Array:
        found = index.codes(vector_matrix(vectors, index.directions.shape[1]))
        ends = np.arange(len(found) + 1, dtype=np.int32) * tables
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return df.filter(F.size("embedding") > 0).withColumn(out, once(codes)("embedding"))


def lsh_search(
    queries: DataFrame,
    store: DataFrame,
    index: LshIndex,
    k: int = DEFAULT_K,
    metric: str = "cosine",
    filters: dict[str, object] | None = None,
    threshold: float | None = None,
    **limits: int,
) -> DataFrame:
    """Top k among rows that share a bucket with the query in at least one table, scored exactly.

    A bucket with much of the store is no hot key: rows are scored where they are and
    each task keeps its k best.
    """
    require(metric, METRICS, "metric")
    source = store.filter(filter_condition(store, filters)) if filters else store
    coded, asked = _lsh_codes(source, index, "_codes"), _lsh_codes(queries, index, "codes")
    return shape_results(top_k(asked, coded, k, metric, threshold, code_column="_codes", **limits), metric)
