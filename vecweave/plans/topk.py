"""Top-k of every query over a distributed store.

Scoring is a matrix product per Arrow batch. Each task keeps only the k best rows
per query, so what is shuffled is k rows per query and task, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vecweave.session import shared_dir, stored

# A query block sent to all tasks holds at most this many vector components (32 MB as doubles) ...
MAX_BLOCK_COMPONENTS = 4_000_000
# ... and this many queries.
MAX_BLOCK_QUERIES = 4096
# Blocks that are sent and scored side by side.
BLOCKS_AT_ONCE = 2
# Scores of one slice: rows x queries.
MAX_SLICE_SCORES = 2_000_000
# With codes: below this share of allowed pairs, only those are scored, one by one.
SPARSE_SHARE = 0.1
# Scores that agree in this many significant digits, whatever their size, are the same score: what is left
# is the rounding of sums, which must not decide between equal texts. Ties go to the smaller id.
DIGITS = 12
_ROUNDING = 10.0 ** (1 - DIGITS)
# Fan-in of the first merge of per-task results.
MERGE_WAYS = 32


def vector_matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """An Arrow list column as a (rows, dim) matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, dim or 0))
    sizes = np.diff(column.offsets.to_numpy())
    want = int(sizes[0]) if dim is None else dim
    if (sizes != want).any():
        raise ValueError(f"vector lengths differ: {want} and {int(sizes[sizes != want][0])}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, want)


def unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def significant(x: np.ndarray) -> np.ndarray:
    """``x`` rounded to DIGITS significant digits."""
    size = np.abs(x)
    with np.errstate(divide="ignore"):
        power = np.where(size > 0, np.floor(np.log10(size)), 0.0)
    # Two steps, as one factor alone may overflow for tiny scores.
    shift = DIGITS - 1 - power
    half = np.trunc(shift / 2)
    up, rest = 10.0**half, 10.0 ** (shift - half)
    return np.round(x * up * rest) / rest / up


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    ids = column.to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids


@dataclass
class LocalTopK:
    """The k best rows per query among the batches one task has seen."""

    queries: np.ndarray
    k: int
    metric: str
    threshold: float | None
    id_column: str
    vector_column: str
    # For approximate search: codes of each query, compared with the codes of a row.
    query_codes: np.ndarray | None = None
    code_column: str | None = None
    # Or the one list a row is in; a query looks into the lists that are its codes.
    list_column: str | None = None
    # Rows with a component that is not finite: "skip" them or make them an "error".
    nonfinite: str = "skip"
    # The best rows so far, and rows that may be better; these are merged as soon as they are half as many as can be held.
    held: pa.Table | None = None
    waiting: list[pa.Table] = field(default_factory=list)
    n_waiting: int = 0
    # Score and id of the k-th best row of each query so far.
    floor: np.ndarray = field(init=False)
    floor_ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.floor = np.full(len(self.queries), -np.inf)
        self.floor_ids = np.empty(len(self.queries), dtype=object)
        self.dim = self.queries.shape[1]
        if self.metric == "cosine":
            self.side = unit(self.queries).astype(np.float32)
        else:
            self.side = self.queries
        self.query_sq = (self.queries * self.queries).sum(axis=1)
        # (list, query) pairs in the order of lists.
        self.asked = self.askers = np.zeros(0, np.int64)
        if self.list_column and len(self.queries):
            codes = self.query_codes
            order = np.argsort(codes, axis=None, kind="stable")
            self.asked, self.askers = codes.ravel()[order], order // codes.shape[1]

    def feed(self, batch: pa.RecordBatch) -> None:
        step = max(1, MAX_SLICE_SCORES // max(1, len(self.queries)))
        for start in range(0, batch.num_rows, step):
            self._feed_slice(pa.Table.from_batches([batch.slice(start, step)]))

    def _feed_slice(self, part: pa.Table) -> None:
        # Rows without a vector are skipped here: a filter before would compute vectors twice.
        present = pc.greater(pc.fill_null(pc.list_value_length(part.column(self.vector_column)), 0), 0)
        if not pc.all(present).as_py():
            part = part.filter(present)
            if part.num_rows == 0:
                return
        vectors = vector_matrix(part.column(self.vector_column), self.dim)
        finite = np.isfinite(vectors).all(axis=1)
        if not finite.all():
            if self.nonfinite == "error":
                raise ValueError(f"{int((~finite).sum())} vectors have components that are not finite")
            part, vectors = part.filter(pa.array(finite)), vectors[finite]
            if part.num_rows == 0:
                return
        if self.list_column:
            rows, which = self._in_lists(vectors, part.column(self.list_column).to_numpy())
        else:
            allowed = self._allowed(part)
            if allowed is not None and allowed.mean() < SPARSE_SHARE:
                rows, which = np.nonzero(allowed)
            else:
                rows, which = self._candidates(vectors, allowed)
        self._keep(part, rows, which, self._pair_scores(vectors, rows, which))

    def _in_lists(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate pairs of each list's rows and the queries that look into it: one product per list."""
        order = np.argsort(lists, kind="stable")
        names, starts = np.unique(lists[order], return_index=True)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for name, start, end in zip(names, starts, np.append(starts[1:], len(lists))):
            asks = self.askers[np.searchsorted(self.asked, name) : np.searchsorted(self.asked, name, "right")]
            if len(asks):
                mine = order[start:end]
                rows, which = self._candidates(vectors[mine], None, asks)
                found.append((mine[rows], asks[which]))
        rows, which = (np.concatenate(x) for x in zip(*found))
        return rows, which

    def _candidates(self, vectors: np.ndarray, allowed: np.ndarray | None, asks: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among the k best: a matrix product, less its rounding error.

        The product only picks them. Their scores are then summed in one fixed order, so
        copies of a vector tie exactly, whatever batch or path they came through. ``asks`` are
        the queries to look at; pairs number them as they are there.
        """
        row_sq = (vectors * vectors).sum(axis=1)
        error = 8 * self.dim * np.finfo(float).eps
        side, floor, query_sq = self.side[asks], self.floor[asks], self.query_sq[asks]
        if self.metric == "cosine":
            # Unit vectors in single precision: twice as fast, and only the slack is larger.
            error = (self.dim + 8) * float(np.finfo(np.float32).eps)
            scores, slack = unit(vectors).astype(np.float32) @ side.T, np.full(len(side), error)
        elif self.metric == "dot_product":
            scores = vectors @ side.T
            slack = error * np.sqrt(row_sq.max() * query_sq)
        else:
            # Squared distances, negated: |a-b|^2 = |a|^2 + |b|^2 - 2ab.
            scores = 2.0 * (vectors @ side.T) - row_sq[:, None] - query_sq[None, :]
            slack, floor = error * (row_sq.max() + query_sq), -(floor * floor)
        if allowed is not None:
            scores = np.where(allowed, scores, -np.inf)
        # Scores are told apart to DIGITS digits, which may raise one by that much.
        floor = floor - slack - _ROUNDING * np.abs(floor)
        good = scores >= floor.astype(scores.dtype)
        # Once the floors are high few scores reach them, and the k-th best of these rows need not be known.
        if len(scores) > self.k and np.count_nonzero(good) > self.k * len(side):
            kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k].astype(np.float64)
            floor = np.maximum(floor, kth - 2 * slack - 2 * _ROUNDING * np.abs(kth))
            good = scores >= floor.astype(scores.dtype)
        if allowed is not None:
            good &= allowed
        return np.divmod(np.flatnonzero(good), max(1, len(side)))

    def _keep(self, part: pa.Table, rows: np.ndarray, which: np.ndarray, found: np.ndarray) -> None:
        lowest = self.floor[which]
        if self.threshold is not None:
            lowest = np.maximum(lowest, self.threshold)
        good = np.flatnonzero(found >= lowest)
        good = good[self._not_beaten(part, rows[good], which[good], found[good])]
        self._wait(part, rows[good], which[good], found[good] + 0.0)

    def _not_beaten(self, part: pa.Table, rows: np.ndarray, which: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Drop candidates that tie with the k-th best but have a larger id.

        Without this a store full of copies would bring every copy into every merge.
        """
        tied = np.flatnonzero(found == self.floor[which])
        keep = np.ones(len(rows), dtype=bool)
        if len(tied):
            ids = np.array(_ids(part.column(self.id_column)), dtype=object)[rows[tied]]
            keep[tied] = ids < self.floor_ids[which[tied]]
        return keep

    def _pair_scores(self, vectors: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Scores of single (row, query) pairs."""
        out = np.empty(len(rows))
        row_length = np.sqrt((vectors * vectors).sum(axis=1))
        query_length = np.sqrt(self.query_sq)
        step = max(1, MAX_SLICE_SCORES // self.dim)
        for s in range(0, len(rows), step):
            r, w = rows[s : s + step], which[s : s + step]
            x, y = vectors[r], self.queries[w]
            if self.metric == "euclidean":
                out[s : s + step] = -np.sqrt(((x - y) * (x - y)).sum(axis=1))
                continue
            dot = (x * y).sum(axis=1)
            if self.metric == "cosine":
                length = query_length[w] * row_length[r]
                dot = np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)
            out[s : s + step] = dot
        return significant(out)

    def _allowed(self, part: pa.Table) -> np.ndarray | None:
        if self.query_codes is None:
            return None
        codes = vector_matrix(part.column(self.code_column)).astype(np.int64)
        # Share a code. Lists of equal length are compared place by place: one code per table.
        shared = np.zeros((len(codes), len(self.query_codes)), dtype=bool)
        aligned = codes.shape[1] == self.query_codes.shape[1]
        for mine in range(codes.shape[1]):
            for theirs in [mine] if aligned else range(self.query_codes.shape[1]):
                shared |= codes[:, mine][:, None] == self.query_codes[:, theirs][None, :]
        return shared

    def _wait(self, part: pa.Table, rows: np.ndarray, which: np.ndarray, found: np.ndarray) -> None:
        if len(rows) == 0:
            return
        drop = [c for c in (self.vector_column, self.code_column, self.list_column) if c and c in part.column_names]
        fresh = part.drop_columns(drop).take(pa.array(rows))
        self.waiting.append(fresh.append_column("_q", pa.array(which.astype(np.int64))).append_column("_score", pa.array(found)))
        self.n_waiting += len(rows)
        if 2 * self.n_waiting >= self.k * len(self.queries):
            self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        both = pa.concat_tables([*([] if self.held is None else [self.held]), *self.waiting])
        self.waiting, self.n_waiting = [], 0
        q = both.column("_q").to_numpy()
        score = both.column("_score").to_numpy()
        ids = _ids(both.column(self.id_column))
        order = np.lexsort((ids, -score, q))
        sorted_q = q[order]
        starts = np.r_[0, np.flatnonzero(np.diff(sorted_q)) + 1]
        lengths = np.diff(np.r_[starts, len(sorted_q)])
        rank = np.arange(len(sorted_q)) - np.repeat(starts, lengths)
        self.held = both.take(pa.array(order[rank < self.k]))
        full = lengths >= self.k
        last = order[starts[full] + self.k - 1]
        self.floor[sorted_q[starts[full]]] = score[last]
        self.floor_ids[sorted_q[starts[full]]] = ids[last]

    def result(self, query_ids: pa.Array, schema: pa.Schema) -> pa.Table:
        self._merge()
        if self.held is None:
            return schema.empty_table()
        held = self.held
        columns = [
            query_ids.take(held.column("_q").combine_chunks()) if name == "query_id" else held.column(name)
            for name in schema.names
        ]
        return pa.table(dict(zip(schema.names, columns))).cast(schema)


def _result_type(queries: DataFrame, store: DataFrame, leave_out: set[str]) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType)]
    fields += [f for f in store.schema.fields if f.name not in leave_out]
    fields.append(T.StructField("_score", T.DoubleType()))
    return T.StructType(fields)


def top_k(
    queries: DataFrame,
    store: DataFrame,
    k: int,
    metric: str,
    threshold: float | None = None,
    id_column: str = "id",
    code_column: str | None = None,
    max_queries: int = MAX_BLOCK_QUERIES,
    max_components: int = MAX_BLOCK_COMPONENTS,
    nonfinite: str = "skip",
    list_column: str | None = None,
) -> DataFrame:
    """The k best store rows of each query: ``query_id, <store columns>, _score, rank``.

    ``queries`` has ``query_id, embedding`` and, for approximate search, ``codes``: rows are
    compared with the queries that share a code with ``code_column`` (a list), or whose codes
    hold ``list_column`` (one number). Queries are sent to all tasks in blocks of bounded size and
    the store is scanned once per block; store rows are never shuffled or copied. Where there are
    several blocks, the queries and each block's results are written to the shared folder and the
    driver holds two blocks at a time, and the next one while it waits. Scores are ranked to twelve significant digits, ties go to
    the smaller id. Rows and queries with a component that is NaN or infinite have no
    hits; with ``nonfinite="error"`` such a row ends the job.
    """
    wanted = [F.col("query_id"), F.col("embedding")]
    if code_column or list_column:
        wanted.append(F.col("codes"))
    number = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    finite = F.forall(number, lambda x: x < F.lit(float("inf")))
    queries = queries.filter((F.size("embedding") > 0) & finite).select(*wanted)
    leave_out = {"embedding"} | {c for c in (code_column, list_column) if c}
    result_type = _result_type(queries, store, leave_out)
    arguments = (result_type, k, metric, threshold, id_column, code_column, list_column, nonfinite)
    block = queries.limit(max_queries + 1).toArrow()
    if block.num_rows <= max_queries and _components(block) <= max_components:
        return merge_top_k(_scan_store(block, store, *arguments)[0], k, id_column)
    spark = store.sparkSession
    path = shared_dir(spark, "found")

    def scan(number: int, block: pa.Table) -> None:
        found, sent = _scan_store(block, store, *arguments)
        found.write.parquet(f"{path}/{number}")
        sent.destroy()

    # A block is read and sent while tasks are busy with the one before: cores need not wait for the last of its tasks.
    with ThreadPoolExecutor(BLOCKS_AT_ONCE) as pool:
        at_work: list[Future] = []
        for number, block in enumerate(_query_blocks(stored(queries, "queries"), max_queries, max_components)):
            at_work.append(pool.submit(scan, number, block))
            if len(at_work) == BLOCKS_AT_ONCE:
                at_work.pop(0).result()
        for one in at_work:
            one.result()
    found = spark.read.schema(result_type).option("recursiveFileLookup", "true").parquet(path)
    return merge_top_k(found, k, id_column)


def _components(block: pa.Table) -> int:
    return pc.sum(pc.list_value_length(block.column("embedding"))).as_py() or 0


def _query_blocks(queries: DataFrame, max_queries: int, max_components: int) -> Iterator[pa.Table]:
    """The stored queries in tables within both limits, one at a time."""
    n, components = queries.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    parts = max(ceil(n / max_queries), ceil(components / max_components))
    home = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    path = shared_dir(queries.sparkSession, "blocks")
    queries.withColumn("_home", home).repartition("_home").write.partitionBy("_home").parquet(path)
    dealt = queries.sparkSession.read.parquet(path)
    for part in range(parts):
        # Hashing deals blocks of about equal size; what exceeds a limit is cut once more.
        block = dealt.filter(F.col("_home") == part).drop("_home").toArrow()
        step = max(1, min(max_queries, max_components // max(1, components // n)))
        for start in range(0, block.num_rows, step):
            yield block.slice(start, step)


def _scan_store(block, store, result_type, k, metric, threshold, id_column, code_column, list_column, nonfinite) -> tuple[DataFrame, Broadcast | None]:
    schema = to_arrow_schema(result_type)
    if block.num_rows == 0:
        return store.sparkSession.createDataFrame([], result_type), None
    vectors = vector_matrix(block.column("embedding"))
    codes = vector_matrix(block.column("codes")).astype(np.int64) if code_column or list_column else None
    names = block.column("query_id").combine_chunks()
    sent = store.sparkSession.sparkContext.broadcast((names, vectors, codes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_names, query_vectors, query_codes = sent.value
        best = LocalTopK(
            query_vectors, k, metric, threshold, id_column, "embedding", query_codes, code_column, list_column, nonfinite
        )
        for batch in batches:
            best.feed(batch)
        yield from best.result(query_names, schema).to_batches()

    return store.mapInArrow(scan, result_type), sent


def merge_top_k(local: DataFrame, k: int, id_column: str) -> DataFrame:
    """Merge per-task results in two steps, so that many tasks do not meet in one."""
    by = [F.desc("_score"), F.col(id_column)]
    salted = local.withColumn("_way", F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)))
    first = Window.partitionBy("query_id", "_way").orderBy(*by)
    final = Window.partitionBy("query_id").orderBy(*by)
    return (
        salted.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= k)
        .drop("_way")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
    )
