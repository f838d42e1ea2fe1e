"""Exact vector search and the result shapes built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecweave.plans.skew import checked_broadcast
from vecweave.plans.topk import top_k
from vecweave.schemas import METRICS, require

DEFAULT_K = 10
UNKNOWN_MODEL = "unknown"


def filter_condition(store: DataFrame, filters: dict[str, object]) -> Column:
    """Equality on store columns; ``metadata.<key>`` compares a metadata value as text."""
    condition = F.lit(True)
    for key, value in filters.items():
        if key in store.columns:
            condition = condition & (F.col(key) == F.lit(value))
        elif key.startswith("metadata.") and "metadata" in store.columns:
            entry = F.element_at("metadata", F.lit(key.removeprefix("metadata.")))
            condition = condition & (entry == F.lit(str(value)))
        else:
            raise ValueError(f"cannot filter on {key!r}: the store has {', '.join(store.columns)}")
    return condition


def shape_results(ranked: DataFrame, metric: str, score_scale: str = "raw") -> DataFrame:
    """Public result columns: rank first, score and distance last, no vector.

    A higher ``similarity_score`` is better for every metric; ``scale="unit"`` maps a
    cosine from [-1, 1] to [0, 1].
    """
    raw = F.col("_score")
    distance = {"cosine": 1.0 - raw, "euclidean": -raw, "dot_product": -raw}[metric]
    if score_scale == "raw":
        score = raw
    elif score_scale == "unit" and metric == "cosine":
        score = (1.0 + raw) / 2.0
    else:
        raise ValueError(f"score_scale {score_scale!r} does not apply to {metric}")
    out = ranked
    if "embedding_model" in out.columns:
        out = out.withColumn("embedding_model", F.coalesce("embedding_model", F.lit(UNKNOWN_MODEL)))
    payload = [c for c in out.columns if c not in ("query_id", "rank", "_score")]
    return out.select(
        "query_id", "rank", *payload, score.alias("similarity_score"), distance.alias("distance")
    )


def search(
    queries: DataFrame,
    store: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "cosine",
    filters: dict[str, object] | None = None,
    filter_mode: str = "pre",
    threshold: float | None = None,
    score_scale: str = "raw",
    **limits: int,
) -> DataFrame:
    """The k most similar store rows of each query.

    ``queries`` has ``query_id, embedding``; ``store`` has ``id, embedding`` and any
    payload columns, of which only the ones kept in ``store`` are read. Pre-filters
    reach the scan. With ``filter_mode="post"`` the filter drops rows of the finished
    top k, which may leave fewer than k.
    """
    require(metric, METRICS, "metric")
    if k < 1:
        raise ValueError("k must be at least 1")
    condition = filter_condition(store, filters) if filters else None
    if filter_mode not in ("pre", "post"):
        raise ValueError(f"unknown filter_mode {filter_mode!r}")
    source = store.filter(condition) if filters and filter_mode == "pre" else store
    ranked = top_k(queries, source, k, metric, threshold, **limits)
    if filters and filter_mode == "post":
        ranked = ranked.filter(filter_condition(ranked, filters))
    return shape_results(ranked, metric, score_scale)


def fetch(found: DataFrame, store: DataFrame) -> DataFrame:
    """Search results by id with the store's other columns: few results are broadcast, so the
    store is scanned once and none of it is shuffled."""
    payload = store.drop("embedding")
    if "embedding_model" in payload.columns:
        payload = payload.withColumn("embedding_model", F.coalesce("embedding_model", F.lit(UNKNOWN_MODEL)))
    rest = [c for c in payload.columns if c != "id"]
    joined = payload.join(checked_broadcast(found), "id")
    return joined.select("query_id", "rank", "id", *rest, "similarity_score", "distance")


def nest_matches(results: DataFrame, columns: list[str]) -> DataFrame:
    """One row per query with its matches in rank order. Ranked input, so at most k per query."""
    return results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("matches")
    )


def hybrid_search(
    queries: DataFrame,
    store: DataFrame,
    keywords: list[str],
    pool: int = 20,
    k: int = DEFAULT_K,
    metric: str = "cosine",
) -> DataFrame:
    """Vector top ``pool``, kept where the content contains a keyword in any case, first k.

    Only ids and vectors are scored; the contents of the pool are fetched afterwards.
    """
    pooled = fetch(search(queries, store.select("id", "embedding"), pool, metric), store)
    words = F.array(*[F.lit(w.lower()) for w in keywords])
    text = F.lower("content")
    kept = pooled.filter(F.exists(words, lambda w: F.contains(text, w)))
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)


def expand_neighbours(hits: DataFrame, chunks: DataFrame, n: int = 2, joiner: str = "\n") -> DataFrame:
    """Each hit with the text of up to n chunks on either side, in document order.

    ``hits`` and ``chunks`` carry ``source, chunk_index``. A hit asks for 2n+1 exact
    (source, chunk_index) keys. While these are few they are broadcast and the chunks are
    scanned once, unshuffled; otherwise it is an equi-join on a fine key, and a source with
    many chunks is no hot key.
    """
    wanted = hits.select("query_id", "rank", "source", F.col("chunk_index").alias("hit_index")).withColumn(
        "chunk_index", F.explode(F.sequence(F.col("hit_index") - n, F.col("hit_index") + n))
    )
    found = chunks.select("source", "chunk_index", "content").join(checked_broadcast(wanted), ["source", "chunk_index"])
    return found.groupBy("query_id", "rank", "source", "hit_index").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]
            ),
            joiner,
        ).alias("context")
    )


def expanded_context(hits: DataFrame, chunks: DataFrame, n: int = 2, sep: str = "\n\n---\n\n") -> DataFrame:
    """Per query: the expanded text of its hits in rank order."""
    blocks = expand_neighbours(hits, chunks, n)
    return blocks.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "context"))), lambda b: b["context"]), sep
        ).alias("context")
    )


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact results the approximate search found, per query."""
    found = approximate.select("query_id", "id", F.lit(1).alias("_hit"))
    return (
        exact.select("query_id", "id")
        .join(found, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n_exact"),
            F.count("_hit").alias("n_found"),
        )
        .withColumn("recall", F.col("n_found") / F.col("n_exact"))
    )
