"""Job statistics as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def stats_columns(total: int | Column | None = None) -> list[Column]:
    """The aggregates of a results table; also usable in a streaming query."""
    embedded = F.coalesce(F.sum(F.when(F.col("success"), F.col("n_embedded")).otherwise(0)), F.lit(0)).cast("bigint")
    failed = F.count(F.when(~F.col("success"), 1))
    done = embedded + failed
    whole = done if total is None else (F.lit(total) if isinstance(total, int) else total)
    tokens = F.coalesce(F.sum(F.coalesce(F.element_at("token_usage", F.lit("total_tokens")), F.lit(0))), F.lit(0))
    time = F.coalesce(F.sum("processing_time"), F.lit(0.0))
    return [
        whole.cast("bigint").alias("total_chunks"),
        embedded.alias("embedded_chunks"),
        failed.alias("failed_chunks"),
        tokens.cast("bigint").alias("total_tokens"),
        time.alias("total_processing_time"),
        F.when(done > 0, time / done).otherwise(0.0).alias("average_embedding_time"),
        (embedded / F.greatest(F.lit(1), whole) * 100).alias("success_rate"),
    ]


def embedding_stats(results: DataFrame, total: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Embedded and failed chunks, tokens, time and success rate of a results table."""
    return results.groupBy(*(by or [])).agg(*stats_columns(total))


def batch_status(batches: DataFrame) -> DataFrame:
    """Batches, chunks, latest end and one error text per status."""
    return batches.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n_chunks").alias("n_chunks"),
        F.max("processed_at").alias("last_processed_at"),
        F.count("error").alias("n_errors"),
        F.min("error").alias("sample_error"),
    )


def mark_batches(batches: DataFrame, failures: DataFrame, at: Column) -> DataFrame:
    """Give each batch its outcome: failed with the error from ``failures`` (batch_id, error), else completed."""
    outcome = batches.drop("status", "processed_at", "error").join(failures, "batch_id", "left")
    return outcome.withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed")).withColumn(
        "processed_at", at
    )


def run_summary(embedded: DataFrame, started_at: Column, finished_at: Column) -> DataFrame:
    """Chunks processed, vectors made and the seconds of a run, per model."""
    return embedded.groupBy(F.coalesce("embedding_model", F.lit("unknown")).alias("model")).agg(
        F.count(F.lit(1)).alias("chunks_processed"),
        F.count(F.when(F.size("embedding") > 0, 1)).alias("embeddings_generated"),
        F.max(F.unix_micros(finished_at) / 1e6 - F.unix_micros(started_at) / 1e6).alias("seconds"),
    )


def observed_counts(df: DataFrame, name: str | Observation) -> DataFrame:
    """The same rows; a query listener or the given ``Observation`` learns how many passed this stage."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
