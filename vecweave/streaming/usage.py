"""Usage windows over a stream of requests ``key, ts, tokens``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_usage(
    log: DataFrame, window: str = "1 minute", slide: str | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """Requests and tokens per caller and tumbling or sliding window.

    A window is final once the watermark (the latest time seen less ``lateness``) has passed its
    end. In append mode it is given out then and its state is dropped, so what a stream holds is
    the open windows; rows that come later still are dropped. Counts are aggregated in part before the
    shuffle, so a busy caller costs one row per window and task.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        timed.withWatermark("ts", lateness)
        .groupBy("key", span.alias("span"))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
        .select("key", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "requests", "tokens")
    )
