"""Running statistics and a helper to run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecweave.operators.stats import stats_columns
from vecweave.session import shared_dir


def stream_stats(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Embedding statistics that grow with each micro-batch (update or complete mode)."""
    return results.groupBy(*(by or [])).agg(*stats_columns())


def run_to_end(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is available now and read back its output.

    Append output goes to Parquet files. Complete output is written whole per micro-batch, and the
    last one is the result. Update output is what changed in each micro-batch; the result is
    the last row of each of the ``keys``.
    """
    if (mode == "update") != bool(keys):
        raise ValueError("update mode, and no other, takes keys")
    spark = stream.sparkSession
    target, checkpoint = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id:09d}")

        query = writer.foreachBatch(write).queryName(f"run-{uuid.uuid4().hex}").start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(target)
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    written = spark.read.schema(schema).parquet(f"{target}/batch=*")
    if mode == "complete":
        last = written.agg(F.max("_batch")).first()[0]
        return written.filter(F.col("_batch") == last).drop("_batch")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_row")).select("_row.*")
