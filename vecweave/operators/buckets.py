"""A vector dataset in hash buckets of the id, where a change rewrites the buckets it touches and no others.

The layout is ``of=<buckets>/bucket=<n>/``: Parquet files partitioned by a hash of the id. An upsert
or a delete reads the touched buckets only, and Spark's dynamic partition overwrite puts their new
files in place once all tasks are done: until then the old ones stand. One writer at a time; the
same call again, after a failure in the middle of that last step, ends in the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.operators.store import latest_by_id, to_store_rows
from vecweave.schemas import CHUNK
from vecweave.session import shared_dir, stored

DEFAULT_BUCKETS = 256
_OWN = ("bucket", "dimension")


class BucketedVectors:
    """Vectors under ``path`` in a fixed number of buckets.

    ``dimension``, the length of a row's vector, is recorded when it is written, so statistics need no vectors.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = DEFAULT_BUCKETS) -> None:
        if buckets < 1:
            raise ValueError("there must be at least one bucket")
        self.spark, self.buckets = spark, buckets
        self.root = path.rstrip("/")
        other = [n for n in self._names(self.root) if n.startswith("of=") and n != f"of={buckets}"]
        if other:
            raise ValueError(f"{path} has other buckets: {other[0]}")
        self.path = f"{self.root}/of={buckets}"

    def _folder(self, path: str):
        location = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return location.getFileSystem(self.spark._jsc.hadoopConfiguration()), location

    def _names(self, path: str) -> list[str]:
        fs, location = self._folder(path)
        return [s.getPath().getName() for s in fs.listStatus(location)] if fs.exists(location) else []

    def _bucket(self, key: Column | str = "id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        if not any(n.startswith("bucket=") for n in self._names(self.path)):
            return self.spark.createDataFrame([], CHUNK + ", dimension int, bucket int")
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def _marked(self, chunks: DataFrame) -> DataFrame:
        rows = to_store_rows(chunks)
        return rows.withColumn("dimension", F.size("embedding")).withColumn("bucket", self._bucket())

    def _touched(self, rows: DataFrame) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())

    def _replace(self, rows: DataFrame) -> None:
        """New content for every bucket that ``rows`` has; a bucket with much of the data is written by several tasks."""
        writer = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop(*_OWN)

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """The rows with one of the ids, from their buckets only."""
        wanted = stored(ids.select("id").distinct().withColumn("bucket", self._bucket()), "wanted")
        rows = self._all().filter(F.col("bucket").isin(self._touched(wanted)))
        return rows.join(wanted, ["id", "bucket"], "left_semi").drop(*_OWN)

    def append(self, chunks: DataFrame) -> None:
        """Add embedded chunks; repeated ids stay side by side."""
        self._marked(chunks).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def upsert(self, chunks: DataFrame, order: list[Column] | None = None) -> int:
        """Insert or replace by id; among incoming rows of one id the last in ``order`` wins. Returns the buckets rewritten.

        Incoming rows are computed once. Columns that one side lacks become null.
        """
        by = order or [F.col("created_at"), F.xxhash64("content"), F.xxhash64("embedding")]
        staged = shared_dir(self.spark, "fresh")
        latest_by_id(self._marked(chunks), by).write.parquet(staged)
        fresh = self.spark.read.parquet(staged)
        touched = self._touched(fresh)
        if touched:
            kept = self._all().filter(F.col("bucket").isin(touched)).join(fresh.select("id", "bucket"), ["id", "bucket"], "left_anti")
            self._replace(fresh.unionByName(kept, allowMissingColumns=True))
        # The rows are in their buckets now.
        fs, location = self._folder(staged)
        fs.delete(location, True)
        return len(touched)

    def delete(self, ids: DataFrame) -> bool:
        """Remove ids; true if any row went. Buckets without one of them are not written, emptied ones go."""
        gone = stored(ids.select("id").distinct().withColumn("bucket", self._bucket()), "gone")
        rows = self._all().filter(F.col("bucket").isin(self._touched(gone)))
        hit = self._touched(rows.join(gone, ["id", "bucket"], "left_semi"))
        if not hit:
            return False
        kept = rows.filter(F.col("bucket").isin(hit)).join(gone, ["id", "bucket"], "left_anti")
        left = self._touched(kept)
        if left:
            self._replace(kept)
        for bucket in set(hit) - set(left):
            fs, location = self._folder(f"{self.path}/bucket={bucket}")
            fs.delete(location, True)
        return True

    def stats(self) -> DataFrame:
        """Rows, dimension, first and last ``created_at``, buckets in use; vectors and contents are not read."""
        return self._all().agg(
            F.count(F.lit(1)).alias("document_count"),
            F.max("dimension").alias("dimension"),
            F.min("created_at").alias("earliest"),
            F.max("created_at").alias("latest"),
            F.count_distinct("bucket").alias("buckets"),
        )
