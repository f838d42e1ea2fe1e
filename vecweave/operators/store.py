"""The vector dataset: immutable Parquet snapshots under one path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.functions.vectors import has_embedding
from vecweave.schemas import CHUNK, OUTPUT_FORMATS, require

_SNAPSHOT = "snapshot="
_COLUMNS = ["id", "content", "source", "metadata", "created_at", "embedding", "embedding_model", "vector_id"]


def to_store_rows(chunks: DataFrame) -> DataFrame:
    """Rows as stored: embedded chunks only, ``vector_id`` or ``id`` as the key, float vectors."""
    key = F.coalesce("vector_id", "id") if "vector_id" in chunks.columns else F.col("id")
    types = dict(p.strip().split(" ", 1) for p in CHUNK.replace("map<string,string>", "map<string;string>").split(", "))
    fixed = []
    for name in _COLUMNS:
        kind = types[name].replace(";", ",")
        if name in ("id", "vector_id"):
            fixed.append(key.cast(kind).alias(name))
        elif name in chunks.columns:
            fixed.append(F.col(name).cast(kind).alias(name))
        else:
            fixed.append(F.lit(None).cast(kind).alias(name))
    extra = [c for c in chunks.columns if c not in _COLUMNS]
    return chunks.filter(has_embedding(F.col("embedding"))).select(*fixed, *extra)


def assign_vector_ids(chunks: DataFrame) -> DataFrame:
    """``vec_<id>`` for embedded chunks; the others keep what they have."""
    made = F.concat(F.lit("vec_"), F.col("id"))
    return chunks.withColumn(
        "vector_id", F.when(has_embedding(F.col("embedding")), made).otherwise(F.col("vector_id"))
    )


def latest_by_id(rows: DataFrame, order: list[Column], key: str = "id") -> DataFrame:
    """One row per id, the last in ``order``. Partial aggregation keeps a much repeated id small."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return rows.groupBy(key).agg(last.alias("_row")).select("_row.*")


def delete_rows(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti")


def _with_columns_of(rows: DataFrame, other: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``other`` it lacks, as nulls."""
    lacking = [f for f in other.schema.fields if f.name not in rows.columns]
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking])


class VectorStore:
    """Snapshots ``snapshot=<n>/`` of one dataset; the newest finished one is current.

    A write makes a new folder and counts once Spark has put its ``_SUCCESS`` file
    there, so a lost executor or a failed job leaves the current snapshot as it was.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: list[str] | None = None) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.partition_by = partition_by or []

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        location = jvm.org.apache.hadoop.fs.Path(path)
        return location.getFileSystem(self.spark._jsc.hadoopConfiguration()), location

    def snapshots(self) -> list[int]:
        fs, root = self._hadoop(self.path)
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith(_SNAPSHOT) and fs.exists(done):
                found.append(int(name.removeprefix(_SNAPSHOT)))
        return sorted(found)

    def location(self) -> str | None:
        found = self.snapshots()
        return f"{self.path}/{_SNAPSHOT}{found[-1]}" if found else None

    def read(self) -> DataFrame:
        current = self.location()
        if current is None:
            return self.spark.createDataFrame([], CHUNK)
        return self.spark.read.parquet(current)

    def _next(self) -> str:
        found = self.snapshots()
        return f"{self.path}/{_SNAPSHOT}{(found[-1] if found else 0) + 1}"

    def _write(self, rows: DataFrame, target: str, mode: str, finished: bool = True) -> None:
        if self.partition_by:
            # Even files per partition value; a value with much of the data is split.
            rows = rows.hint("rebalance", *self.partition_by)
        writer = rows.write.mode(mode).partitionBy(*self.partition_by)
        if not finished:
            writer = writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        writer.parquet(target)

    def append(self, chunks: DataFrame) -> None:
        """Add embedded chunks to the current snapshot; repeated ids stay side by side.

        A snapshot has one set of columns: a new column needs an upsert.
        """
        rows, current = to_store_rows(chunks), self.location()
        if current is None:
            self._write(rows, self._next(), "overwrite")
            return
        stored = self.read()
        unknown = [c for c in rows.columns if c not in stored.columns]
        if unknown:
            raise ValueError(f"the store has no column {', '.join(unknown)}")
        self._write(_with_columns_of(rows, stored), current, "append")

    def missing(self, chunks: DataFrame) -> DataFrame:
        """Chunks whose id is not stored yet, each id once. Reads only the stored ids."""
        return chunks.dropDuplicates(["id"]).join(self.read().select("id").distinct(), "id", "left_anti")

    def upsert(self, chunks: DataFrame, order: list[Column] | None = None) -> None:
        """Insert or replace by id; among incoming rows of one id the last in ``order`` wins.

        The incoming rows are computed once, as the first files of the new snapshot. Rows
        of the current one whose ids are not among them follow, and finish the snapshot.
        """
        by = order or [F.col("created_at"), F.xxhash64("content"), F.xxhash64("embedding")]
        fresh = latest_by_id(to_store_rows(chunks), by)
        current, target = self.location(), self._next()
        if current is None:
            self._write(fresh, target, "overwrite")
            return
        stored = self.read()
        fresh = _with_columns_of(fresh, stored)
        self._write(fresh, target, "overwrite", finished=False)
        replaced = self.spark.read.schema(fresh.schema).parquet(target).select("id")
        self._write(_with_columns_of(delete_rows(stored, replaced), fresh), target, "append")

    def compact(self) -> None:
        """Rewrite the current snapshot, whose appends left many small files, as a new one."""
        self._write(self.read().hint("rebalance"), self._next(), "overwrite")

    def delete(self, ids: DataFrame) -> bool:
        """Remove ids; true if any row went."""
        current = self.read()
        if current.join(ids.select("id"), "id", "left_semi").isEmpty():
            return False
        self._write(delete_rows(current, ids), self._next(), "overwrite")
        return True

    def stats(self) -> DataFrame:
        """Rows, dimension, first and last ``created_at`` and bytes on disk."""
        current = self.location()
        if current is None:
            return store_stats(self.read()).withColumn("size_bytes", F.lit(0).cast("bigint"))
        sizes = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(current)
            .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
        )
        # Two single rows become one.
        both = store_stats(self.read()).unionByName(sizes, allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in both.columns])


def store_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.max(F.size("embedding")).alias("dimension"),
        F.min("created_at").alias("earliest"),
        F.max("created_at").alias("latest"),
    )


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values with counts of each column, as ``facet, value, n``."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"no such column to facet on: {', '.join(missing)}")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return rows.select(pairs.alias("_f")).groupBy("_f.facet", "_f.value").agg(F.count(F.lit(1)).alias("n"))


def by_time(rows: DataFrame, newest_first: bool = True) -> DataFrame:
    """Ordered by ``created_at``, then id: a range-partitioned sort."""
    at = F.desc("created_at") if newest_first else F.asc("created_at")
    return rows.orderBy(at, "id")


def export(df: DataFrame, path: str, format: str = "jsonl") -> None:
    """Write as JSON lines or Parquet."""
    require(format, OUTPUT_FORMATS, "output format")
    writer = df.write.mode("errorifexists")
    writer.json(path) if format == "jsonl" else writer.parquet(path)


def to_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON text in column ``record``."""
    fields = ", ".join(f"`{c}`" for c in df.columns)
    return df.select(F.expr(f"to_json(struct({fields}), map('timestampFormat', '{_ISO}'))").alias("record"))


# Timestamps with microseconds, so that a round trip keeps them.
_ISO = "yyyy-MM-dd''T''HH:mm:ss.SSSSSSXXX"
_ISO_OPTION = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def from_records(records: DataFrame, schema: str = CHUNK) -> DataFrame:
    """Rows back from JSON texts; a missing ``created_at`` becomes now."""
    parsed = records.select(
        F.from_json("record", schema, {"timestampFormat": _ISO_OPTION}).alias("_r")
    ).select("_r.*")
    if "created_at" in parsed.columns:
        parsed = parsed.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    return parsed

