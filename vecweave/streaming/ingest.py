"""Files as they arrive: manifest, chunks, vectors, store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecweave.operators.chunking import build_chunks, chunk
from vecweave.operators.ledger import fingerprint
from vecweave.operators.store import VectorStore
from vecweave.sources.manifest import file_name, infer_content_type, location_metadata

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

# Files in one micro-batch of a manifest, which has their names and times only.
MANIFEST_FILES = 50_000


def stream_files(
    spark: SparkSession, path: str, glob: str | None = None, max_files: int = 1000, max_age: str = "36500d"
) -> DataFrame:
    """A stream of files with their bytes; the source's checkpoint remembers what it has read.

    Spark ignores files whose modification time lies more than ``max_age`` behind the
    newest one. The default ignores none; a shorter age keeps the source's memory of
    seen files small where old files cannot arrive.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(max_files))
        .option("maxFileAge", max_age)
    )
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = file_name(F.col("path"))
    return files.select(
        name.alias("name"),
        F.col("path").alias("source_path"),
        infer_content_type(name).alias("content_type"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
        location_metadata(F.col("path")).alias("metadata"),
        "content",
    )


def stream_manifest(
    spark: SparkSession, path: str, glob: str | None = None, delay: str = "1 hour", max_files: int = MANIFEST_FILES
) -> DataFrame:
    """Each file version once: a fingerprint that arrives again within ``delay`` is dropped.

    No file's bytes are read, so a micro-batch takes many more files than one of ``stream_files``.

    The watermark follows ``seen_at``, the time of arrival. Modification times may be old
    (a copy keeps them), and a file must not be dropped as late for that.
    """
    files = stream_files(spark, path, glob, max_files).drop("content")
    marked = files.withColumn(
        "fingerprint", fingerprint(F.col("source_path"), F.col("last_modified"), F.col("size"))
    ).withColumn("seen_at", F.current_timestamp())
    return marked.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_documents(
    documents: DataFrame,
    store: VectorStore,
    embed: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    strategy: str = "fixed",
    size: int = 512,
    replace: bool = False,
    **trigger: object,
) -> StreamingQuery:
    """Chunk, embed and store a stream of ``source, text`` (and ``created_at``) rows.

    A chunk's id is made from its content and place, so an id that is stored already is
    the same chunk: such chunks are dropped before they are embedded and the rest is
    appended, which keeps the cost of a micro-batch to the new chunks and a read of the
    stored ids. With ``replace`` each micro-batch is an upsert, for when the vectors
    themselves change. Either way a micro-batch that runs again leaves the store as if it
    had run once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.col("created_at") if "created_at" in batch.columns else F.current_timestamp()
        chunks = build_chunks(chunk(batch, strategy, size), strategy, created_at=at).drop("chunk_index")
        if replace:
            store.upsert(embed(chunks))
        else:
            store.append(embed(store.missing(chunks)))

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
