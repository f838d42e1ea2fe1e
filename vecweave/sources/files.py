"""Files listed and read inside the tasks, where one that is gone or broken is a row and not the end of the job.

``FileListing`` is a Spark data source: a listing of a folder (files of zero bytes included) in
parallel by subfolders, or a stream of files as they arrive, whose whole memory is one offset.
``read_files`` opens the files of a manifest and gives bytes or an error for each. Paths are
opened with pyarrow: local folders, and the object stores and clusters it knows. For other
Hadoop paths there are ``scan_manifest`` and ``load_content``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vecweave.sources.manifest import MAX_FILE_SIZE, file_name, infer_content_type, location_metadata, scan_manifest

FORMAT = "vecweave_files"
LISTED = "path string, modificationTime timestamp, length bigint"
# A file counts for a stream once it is this old: until then another one of the same time may still appear.
SETTLE_SECONDS = 2.0
# Bytes of files that leave a task as one batch, and that one task reads.
BATCH_BYTES = 32 << 20
TASK_BYTES = 256 << 20
# Tasks of one listing at most; each walks as many subfolders as the others.
LISTING_TASKS = 256
# Files of a listing that leave a task as one batch.
LISTED_ROWS = 10_000
READ, MISSING, UNREADABLE, OVERSIZED = "read", "missing", "unreadable", "oversized"


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or address, the path in it, and what to put before paths to get addresses."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return pafs.LocalFileSystem(), path, "file:"
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    system, inside = pafs.FileSystem.from_uri(path.replace(scheme, "s3", 1) if scheme in ("s3a", "s3n") else path)
    if scheme in ("s3", "s3a", "s3n"):
        return system, inside, f"{scheme}://"
    return system, inside, path[: len(path) - len(inside)]


@dataclass
class Folders(InputPartition):
    """Folders to walk, each with whether to go into what is below it."""

    paths: list[tuple[str, bool]]
    after: tuple[int, str] | None = None
    until: tuple[int, str] | None = None


def _order(info: pafs.FileInfo) -> tuple[int, str]:
    return (info.mtime_ns or 0) // 1000, info.path


def _left_out(name: str, as_spark: bool) -> bool:
    """Hidden names; Spark's file sources take ``_a=1`` and leave out copies that are under way."""
    if not as_spark:
        return name.startswith(("_", "."))
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _files(system: pafs.FileSystem, path: str, deep: bool, glob: str | None, as_spark: bool = False) -> Iterator[pafs.FileInfo]:
    """The files of a folder; ``as_spark`` without files of zero bytes and without what is below hidden folders."""
    for info in system.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=deep)):
        if info.type != pafs.FileType.File or not (glob is None or fnmatchcase(info.base_name, glob)) or _left_out(info.base_name, as_spark):
            continue
        if as_spark and (not info.size or any(_left_out(n, True) for n in info.path[len(path) :].strip("/").split("/")[:-1])):
            continue
        yield info


class FileListing(DataSource):
    """Options: ``path``, ``glob`` (of names), ``as_spark`` (the files that Spark's file sources take) and, for streams, ``settle`` in seconds."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Arrivals(self.options)


class _Walker:
    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.as_spark = options["path"], options.get("glob"), options.get("as_spark") == "true"
        self.settle = float(options.get("settle", SETTLE_SECONDS))

    def folders(self) -> list[tuple[str, bool]]:
        """The root's own files, and each of its subfolders."""
        system, root, _ = opened(self.path)
        below = [i.path for i in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.type == pafs.FileType.Directory]
        return [(root, False), *[(p, True) for p in sorted(below) if not _left_out(p.rsplit("/", 1)[-1], self.as_spark)]]

    def shares(self, after=None, until=None) -> list[Folders]:
        """The folders dealt to at most LISTING_TASKS tasks: a folder with one file is not worth a task of its own."""
        found = self.folders()
        each = -(-len(found) // LISTING_TASKS)
        return [Folders(found[i : i + each], after, until) for i in range(0, len(found), each)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, _, prefix = opened(self.path)
        after, until = (tuple(x) if x else None for x in (partition.after, partition.until))
        rows: list[tuple[str, int, int]] = []
        for folder, deep in partition.paths:
            for info in _files(system, folder, deep, self.glob, self.as_spark):
                if (after and _order(info) <= after) or (until and _order(info) > until):
                    continue
                rows.append((prefix + info.path, _order(info)[0], info.size))
                if len(rows) >= LISTED_ROWS:
                    yield _listed(rows)
                    rows = []
        yield _listed(rows)


def _listed(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    paths, times, sizes = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(times, pa.timestamp("us", "UTC")), pa.array(sizes, pa.int64())], names=["path", "modificationTime", "length"]
    )


class _Listing(_Walker, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.shares()


class _Arrivals(_Walker, DataSourceStreamReader):
    """Files in the order of (modification time, path); the offset is the last one seen."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        system, _, _ = opened(self.path)
        settled = int((time.time() - self.settle) * 1_000_000)
        last = (-1, "")
        # Folder by folder, so that the driver never holds the whole listing.
        for folder, deep in self.folders():
            for info in _files(system, folder, deep, self.glob):
                if _order(info)[0] <= settled:
                    last = max(last, _order(info))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.shares((start["time"], start["path"]), (end["time"], end["path"]))

    def commit(self, end: dict) -> None:
        pass


def manifest_of(files: DataFrame) -> DataFrame:
    """A listing (path, modificationTime, length) as a manifest."""
    name = file_name(F.col("path"))
    return files.select(
        name.alias("name"),
        F.col("path").alias("source_path"),
        infer_content_type(name).alias("content_type"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
        location_metadata(F.col("path")).alias("metadata"),
    )


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The manifest of all files under a folder, empty ones too; a folder that is not there has none."""
    spark.dataSource.register(FileListing)
    reader = spark.read.format(FORMAT).option("path", path)
    return manifest_of((reader.option("glob", glob) if glob else reader).load())


def _folder_of(spark: SparkSession, path: str) -> str | None:
    """The full address of a folder that pyarrow opens; None for patterns, single files, and what only Hadoop opens or nobody."""
    if any(c in path for c in "*?[]{}\\"):
        return None
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
        system, inside, prefix = opened(full)
        there = prefix + inside == full and system.get_file_info(inside).type == pafs.FileType.Directory
    except Exception:  # Spark's listing says what is wrong
        return None
    return full if there else None


def list_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``scan_manifest``, listed inside the tasks, so that the driver never holds the files.

    What pyarrow does not open as a folder is listed by Spark, whose driver keeps every file. Times are whole
    milliseconds as there: fingerprints are made from them.
    """
    folder = _folder_of(spark, path)
    if folder is None:
        return scan_manifest(spark, path)
    spark.dataSource.register(FileListing)
    files = spark.read.format(FORMAT).option("path", folder).option("as_spark", "true").load()
    return manifest_of(files.withColumn("modificationTime", F.date_trunc("millisecond", "modificationTime")))


def stream_listing(spark: SparkSession, path: str, glob: str | None = None, settle: float = SETTLE_SECONDS) -> DataFrame:
    """The manifest of files as they arrive, each file version once.

    The source remembers one offset, the (time, path) of the last file, however many files it
    has seen. So a file that arrives with a modification time before that offset (a copy that
    keeps an old time) is not seen; where such files occur use ``stream_manifest``.
    """
    spark.dataSource.register(FileListing)
    reader = spark.readStream.format(FORMAT).option("path", path).option("settle", str(settle))
    return manifest_of((reader.option("glob", glob) if glob else reader).load())


def _content(path: str, max_size: int) -> tuple[bytes | None, str, str | None]:
    try:
        system, inside, _ = opened(path)
        info = system.get_file_info(inside)
        if info.type == pafs.FileType.NotFound:
            return None, MISSING, "the file is no longer there"
        if info.type != pafs.FileType.File:
            return None, UNREADABLE, "this is no file"
        with system.open_input_stream(inside) as stream:
            # The file may have grown since it was listed.
            data = stream.read(max_size + 1)
        if len(data) > max_size:
            return None, OVERSIZED, f"over {max_size} bytes"
        return data, READ, None
    except FileNotFoundError:
        return None, MISSING, "the file is no longer there"
    except Exception as error:  # one bad file must not stop the rest
        return None, UNREADABLE, f"{type(error).__name__}: {error}"


def read_files(manifest: DataFrame, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """The rows of a manifest with ``content``, ``state`` (read, missing, unreadable, oversized) and ``read_error``.

    Every row of the manifest comes back. Files over ``max_size`` are not read; others are opened one by one inside
    the tasks, which get about TASK_BYTES of them each.
    """
    total = manifest.agg(F.coalesce(F.sum(F.least("size", F.lit(max_size))), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(total.n, max(cores, -(-total.bytes // TASK_BYTES))))
    dealt = manifest.repartition(tasks, "source_path")
    at_path, at_size = manifest.columns.index("source_path"), manifest.columns.index("size")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i, (path, known) in enumerate(zip(batch.column(at_path).to_pylist(), batch.column(at_size).to_pylist())):
                found = (None, OVERSIZED, f"over {max_size} bytes") if known is not None and known > max_size else _content(path, max_size)
                held.append(found)
                size += len(found[0] or b"")
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    content, state, error = zip(*held)
                    rows = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(content, pa.binary()), pa.array(state, pa.string()), pa.array(error, pa.string())],
                        names=[*batch.schema.names, "content", "state", "read_error"],
                    )
                    first, held, size = i + 1, [], 0

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema.fields)
    return dealt.mapInArrow(read, f"{kinds}, content binary, state string, read_error string")
