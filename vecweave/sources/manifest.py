"""Manifests: one row per file, without reading its bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension to content type.
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "txt": "text/plain",
    "json": "application/json",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "md": "text/markdown",
    "csv": "text/csv",
    "html": "text/html",
    "htm": "text/html",
    "xml": "text/xml",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
SUPPORTED_TYPES = ("pdf", "txt", "json", "pptx")
MAX_FILE_SIZE = 50 * 1024 * 1024
DEFAULT_LIBRARY = "Shared Documents"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; empty for a name without one."""
    return F.lower(F.regexp_extract(name, r"[^./]\.([^./]+)$", 1))


def infer_content_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(name)), F.lit(DEFAULT_CONTENT_TYPE))


def location_metadata(path: Column) -> Column:
    """Where a file is: its folder, and bucket and key for an object store."""
    bucket = F.regexp_extract(path, "^s3[an]?://([^/]+)/", 1)
    parts = {
        "full_path": path,
        "folder": F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1),
        "s3_bucket": bucket,
        "s3_key": F.regexp_extract(path, "(?s)^s3[an]?://[^/]+/(.*)$", 1),
    }
    every = F.create_map(*[x for name, value in parts.items() for x in (F.lit(name), value)])
    return F.map_filter(every, lambda k, v: v != "")


def _files(spark: SparkSession, path: str | list[str], recursive: bool, glob: str | None) -> DataFrame:
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreMissingFiles", "true")
    )
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _manifest_columns(files: DataFrame) -> list[Column]:
    name = file_name(F.col("path"))
    return [
        name.alias("name"),
        F.col("path").alias("source_path"),
        infer_content_type(name).alias("content_type"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
        location_metadata(F.col("path")).alias("metadata"),
    ]


def scan_manifest(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Name, path, type, size and time of each file. The scan does not read the content.

    ``path`` is any Hadoop path, so an object store works the same way. Spark's file
    sources leave out files of zero bytes, which have nothing to extract.
    """
    files = _files(spark, path, recursive, glob)
    return files.select(*_manifest_columns(files))


def load_content(
    spark: SparkSession,
    path: str | list[str],
    recursive: bool = True,
    glob: str | None = None,
    wanted: DataFrame | None = None,
    max_size: int | None = None,
) -> DataFrame:
    """Manifest rows with their bytes; files that vanish or cannot be read are left out.

    ``path`` may be a list of files. ``wanted`` keeps only the files of another manifest, and
    ``unreadable`` tells which of them are missing here. ``glob`` and ``max_size`` reach the
    scan: bytes of other files are not read, whatever their size.
    """
    files = _files(spark, path, recursive, glob)
    if max_size is not None:
        files = files.filter(F.col("length") <= max_size)
    rows = files.select(*_manifest_columns(files), F.col("content"))
    return rows if wanted is None else rows.join(wanted.select("source_path"), "source_path", "left_semi")


def unreadable(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """The rows of a manifest whose file gave no content."""
    return wanted.join(loaded.select("source_path"), "source_path", "left_anti")


def type_glob(types: tuple[str, ...] | list[str]) -> str:
    """A file glob for extensions in any case."""
    each = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in t) for t in types]
    return "*.{" + ",".join(each) + "}"


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` do not.

    A pattern is matched from the start of the path or after any ``/``.
    """
    out = []
    i = 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return f"(?s)^(?:.*/)?{''.join(out)}$"


def _any_glob(path: Column, patterns: list[str]) -> Column:
    matched = F.lit(False)
    for p in patterns:
        matched = matched | path.rlike(glob_regex(p))
    return matched


def filter_manifest(
    manifest: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    types: tuple[str, ...] | list[str] = SUPPORTED_TYPES,
    max_size: int = MAX_FILE_SIZE,
) -> DataFrame:
    """Keep files of a supported type and size that match a glob and no excluded one."""
    if max_size <= 0:
        raise ValueError("max_size must be positive")
    path = F.col("source_path")
    keep = (F.coalesce("size", F.lit(0)) <= max_size) & extension(F.col("name")).isin(list(types))
    if include and "**/*" not in include:
        keep = keep & _any_glob(path, include)
    if exclude:
        keep = keep & ~_any_glob(path, exclude)
    return manifest.filter(keep)


def manifest_preview(
    manifest: DataFrame, types: tuple[str, ...] | list[str] = SUPPORTED_TYPES, by: list[str] | None = None
) -> DataFrame:
    """Files in all, supported and not; bytes and megabytes of the supported ones."""
    supported = extension(F.col("name")).isin(list(types))
    size = F.coalesce(F.sum(F.when(supported, F.col("size"))), F.lit(0))
    return manifest.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count(F.when(supported, 1)).alias("supported_documents"),
        F.count(F.when(~supported, 1)).alias("unsupported_documents"),
        size.alias("total_size_bytes"),
        F.round(size / (1024 * 1024), 2).alias("total_size_mb"),
    )


def type_counts(manifest: DataFrame, types: tuple[str, ...] | list[str] = SUPPORTED_TYPES) -> DataFrame:
    ext = extension(F.col("name"))
    return manifest.filter(ext.isin(list(types))).groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("n"))


# Scheme, authority and the rest of an address.
_ADDRESS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)(.*)$"
_OBJECT_SCHEMES = ("s3", "s3a", "s3n")
# Hosts of the object store: the bucket before the service name, or as first part of the path.
_OBJECT_HOST = r"^(?:(.+)\.)?s3(?:[.-][a-z0-9-]+)*\.amazonaws\.com(?:\.cn)?$"
_BUCKET_NAME = r"^[a-z0-9](?:[a-z0-9.-]{1,61})[a-z0-9]$"


def classify_sources(df: DataFrame, uri: str = "uri") -> DataFrame:
    """Source type of each URI with its bucket and prefix, or site and library.

    Decided by the scheme and the host alone. An object-store scheme names the bucket as its
    authority; over http(s) the bucket is the part of the host before the service name, or
    the first part of the path. A host within ``sharepoint.com``, or with ``sharepoint`` as a label,
    is a site server. Other web hosts are ``unresolved``; everything else, any other Hadoop
    scheme included, is ``local``. ``valid`` is false for a bucket name or site address that
    breaks the rules.
    """
    part = lambda n: F.regexp_extract(uri, _ADDRESS, n)
    scheme, authority, rest = F.lower(part(1)), part(2), part(3)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    web = scheme.isin("http", "https")
    stored = scheme.isin(*_OBJECT_SCHEMES)
    served = web & host.rlike(_OBJECT_HOST)
    in_host = F.regexp_extract(host, _OBJECT_HOST, 1)
    path = F.regexp_replace(F.regexp_replace(rest, "[?#].*$", ""), "^/", "")
    kind = (
        F.when(stored | served, "s3")
        .when(web & host.rlike(r"(^|\.)sharepoint(\.|$)"), "sharepoint")
        .when(web, "unresolved")
        .otherwise("local")
    )
    bucket = F.when(stored, authority).when(in_host != "", in_host).otherwise(F.split(path, "/")[0])
    prefix = F.when(stored, F.regexp_replace(rest, "^/", "")).when(in_host != "", path).otherwise(F.regexp_extract(path, "(?s)^[^/]*/(.*)$", 1))
    # A site address: /sites/<name>, then the library.
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    is_site = (F.col("source_type") == "sharepoint") & (F.get(steps, F.lit(0)) == "sites") & (F.size(steps) > 1)
    is_site = is_site & host.endswith(".sharepoint.com")
    library = F.array_join(F.slice(steps, 3, F.greatest(F.size(steps) - 2, F.lit(0))), "/")
    is_s3 = F.col("source_type") == "s3"
    rows = df.withColumn("source_type", kind)
    return rows.select(
        "*",
        F.when(is_s3, bucket).alias("bucket"),
        F.when(is_s3, prefix).alias("prefix"),
        F.when(is_site, F.concat(scheme, F.lit("://"), authority, F.lit("/sites/"), steps[1])).alias("site"),
        F.when(is_site, F.when(library == "", DEFAULT_LIBRARY).otherwise(library)).alias("library"),
        F.when(is_s3, bucket.rlike(_BUCKET_NAME) & ~bucket.contains(".."))
        .when(F.col("source_type") == "sharepoint", is_site)
        .otherwise(F.col("source_type") != "unresolved")
        .alias("valid"),
    )
