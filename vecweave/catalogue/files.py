"""Manifests and extraction, over manifests and files made from ``documents`` and ``pages``."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecweave.catalogue.base import documents, query, spread, table
from vecweave.operators.ledger import fingerprint
from vecweave.plans.retrieval import claim, process_incremental
from vecweave.session import shared_dir, stored
from vecweave.sources import extract as X
from vecweave.sources import files as FS
from vecweave.sources import manifest as M

EXTENSIONS = "element_at(array('txt', 'json', 'pptx', 'PDF', 'docx', 'bin'), int(doc_id % 6) + 1)"

SQL_FILES = """f AS (
  SELECT doc_id, source, text, octet_length(encode(text)) AS size, ext, 'doc_' || doc_id || '.' || ext AS name,
         '/data/' || source || '/doc_' || doc_id || '.' || ext AS path
  FROM (SELECT *, (['txt', 'json', 'pptx', 'PDF', 'docx', 'bin'])[(doc_id % 6 + 1)::INT] AS ext FROM documents) d)"""


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest: six file types, the byte size and a path per source."""
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("."), F.expr(EXTENSIONS))
    return documents(spark, sf_dir).select(
        "doc_id",
        "text",
        "source",
        name.alias("name"),
        F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), name).alias("source_path"),
        F.octet_length("text").cast("bigint").alias("size"),
    )


@query(
    "manifest_preview",
    f"""WITH {SQL_FILES}
SELECT source, count(*) AS total_documents, count(*) FILTER (ok) AS supported_documents,
       count(*) FILTER (NOT ok) AS unsupported_documents, coalesce(sum(size) FILTER (ok), 0)::BIGINT AS total_size_bytes,
       round(coalesce(sum(size) FILTER (ok), 0) / 1048576.0::DOUBLE, 2) AS total_size_mb
FROM (SELECT *, lower(ext) IN ('pdf', 'txt', 'json', 'pptx') AS ok FROM f) x GROUP BY 1""",
)
def manifest_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.manifest_preview(document_files(spark, sf_dir), by=["source"])


@query(
    "manifest_types",
    f"WITH {SQL_FILES} SELECT lower(ext) AS extension, count(*) AS n FROM f WHERE lower(ext) IN ('pdf', 'txt', 'json', 'pptx') GROUP BY 1",
)
def manifest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.type_counts(document_files(spark, sf_dir))


@query(
    "manifest_filter",
    f"""WITH {SQL_FILES}
SELECT doc_id, name FROM f
WHERE size <= 8000 AND lower(ext) IN ('pdf', 'txt', 'json', 'pptx') AND regexp_matches(path, '^/data/src1[^/]*/[^/]*$')
  AND NOT regexp_matches(name, '^doc_[^/]*5[.][^/]*$')""",
)
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = M.filter_manifest(
        document_files(spark, sf_dir), include=["data/src1*/*"], exclude=["**/doc_*5.*"], max_size=8000
    )
    return kept.select("doc_id", "name")


@query(
    "content_types",
    f"""WITH {SQL_FILES}
SELECT doc_id, CASE lower(ext) WHEN 'txt' THEN 'text/plain' WHEN 'json' THEN 'application/json' WHEN 'pdf' THEN 'application/pdf'
  WHEN 'pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation'
  WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  ELSE 'application/octet-stream' END AS content_type FROM f""",
)
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("doc_id", M.infer_content_type(F.col("name")).alias("content_type"))


@query(
    "fingerprint",
    f"""WITH {SQL_FILES}
SELECT doc_id, substr(sha256(path || ':' || (doc_id * 1000003 + 1704067200000000) || ':' || size), 1, 16) AS fingerprint FROM f""",
)
def fingerprint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    modified = F.timestamp_micros(F.col("doc_id") * 1000003 + 1704067200000000)
    files = document_files(spark, sf_dir)
    return files.select("doc_id", fingerprint(F.col("source_path"), modified, F.col("size")).alias("fingerprint"))


@query(
    "classify_uris",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/?(.*)$', 1) AS rest FROM pages),
u AS (
  SELECT page_id, 0 AS form, url AS uri, 'unresolved' AS source_type, NULL AS bucket, NULL AS prefix, NULL AS site, NULL AS library, false AS valid FROM p
  UNION ALL SELECT page_id, 1, 's3://' || host || '/' || rest, 's3', host, rest, NULL, NULL,
    length(host) BETWEEN 3 AND 63 AND regexp_matches(host, '^[a-z0-9]([a-z0-9.-]*)[a-z0-9]$') AND NOT contains(host, '..') FROM p
  UNION ALL SELECT page_id, 2, 's3://Bad_' || host, 's3', 'Bad_' || host, '', NULL, NULL, false FROM p
  UNION ALL SELECT page_id, 3, 'https://t' || page_id || '.sharepoint.com/sites/s' || page_id || '/Docs/' || page_id, 'sharepoint', NULL, NULL,
    'https://t' || page_id || '.sharepoint.com/sites/s' || page_id, 'Docs/' || page_id, true FROM p
  UNION ALL SELECT page_id, 4, 'https://t.sharepoint.com/sites/s' || page_id, 'sharepoint', NULL, NULL,
    'https://t.sharepoint.com/sites/s' || page_id, 'Shared Documents', true FROM p
  UNION ALL SELECT page_id, 5, '/srv/files/' || page_id, 'local', NULL, NULL, NULL, NULL, true FROM p
  UNION ALL SELECT page_id, 6, 's3a://bucket-' || page_id || '/k', 's3', 'bucket-' || page_id, 'k', NULL, NULL, true FROM p
  UNION ALL SELECT page_id, 7, 'https://bucket-' || page_id || '.s3.eu-west-1.amazonaws.com/k/' || page_id, 's3', 'bucket-' || page_id, 'k/' || page_id, NULL, NULL, true FROM p
  UNION ALL SELECT page_id, 8, 'https://docs3.example.com/' || page_id, 'unresolved', NULL, NULL, NULL, NULL, false FROM p)
SELECT * FROM u""",
)
def classify_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses and eight other forms of address made from each page."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    rest = F.regexp_extract("url", r"^https?://[^/]+/?(.*)$", 1)
    page = F.col("page_id").cast("string")
    forms = F.array(
        F.col("url"),
        F.concat(F.lit("s3://"), host, F.lit("/"), rest),
        F.concat(F.lit("s3://Bad_"), host),
        F.concat(F.lit("https://t"), page, F.lit(".sharepoint.com/sites/s"), page, F.lit("/Docs/"), page),
        F.concat(F.lit("https://t.sharepoint.com/sites/s"), page),
        F.concat(F.lit("/srv/files/"), page),
        F.concat(F.lit("s3a://bucket-"), page, F.lit("/k")),
        F.concat(F.lit("https://bucket-"), page, F.lit(".s3.eu-west-1.amazonaws.com/k/"), page),
        F.concat(F.lit("https://docs3.example.com/"), page),
    )
    uris = table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "uri"))
    return M.classify_sources(uris)


@query(
    "json_extract_text",
    """SELECT doc_id, md5(CASE WHEN doc_id % 4 IN (0, 1) THEN text WHEN doc_id % 4 = 2 THEN '{"lang":"' || lang || '"}'
       ELSE n_chars::VARCHAR END) AS text FROM documents""",
)
def json_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects with a text, without one, and with a number as text."""
    kind = F.col("doc_id") % 4
    raw = (
        F.when(kind.isin(0, 1), F.to_json(F.struct("text", "lang")))
        .when(kind == 2, F.to_json(F.struct("lang")))
        .otherwise(F.to_json(F.struct(F.col("n_chars").alias("text"))))
    )
    docs = documents(spark, sf_dir).select("doc_id", raw.alias("raw"))
    return docs.select("doc_id", F.md5(X.text_of_json(F.col("raw"))).alias("text"))


@query(
    "api_docs_explode",
    """WITH e AS (
  SELECT page_id, url, unnest([0, 1]) AS i FROM pages)
SELECT page_id::VARCHAR AS source, i::INT AS index, 'api' AS type, i::VARCHAR AS meta_index,
       'call_' || i AS api_call, CASE WHEN page_id % 10 = 3 AND i = 1 THEN 'functionality' ELSE '' END AS missing
FROM e""",
)
def api_docs_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two API descriptions per page; in one page of ten the second lacks a field."""

    def doc(i: int):
        whole = F.col("url")
        return F.struct(
            F.concat(F.lit("user"), F.col("page_id")).alias("user_name"),
            F.lit(f"api_{i}").alias("api_name"),
            F.lit(f"call_{i}").alias("api_call"),
            F.lit("1.0").alias("api_version"),
            F.create_map(F.lit("page"), F.col("page_id").cast("string")).alias("api_arguments"),
            (F.when((F.col("page_id") % 10 != 3), whole) if i else whole).alias("functionality"),
        )

    files = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("source"), F.to_json(F.array(doc(0), doc(1))).alias("content")
    )
    rows = X.extract_api_docs(files)
    return rows.select(
        "source",
        "index",
        F.element_at("metadata", F.lit("type")).alias("type"),
        F.element_at("metadata", F.lit("index")).alias("meta_index"),
        F.get_json_object("content", "$.api_call").alias("api_call"),
        F.array_join("missing", ",").alias("missing"),
    )


@F.arrow_udf(T.BinaryType())
def _deck(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A presentation with one slide, whose shape holds a text line per paragraph."""
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    p = "http://schemas.openxmlformats.org/presentationml/2006/main"
    o = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    links = "http://schemas.openxmlformats.org/package/2006/relationships"

    def one(text: str) -> bytes:
        lines = "".join(f"<a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p>" for line in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(
                "ppt/presentation.xml",
                f'<p:presentation xmlns:p="{p}" xmlns:r="{o}"><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
            )
            z.writestr(
                "ppt/_rels/presentation.xml.rels",
                f'<Relationships xmlns="{links}"><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>',
            )
            z.writestr(
                "ppt/slides/slide1.xml",
                f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree><p:sp><p:txBody>{lines}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>',
            )
        return out.getvalue()

    for texts in columns:
        for start, n in X.pieces(texts, X.PARSED_BYTES):
            yield pa.array([one(text.as_py()) for text in texts.slice(start, n)], pa.binary())


@query(
    "extract_mixed",
    f"""WITH {SQL_FILES}
SELECT doc_id, CASE WHEN ext IN ('txt', 'json', 'pptx') THEN md5(text) END AS text,
       CASE WHEN ext IN ('PDF', 'docx', 'bin') THEN 'unsupported document type: ' || lower(ext) END AS error FROM f""",
)
def extract_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the bytes of text, JSON and presentation files, and of types without a parser."""
    files = document_files(spark, sf_dir)
    ext = M.extension(F.col("name"))
    content = (
        F.when(ext == "json", F.encode(F.to_json(F.struct("text")), "UTF-8"))
        .when(ext == "pptx", _deck("text"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    made = X.extract(files.withColumn("content", content).drop("text"))
    return made.select("doc_id", F.md5("text").alias("text"), "error")


@query(
    "extract_pptx",
    "SELECT doc_id, md5(text) AS text, NULL::VARCHAR AS error FROM documents",
)
def extract_pptx(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir).select("doc_id", F.lit("deck.pptx").alias("name"), _deck("text").alias("content"))
    return X.extract_pptx(files).select("doc_id", F.md5("text").alias("text"), "error")


# Files that one folder of written files holds.
FOLDER_FILES = 1000


def write_files(rows: DataFrame, path: str, prefix: str = "") -> None:
    """A key and a text as one text file per key and task under ``path``, a line per row, written inside the tasks.

    Files are named ``<key column>=<key>.txt``. A folder holds FOLDER_FILES of them: a folder for each costs its
    listing far more than the file does. ``prefix`` begins the names of folders, so that one call does not write
    over another's.
    """
    name, text = rows.columns

    def write(batches):
        system, root, _ = FS.opened(path)
        task, held, n = f"{root}/{prefix}{TaskContext.get().partitionId():05d}", None, 0

        def put(key, lines):
            folder = f"{task}-{n // FOLDER_FILES:05d}"
            if n % FOLDER_FILES == 0:
                system.create_dir(folder)
            # Readers leave out names that begin so, until the file is whole.
            with system.open_output_stream(f"{folder}/_{key}") as out:
                out.write(b"".join(lines))
            system.move(f"{folder}/_{key}", f"{folder}/{name}={key}.txt")

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                line = (line or "").encode() + b"\n"
                if held and held[0] == key:
                    held[1].append(line)
                    continue
                if held:
                    put(*held)
                    n += 1
                held = (key, [line])
        if held:
            put(*held)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select(name, text).sortWithinPartitions(name).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def write_pages(pages: DataFrame, path: str, prefix: str = "") -> None:
    """``page_id, html`` as files, see ``write_files``."""
    write_files(pages.select("page_id", "html"), path, prefix)


def page_files(spark: SparkSession, sf_dir: str) -> str:
    """Each page's HTML as one text file in the shared folder."""
    path = shared_dir(spark, "page-files")
    write_pages(spread(table(spark, sf_dir, "pages")), path)
    return path


def page_of(path: str):
    return F.regexp_extract(path, r"page_id=(\d+)", 1).cast("bigint")


@query(
    "manifest_scan",
    "SELECT page_id, 'txt' AS ext, octet_length(encode(html)) + 1 AS size, 'text/plain' AS content_type, true AS has_time FROM pages",
)
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = M.scan_manifest(spark, page_files(spark, sf_dir), glob="*.txt")
    return files.select(
        page_of("source_path").alias("page_id"),
        M.extension(F.col("name")).alias("ext"),
        "size",
        "content_type",
        F.col("last_modified").isNotNull().alias("has_time"),
    )


@query("load_content", "SELECT page_id, md5(html || chr(10)) AS digest, NULL::VARCHAR AS error FROM pages")
def load_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = M.load_content(spark, page_files(spark, sf_dir), glob="*.txt")
    return X.extract_txt(files).select(page_of("source_path").alias("page_id"), F.md5("text").alias("digest"), "error")


def _spoiled(name: str):
    """After the listing, by page: gone, replaced by a folder, emptied, or as it was."""

    def spoil(batches):
        for batch in batches:
            for path, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inside, _ = FS.opened(path)
                if page % 5 == 1:
                    system.delete_file(inside)
                elif page % 5 == 2:
                    system.delete_file(inside)
                    system.create_dir(inside)
                elif page % 5 == 3:
                    system.open_output_stream(inside).close()
            yield pa.RecordBatch.from_arrays([batch.column(1)], names=[name])

    return spoil


@query(
    "read_states",
    """SELECT page_id, CASE WHEN octet_length(encode(html)) + 1 > 3000 THEN 'oversized' WHEN page_id % 5 = 1 THEN 'missing'
       WHEN page_id % 5 = 2 THEN 'unreadable' ELSE 'read' END AS state,
       CASE WHEN octet_length(encode(html)) + 1 > 3000 OR page_id % 5 IN (1, 2) THEN NULL WHEN page_id % 5 = 3 THEN md5('') ELSE md5(html || chr(10)) END AS digest
FROM pages""",
)
def read_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that vanish, turn into folders or are emptied between listing and reading, and files that are too large."""
    listed = stored(FS.list_files(spark, page_files(spark, sf_dir), glob="*.txt"), "listed")
    paged = listed.select("source_path", page_of("source_path").alias("page_id"))
    paged.mapInArrow(_spoiled("page_id"), "page_id bigint").count()
    made = FS.read_files(listed, max_size=3000)
    return made.select(page_of("source_path").alias("page_id"), "state", F.md5("content").alias("digest"))


@query(
    "incremental_failures",
    """SELECT page_id, CASE WHEN page_id % 5 IN (1, 2) THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN page_id % 5 = 1 THEN 'missing' WHEN page_id % 5 = 2 THEN 'unreadable' END AS reason FROM pages""",
)
def incremental_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after a run over files of which some were lost after they were claimed."""
    path, now, work = page_files(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"), shared_dir(spark, "extracted")
    due, _ = claim(spark, path, None, work, now)
    due.select("source_path", page_of("source_path").alias("page_id")).mapInArrow(_spoiled("page_id"), "page_id bigint").count()
    run = process_incremental(spark, path, None, work, now, due=due)
    ended = run.transitions.filter(F.col("status").isin("completed", "failed"))
    pages = due.select("fingerprint", page_of("source_path").alias("page_id"))
    return ended.join(pages, "fingerprint").select("page_id", "status", F.split("error_message", ":")[0].alias("reason"))


@query(
    "process_incremental",
    """WITH c AS (SELECT page_id, unnest(range((length(html) + 1 + 511) // 512)) AS i FROM pages)
SELECT 1 AS run, page_id, count(*) AS n_chunks, md5(any_value(html) || chr(10)) AS digest FROM c JOIN pages USING (page_id) GROUP BY 2
UNION ALL SELECT 2, -1, count(DISTINCT page_id), '' FROM c""",
)
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run chunks every file; a second run over the same files finds them completed."""
    path, now = page_files(spark, sf_dir), F.lit("2024-02-01").cast("timestamp")
    first = process_incremental(spark, path, None, shared_dir(spark, "extracted"), now)
    second = process_incremental(spark, path, first.transitions, shared_dir(spark, "extracted"), now)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "")
    run1 = first.chunks.groupBy(page_of("source").alias("page_id")).agg(F.count(F.lit(1)).alias("n_chunks"), F.md5(text).alias("digest"))
    done = first.transitions.filter("status = 'completed'").agg(F.count(F.lit(1)).alias("n"))
    again = second.chunks.agg((-F.count(F.lit(1))).alias("n"))
    run2 = done.unionByName(again).agg(F.sum("n").alias("n_chunks")).select(
        F.lit(2).alias("run"), F.lit(-1).cast("bigint").alias("page_id"), "n_chunks", F.lit("").alias("digest")
    )
    return run1.select(F.lit(1).alias("run"), "page_id", "n_chunks", "digest").unionByName(run2)
