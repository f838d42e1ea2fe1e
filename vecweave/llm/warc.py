"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package holds stored members only: ``archive/data.warc.gz``, each record a gzip member of
its own, and ``indexes/index.cdxj`` with the place of each record. The reader parses the
central directory (with its ZIP64 forms) from the end of the file, finds where the members'
bytes begin, reads the index, and from then on reads single records; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.llm.components import stored
from vecweave.session import shared_dir

# Bytes of records that one task reads back, about.
READ_BYTES = 64 << 20

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response record, or with ``refers_to`` a revisit that keeps the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = " ".join((url or "").split())
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", clean),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return _block(headers, head + payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _block([*headers, ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], head)


class Record(NamedTuple):
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None


def parse_record(raw: bytes) -> Record:
    """One record; a response whose payload does not have its digest or length is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
    number = lambda v: int(v[10:-1]) if v and v != "<urn:page:>" else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kept = payload if fields["warc-type"] == "response" else None
    if kept is not None and (len(kept) != size or payload_digest(kept) != digest):
        raise ValueError("a payload is not what its record says")
    return Record(number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], number(fields.get("warc-refers-to", "")), digest, size, kept)


# ---- packages


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


def members(read, length: int) -> dict[str, Member]:
    """The central directory of a ZIP file; ``read(start, size)`` reads a range of it."""
    tail_at = max(0, length - 65_557)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        # The ZIP64 locator stands right before; it names the place of the wide form.
        where = tail_at + at - 20
        sign, _, wide, _ = struct.unpack("<4sIQI", read(where, 20))
        if sign != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        count, size, start = struct.unpack("<QQQ", read(wide, 56)[32:56])
    directory, out, p = read(start, size), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
        packed, full, n, extra, note = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        header = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8")
        q, end = p + 46 + n, p + 46 + n + extra
        while q + 4 <= end:
            tag, width = struct.unpack("<HH", directory[q : q + 4])
            if tag == 1:  # wide values of the fields that hold all ones, in this order
                at8 = q + 4
                if full == 0xFFFFFFFF:
                    full, at8 = struct.unpack("<Q", directory[at8 : at8 + 8])[0], at8 + 8
                if packed == 0xFFFFFFFF:
                    packed, at8 = struct.unpack("<Q", directory[at8 : at8 + 8])[0], at8 + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack("<Q", directory[at8 : at8 + 8])[0]
            q += 4 + width
        out[name] = Member(name, method, packed, header)
        p = end + note
    return out


def member_start(read, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    sign, n, extra = struct.unpack("<4s22xHH", read(member.header, 30))
    if sign != b"PK\3\4":
        raise ValueError("broken local header")
    return member.header + 30 + n + extra


def write_package(f, pages: Iterator[tuple]) -> int:
    """Writes ``(page_id, url, payload, refers_to)`` rows to an open file; returns how many."""
    index, at = [], 0
    with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(DATA, "w", force_zip64=True) as data:
            for page_id, url, payload, refers_to in pages:
                raw = gzip.compress(page_record(page_id, url, payload, refers_to), 3, mtime=0)
                data.write(raw)
                index.append(json.dumps({"id": page_id, "offset": at, "length": len(raw)}))
                at += len(raw)
        with package.open(INDEX, "w", force_zip64=True) as lines:
            lines.write("".join(f"{line}\n" for line in index).encode())
    return len(index)


def record_ranges(read, length: int) -> Iterator[tuple[int, int]]:
    """``(start, size)`` of every record within the package file."""
    found = members(read, length)
    start, index = member_start(read, found[DATA]), found[INDEX]
    for line in read(member_start(read, index), index.size).splitlines():
        told = json.loads(line)
        yield start + told["offset"], told["length"]


# ---- Spark


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes one package per task under ``root``; returns ``path, n_records``, already stored.

    Of equal payloads of at least ``min_bytes`` bytes the row with the largest page_id is the
    response and the others revisit it; rows repeated with that page_id are responses too. A
    null page_id is smaller than any; if all are null, all are responses. Null html is empty.
    A task that runs again writes another file; only files named in the result count.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("_k", F.sha2("payload", 256))
    same = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("_k").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    same = same.filter("n > 1").select(F.col("_k").alias("_s"), "refers_to")
    rows = rows.join(same, F.col("_k") == F.col("_s"), "left")
    own = F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = rows.select("page_id", "url", "payload", F.when(~own, F.col("refers_to")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(root)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
        flow = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(4))))
        first = next(flow, None)
        if first is None:
            return
        with fs.open_output_stream(name) as f:
            n = write_package(f, (row for part in ((first,), flow) for row in part))
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return stored(rows.mapInArrow(write, "path string, n_records bigint"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the packages named in ``path``: id, url, type, digest, size, payload.

    Indexes are read first; then records are dealt to tasks and each is read by its range.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as f:
                    found = list(record_ranges(lambda start, size: f.read_at(size, start), f.size()))
                starts, sizes = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "start", "size"]
                )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.sort_by([("path", "ascending"), ("start", "ascending")])
            out, held, f = [], None, None
            for path, start, size in zip(*(order.column(i).to_pylist() for i in range(3))):
                if path != held:
                    if f is not None:
                        f.close()
                    fs, name = _filesystem(path)
                    held, f = path, fs.open_input_file(name)
                out.append(parse_record(gzip.decompress(f.read_at(size, start))))
                if len(out) == 256:
                    yield _rows(out)
                    out = []
            if f is not None:
                f.close()
            yield _rows(out)

    found = stored(archives.select("path").mapInArrow(ranges, "path string, start bigint, size bigint"), "ranges")
    # The rows are small, what they name is not: tasks are counted by the bytes that they will read.
    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    cores = found.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(total.n, max(cores, -(-total.bytes // READ_BYTES))))
    return found.repartition(tasks, "path", "start").mapInArrow(records, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary")


def _rows(out: list[Record]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 7
    page_id, url, kind, refers, digest, size, payload = columns
    return pa.RecordBatch.from_arrays(
        [pa.array(page_id, pa.int64()), pa.array(url, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64()),
         pa.array(digest, pa.string()), pa.array(size, pa.int64()), pa.array(payload, pa.binary())],
        names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"],
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written to packages in the shared folder and read back; one row per page."""
    archives = write_archives(pages, shared_dir(pages.sparkSession, "warc"), min_bytes)
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
