"""Text out of files, one row per file, errors kept in the row."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecweave.functions.binding import once
from vecweave.schemas import API_DOC
from vecweave.sources.manifest import extension

Parser = Callable[[bytes], str]

# The fields every API description must have.
API_FIELDS = ("user_name", "api_name", "api_call", "api_version", "api_arguments", "functionality")

# Bytes of files that are parsed, and leave the parser, at once.
PARSED_BYTES = 4 << 20
PARSED = pa.struct([("text", pa.string()), ("error", pa.string())])

# XML names in presentation files.
_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SLIDES = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def text_of_bytes(content: Column) -> Column:
    """UTF-8 text. Bytes that are not UTF-8 give null."""
    return F.try_validate_utf8(content.cast("string"))


def text_of_json(text: Column) -> Column:
    """The ``text`` field if it is there and not null, else the whole object."""
    return F.coalesce(F.get_json_object(text, "$.text"), text)


def extract_txt(files: DataFrame) -> DataFrame:
    text = text_of_bytes(F.col("content"))
    error = F.when(F.col("content").isNotNull() & text.isNull(), "not UTF-8")
    return files.withColumn("text", text).withColumn("error", error).drop("content")


def extract_json(files: DataFrame) -> DataFrame:
    raw = text_of_bytes(F.col("content"))
    valid = F.try_parse_json(raw).isNotNull()
    return (
        files.withColumn("error", F.when(raw.isNull(), "not UTF-8").when(~valid, "not JSON"))
        .withColumn("text", F.when(F.col("error").isNull(), text_of_json(raw)))
        .drop("content")
    )


def extract_api_docs(df: DataFrame, json_column: str = "content", source: str = "source") -> DataFrame:
    """One row per element of a JSON array of API descriptions.

    Every element is checked. ``missing`` lists the required fields it lacks;
    ``content`` is the element as JSON and metadata says ``type: api, index: i``.
    """
    elements = F.from_json(F.col(json_column).cast("string"), "array<string>")
    rows = df.select(F.col(source).alias("source"), F.posexplode(elements).alias("index", "_element"))
    parsed = F.from_json("_element", API_DOC)
    lacks = F.array_compact(F.array(*[F.when(parsed[f].isNull(), F.lit(f)) for f in API_FIELDS]))
    return rows.select(
        "source",
        "index",
        F.col("_element").alias("content"),
        F.create_map(F.lit("type"), F.lit("api"), F.lit("index"), F.col("index").cast("string")).alias("metadata"),
        lacks.alias("missing"),
    )


def require_api_fields(rows: DataFrame) -> DataFrame:
    """The same rows; the job fails on the first element that lacks a field."""
    message = F.concat(F.lit("API description lacks: "), F.array_join("missing", ", "))
    checked = F.when(F.size("missing") > 0, F.raise_error(message).cast("string")).otherwise(F.col("content"))
    return rows.withColumn("content", checked).drop("missing")


def parse_pptx(content: bytes) -> str:
    """Shape texts and table cells of each slide, in slide and shape order, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as deck:
        lines: list[str] = []
        for part in _slide_parts(deck):
            tree = ElementTree.fromstring(deck.read(part)).find(f"{_SLIDES}cSld/{_SLIDES}spTree")
            for shape in [] if tree is None else tree:
                if shape.tag == f"{_SLIDES}sp":
                    body = shape.find(f"{_SLIDES}txBody")
                    lines.append("" if body is None else _paragraphs(body))
                elif shape.tag == f"{_SLIDES}graphicFrame":
                    lines.extend(_paragraphs(cell) for cell in shape.iter(f"{_DRAWING}tc"))
        return "\n".join(lines)


def _slide_parts(deck: zipfile.ZipFile) -> list[str]:
    links = ElementTree.fromstring(deck.read("ppt/_rels/presentation.xml.rels"))
    targets = {link.get("Id"): link.get("Target") for link in links}
    listed = ElementTree.fromstring(deck.read("ppt/presentation.xml")).iter(f"{_SLIDES}sldId")
    found = [targets[entry.get(f"{_OFFICE}id")] for entry in listed]
    return [t.lstrip("/") if t.startswith("/") else f"ppt/{t}" for t in found]


def _paragraphs(node: ElementTree.Element) -> str:
    out = []
    for paragraph in node.iter(f"{_DRAWING}p"):
        pieces = []
        for run in paragraph.iter():
            if run.tag == f"{_DRAWING}t":
                pieces.append(run.text or "")
            elif run.tag == f"{_DRAWING}br":
                pieces.append("\v")
        out.append("".join(pieces))
    return "\n".join(out)


def pieces(values: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Start and number of consecutive values that have about ``most`` bytes together; an empty array is one piece."""
    start, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    for i, length in enumerate(lengths):
        if i > start and size + length > most:
            yield start, i - start
            start, size = i, 0
        size += length
    yield start, len(lengths) - start


def _parsed(ext: Column, content: Column, parsers: dict[str, Parser], skip: list[str]) -> Column:
    """``struct(text, error)`` from the parser of the extension; null for skipped extensions."""

    def parse(e: str, b: bytes | None) -> tuple[str | None, str | None]:
        if e in skip:
            return None, None
        if e not in parsers:
            return None, f"unsupported document type: {e}"
        if b is None:
            return None, "no content"
        try:
            return parsers[e](bytes(b)), None
        except Exception as error:  # one bad file must not stop the rest
            return None, f"{type(error).__name__}: {error}"

    @F.arrow_udf("text string, error string")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for exts, contents in columns:
            for start, n in pieces(contents, PARSED_BYTES):
                part = zip(exts.slice(start, n), contents.slice(start, n))
                found = [parse(e.as_py(), b.as_py()) for e, b in part]
                yield pa.array([{"text": text, "error": error} for text, error in found], PARSED)

    # Only bytes that a parser will see travel to Python.
    return once(run)(ext, F.when(ext.isin(list(parsers)) & ~ext.isin(skip), content))


def extract_with(files: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """Run one parser per extension over file bytes: ``text`` or ``error`` per row."""
    ext = extension(F.col("name"))
    return (
        files.withColumn("_parsed", _parsed(ext, F.col("content"), parsers, []))
        .withColumn("text", F.col("_parsed.text"))
        .withColumn("error", F.col("_parsed.error"))
        .drop("content", "_parsed")
    )


def extract_pptx(files: DataFrame) -> DataFrame:
    return extract_with(files, {"pptx": parse_pptx})


def extract(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Text of each file by its extension, in one scan.

    txt and json stay native; other types go to ``parsers``, where a parser for pptx is
    built in and one for pdf can be plugged in. A type without a parser is an error in
    its row.
    """
    plugged = {"pptx": parse_pptx, **(parsers or {})}
    native = [e for e in ("txt", "json") if e not in plugged]
    ext = extension(F.col("name"))
    raw = text_of_bytes(F.col("content"))
    bad_json = (F.col("_ext") == "json") & F.try_parse_json(F.col("_raw")).isNull()
    native_text = F.when(F.col("_ext") == "json", text_of_json(F.col("_raw"))).otherwise(F.col("_raw"))
    return (
        files.withColumn("_ext", ext)
        .withColumn("_parsed", _parsed(F.col("_ext"), F.col("content"), plugged, native))
        .withColumn("_native", F.col("_ext").isin(native))
        .withColumn("_raw", F.when(F.col("_native"), raw))
        .withColumn(
            "error",
            F.when(~F.col("_native"), F.col("_parsed.error"))
            .when(F.col("_raw").isNull(), "not UTF-8")
            .when(bad_json, "not JSON"),
        )
        .withColumn(
            "text",
            F.when(~F.col("_native"), F.col("_parsed.text")).when(F.col("error").isNull(), native_text),
        )
        .drop("content", "_ext", "_parsed", "_native", "_raw")
    )
