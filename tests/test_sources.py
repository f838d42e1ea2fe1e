from __future__ import annotations

import io
import json
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecweave.catalogue.files import _deck, write_pages
from vecweave.operators.ledger import ledger_state
from vecweave.plans.retrieval import process_incremental
from vecweave.schemas import MANIFEST
from vecweave.sources import extract as X
from vecweave.sources import manifest as M
from vecweave.sources.files import LISTING_TASKS, list_files

A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
L = "http://schemas.openxmlformats.org/package/2006/relationships"


def para(*texts):
    return "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)


def deck():
    table = "<a:tbl>" + "".join(
        "<a:tr>" + "".join(f"<a:tc><a:txBody>{para(c)}</a:txBody></a:tc>" for c in row) + "</a:tr>" for row in (("a", "b"), ("c", "d"))
    ) + "</a:tbl>"
    slides = [
        f"<p:sp><p:txBody>{para('Title')}</p:txBody></p:sp><p:sp><p:txBody>{para('one', 'two')}</p:txBody></p:sp>",
        f"<p:graphicFrame><a:graphic><a:graphicData>{table}</a:graphicData></a:graphic></p:graphicFrame>",
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        # Listed second first, to see that the presentation's order counts.
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="x2"/><p:sldId r:id="x1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{L}"><Relationship Id="x2" Target="slides/slide2.xml"/><Relationship Id="x1" Target="slides/slide1.xml"/></Relationships>')
        for n, body in zip((2, 1), slides):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "test.txt").write_text("line one\nline two\nGröße\n", encoding="utf-8")
    (tmp_path / "test.json").write_text(json.dumps({"text": "from json", "metadata": {"type": "t"}}))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "latin.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "sub" / "slides.pptx").write_bytes(deck())
    (tmp_path / "sub" / "broken.pptx").write_bytes(b"not a zip")
    (tmp_path / "test.pdf").write_bytes(b"%PDF-1.4 not pdf")
    (tmp_path / "readme.md").write_text("# no")
    return str(tmp_path)


def test_manifest_reads_no_content(spark, folder):
    found = M.scan_manifest(spark, folder)
    assert "content#" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    got = {r["name"]: r for r in found.collect()}
    assert len(got) == 8 and got["test.txt"]["size"] == 26
    assert got["test.txt"]["content_type"] == "text/plain" and got["slides.pptx"]["content_type"].endswith("presentation")
    assert M.scan_manifest(spark, folder, recursive=False).count() == 6
    assert found.schema.simpleString() == spark.createDataFrame([], MANIFEST).schema.simpleString()
    assert got["slides.pptx"]["metadata"]["folder"].endswith("/sub")


def test_location_of_objects(spark):
    df = spark.createDataFrame([("s3a://b/x/y.txt",)], "p string")
    got = df.select(M.location_metadata(F.col("p"))).first()[0]
    assert got == {"full_path": "s3a://b/x/y.txt", "folder": "s3a://b/x", "s3_bucket": "b", "s3_key": "x/y.txt"}


def test_filter(spark, folder):
    found = M.scan_manifest(spark, folder)

    def names(**options):
        return sorted(r["name"] for r in M.filter_manifest(found, **options).collect())

    everything = ["bad.json", "broken.pptx", "latin.txt", "slides.pptx", "test.json", "test.pdf", "test.txt"]
    assert names() == everything == names(include=["**/*"])
    assert names(include=["*.txt"]) == ["latin.txt", "test.txt"]
    assert names(include=["sub/*"], exclude=["**/broken*"]) == ["slides.pptx"]
    assert names(types=("md",)) == ["readme.md"]
    assert names(max_size=10) == ["bad.json", "broken.pptx", "latin.txt"]
    with pytest.raises(ValueError):
        names(max_size=0)


@pytest.mark.parametrize(
    "pattern, path, want",
    [
        ("**/*", "/a/b.txt", True), ("*.txt", "/a/b.txt", True), ("a/*.txt", "/x/a/b.txt", True), ("a/*.txt", "/a/c/b.txt", False),
        ("a/**/b.txt", "/a/c/d/b.txt", True), ("a/**/b.txt", "/a/b.txt", True), ("b?.txt", "/a/b1.txt", True), ("b.t", "/a/bxt", False),
    ],
)
def test_globs(spark, pattern, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.filter(F.col("p").rlike(M.glob_regex(pattern))).count() == int(want)


def test_preview(spark, folder):
    got = M.manifest_preview(M.scan_manifest(spark, folder)).first()
    assert (got["total_documents"], got["supported_documents"], got["unsupported_documents"]) == (8, 7, 1)
    assert {r["extension"]: r["n"] for r in M.type_counts(M.scan_manifest(spark, folder)).collect()} == {"txt": 2, "json": 2, "pptx": 2, "pdf": 1}


def test_extension_and_type(spark):
    df = spark.createDataFrame([("a.TXT",), ("archive.tar.gz",), ("none",), (".hidden",)], "n string")
    assert [r[0] for r in df.select(M.extension(F.col("n"))).collect()] == ["txt", "gz", "", ""]
    assert [r[0] for r in df.select(M.infer_content_type(F.col("n"))).collect()][2] == "application/octet-stream"


@pytest.mark.parametrize(
    "uri, want",
    [
        ("s3://my-bucket/a/b.txt", ("s3", "my-bucket", "a/b.txt", None, None, True)),
        ("s3://my-bucket", ("s3", "my-bucket", "", None, None, True)),
        ("s3://ab", ("s3", "ab", "", None, None, False)),
        ("s3://a..b/x", ("s3", "a..b", "x", None, None, False)),
        ("s3://-abc/x", ("s3", "-abc", "x", None, None, False)),
        ("S3://Upper/x", ("s3", "Upper", "x", None, None, False)),
        ("s3a://bucket/x", ("s3", "bucket", "x", None, None, True)),
        ("https://docs3.example.com/a", ("unresolved", None, None, None, None, False)),
        ("https://bkt.s3.eu-west-1.amazonaws.com/k?versionId=1", ("s3", "bkt", "k", None, None, True)),
        ("https://s3.eu-west-1.amazonaws.com/my.bucket/a/b", ("s3", "my.bucket", "a/b", None, None, True)),
        ("https://s3-us-west-2.amazonaws.com/bkt", ("s3", "bkt", "", None, None, True)),
        ("hdfs://name/a", ("local", None, None, None, None, True)),
        ("https://example.com/sharepoint.com/x", ("unresolved", None, None, None, None, False)),
        ("https://b.s3.amazonaws.com/k", ("s3", "b", "k", None, None, False)),
        ("https://t.sharepoint.com/sites/hr/Shared Documents/x", ("sharepoint", None, None, "https://t.sharepoint.com/sites/hr", "Shared Documents/x", True)),
        ("https://t.sharepoint.com/sites/hr", ("sharepoint", None, None, "https://t.sharepoint.com/sites/hr", "Shared Documents", True)),
        ("https://t.sharepoint.com/teams/hr", ("sharepoint", None, None, None, None, False)),
        ("https://example.com/x", ("unresolved", None, None, None, None, False)),
        ("./docs", ("local", None, None, None, None, True)),
    ],
)
def test_classify(spark, uri, want):
    got = M.classify_sources(spark.createDataFrame([(uri,)], "uri string")).first()
    assert (got["source_type"], got["bucket"], got["prefix"], got["site"], got["library"], got["valid"]) == want


def test_extract_every_type_in_one_scan(spark, folder):
    made = X.extract(M.load_content(spark, folder))
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile") == 1
    got = {r["name"]: (r["text"], r["error"]) for r in made.collect()}
    assert got["test.txt"] == ("line one\nline two\nGröße\n", None)
    assert got["test.json"] == ("from json", None)
    assert got["bad.json"] == (None, "not JSON") and got["latin.txt"] == (None, "not UTF-8")
    assert got["slides.pptx"] == ("Title\none\ntwo\na\nb\nc\nd", None)
    assert got["broken.pptx"][0] is None and "BadZipFile" in got["broken.pptx"][1]
    assert got["test.pdf"] == (None, "unsupported document type: pdf")


def test_parsers_plug_in(spark, folder):
    def pdf(content: bytes) -> str:
        raise ValueError(f"{len(content)} bytes are no pdf")

    got = {r["name"]: r for r in X.extract(M.load_content(spark, folder), {"pdf": pdf, "md": bytes.decode}).collect()}
    assert got["test.pdf"]["error"] == "ValueError: 16 bytes are no pdf" and got["readme.md"]["text"] == "# no"


def test_json_text(spark):
    rows = [('{"text":"a"}',), ('{"other":1}',), ('{"text":null,"x":2}',), ('{"text":12.5}',), ('{"text":{"a":1}}',)]
    df = spark.createDataFrame(rows, "v string")
    assert [r[0] for r in df.select(X.text_of_json(F.col("v"))).collect()] == ["a", '{"other":1}', '{"text":null,"x":2}', "12.5", '{"a":1}']


def test_single_type_extractors(spark, folder):
    files = M.load_content(spark, folder)
    txt = {r["name"]: r["error"] for r in X.extract_txt(files.filter("name like '%.txt'")).collect()}
    assert txt == {"test.txt": None, "latin.txt": "not UTF-8"}
    js = {r["name"]: r["text"] for r in X.extract_json(files.filter("name like '%.json'")).collect()}
    assert js == {"test.json": "from json", "bad.json": None}


def test_api_docs(spark):
    whole = {"user_name": "u", "api_name": "n", "api_call": "c", "api_version": "1", "api_arguments": {"a": "b"}, "functionality": "f"}
    lacking = {k: v for k, v in whole.items() if k != "api_call"}
    df = spark.createDataFrame([("s", json.dumps([whole, lacking]))], "source string, content string")
    rows = sorted(X.extract_api_docs(df).collect(), key=lambda r: r["index"])
    assert [r["missing"] for r in rows] == [[], ["api_call"]]
    assert json.loads(rows[0]["content"]) == whole and rows[1]["metadata"] == {"type": "api", "index": "1"}
    with pytest.raises(Exception, match="API description lacks: api_call"):
        X.require_api_fields(X.extract_api_docs(df)).collect()
    good = spark.createDataFrame([("s", json.dumps([whole]))], "source string, content string")
    assert X.require_api_fields(X.extract_api_docs(good)).count() == 1


def test_incremental_run_retries_only_what_failed(spark, folder, tmp_path_factory):
    def work():
        return str(tmp_path_factory.mktemp("work") / "out")

    now = F.lit("2030-01-01").cast("timestamp")
    first = process_incremental(spark, folder, None, work(), now)
    state = {r["status"]: r["n"] for r in ledger_state(first.transitions).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert state == {"completed": 3, "failed": 3}
    assert {r["source"].rsplit("/", 1)[1] for r in first.chunks.collect()} == {"test.txt", "test.json", "slides.pptx"}
    second = process_incremental(spark, folder, first.transitions, work(), now)
    assert second.chunks.count() == 0 and second.transitions.filter("status = 'failed'").count() == 3
    # Once nothing is due, nothing is read; a new file is read alone, by its name.
    done = first.transitions.withColumn("status", F.regexp_replace("status", "failed", "completed"))
    assert process_incremental(spark, folder, done, work(), now).transitions.count() == 0
    with open(f"{folder}/fresh.txt", "w") as f:
        f.write("fresh")
    third = process_incremental(spark, folder, done, work(), now)
    assert [r["content"] for r in third.chunks.collect()] == ["fresh"]


def test_incremental_run_never_reads_what_it_excludes(spark, tmp_path):
    from vecweave.plans.retrieval import claim

    files = tmp_path / "files"
    files.mkdir()
    (files / "a.TXT").write_text("small")
    (files / "b.txt").write_text("x" * 5000)
    (files / "huge.bin").write_bytes(b"0" * 50_000)
    now = F.lit("2030-01-01").cast("timestamp")
    work = str(tmp_path / "work")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 2000)
    try:
        for _ in range(2):
            run = process_incremental(spark, str(files), None, work, now, max_size=1000)
            assert [r["content"] for r in run.chunks.collect()] == ["small"] and run.transitions.count() == 2
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    # A claim is in the log before the work; another instance then finds nothing due.
    due, claims = claim(spark, str(files), None, work, now, "one")
    assert due.count() == 2 and {r["status"] for r in claims.collect()} == {"processing"}
    claims.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert claim(spark, str(files), log, str(tmp_path / "other"), now, "two")[0].count() == 0
    done = process_incremental(spark, str(files), log, work, now, "one", due=spark.read.parquet(f"{work}/due"))
    assert {r["status"]: r["n"] for r in ledger_state(log.unionByName(done.transitions)).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()} == {"completed": 2}


def test_incremental_runs_list_inside_tasks(spark, tmp_path, monkeypatch):
    from pyspark.errors import AnalysisException

    from vecweave.plans.retrieval import claim
    from vecweave.sources.files import list_manifest

    files = tmp_path / "in"
    for place in ("a.txt", "_b.txt", "_c=1.txt", ".d.txt", "e.txt._COPYING_", "empty.txt", "sub/deep/f.txt", "_g/h.txt", "_i=1/j.txt", "sub/_k/l.txt", "sub/.m/n.txt", "o p=%/q é.txt"):
        (files / place).parent.mkdir(parents=True, exist_ok=True)
        (files / place).write_bytes(b"" if place == "empty.txt" else place.encode())
    os.utime(files / "a.txt", ns=(0, 1_700_000_000_123_456_789))
    listed = lambda df: sorted((r["source_path"], r["name"], r["size"], r["last_modified"], r["content_type"], sorted(r["metadata"].items())) for r in df.collect())
    # A folder in several spellings, a pattern and a single file.
    for path in (str(files), f"file://{files}/", f"{tmp_path}//in", f"{files}/sub/*", f"{files}/a.txt"):
        assert listed(list_manifest(spark, path)) == listed(M.scan_manifest(spark, path)), path
    assert len(listed(list_manifest(spark, str(files)))) == 5
    with pytest.raises(AnalysisException):
        list_manifest(spark, str(tmp_path / "nowhere"))

    def on_driver(*_):
        raise AssertionError("listed on the driver")

    monkeypatch.setattr(M, "_files", on_driver)
    due, _ = claim(spark, str(files), None, str(tmp_path / "work"), F.lit("2030-01-01").cast("timestamp"))
    assert due.count() == 5


def test_files_to_context_does_not_make_a_folder_for_each_document(spark, tmp_path, monkeypatch):
    from vecweave.catalogue import retrieval as Q

    texts = [(i, f"wort{i} other thing{i}\nline é {i}" * (1 + 40 * (i % 7 == 0))) for i in range(40)]
    spark.createDataFrame([*texts, (40, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, "wort3 thing3"), (9, "thing9")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(Q, "shared_dir", lambda _, purpose: str(tmp_path / purpose))
    got = {r["query_id"]: r["prompt"] for r in Q.files_to_context(spark, str(tmp_path)).collect()}
    files = {f.name: f.read_text() for f in (tmp_path / "text-files").glob("*/*.txt")}
    assert files == {f"doc_id={i}.txt": (t or "") + "\n" for i, t in [*texts, (40, None)]}
    assert len(list((tmp_path / "text-files").iterdir())) <= spark.sparkContext.defaultParallelism
    # The same prompts from chunks that never were files.
    chunks = [(i * 100000 + n, t[2000 * n : 2000 * n + 2000]) for i, t in ((i, (t or "") + "\n") for i, t in [*texts, (40, None)]) for n in range(-(-len(t) // 2000))]
    rows = spark.createDataFrame([(f"{i:020d}", c) for i, c in chunks], "id string, content string")
    want = Q.answer_prompts(Q.questions(spark, str(tmp_path)), Q.embed_hashing(rows, Q.DIM, text="content"), lambda d: Q.embed_hashing(d, Q.DIM), k=5)
    assert got == {r["query_id"]: r["prompt"] for r in want.select("query_id", F.md5("prompt").alias("prompt")).collect()}


def test_files_that_vanish_are_recorded_as_failed(spark, tmp_path):
    from vecweave.plans.retrieval import claim

    files = tmp_path / "files"
    files.mkdir()
    for name in ("stays.txt", "goes.txt"):
        (files / name).write_text(name)
    now = F.lit("2030-01-01").cast("timestamp")
    due, _ = claim(spark, str(files), None, str(tmp_path / "work"), now)
    os.remove(files / "goes.txt")
    run = process_incremental(spark, str(files), None, str(tmp_path / "work2"), now, due=due)
    ends = {r["error_message"] for r in run.transitions.filter("seq = 1").collect()}
    assert ends == {None, "missing: the file is no longer there"} and [r["content"] for r in run.chunks.collect()] == ["stays.txt"]


def test_read_files_tells_what_happened(spark, tmp_path):
    from vecweave.sources import files as FS

    for name, size in (("a.txt", 3), ("gone.txt", 3), ("folder.txt", 3), ("big.txt", 50), ("grows.txt", 3), ("empty.txt", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "sub" / "deep" / "b.txt").write_text("deep")
    (tmp_path / "_hidden").write_text("no")
    listed = FS.list_files(spark, str(tmp_path))
    rows = listed.collect()
    assert {r["name"]: r["size"] for r in rows} == {"a.txt": 3, "gone.txt": 3, "folder.txt": 3, "big.txt": 50, "grows.txt": 3, "empty.txt": 0, "b.txt": 4}
    same = {r["source_path"]: r["size"] for r in M.scan_manifest(spark, str(tmp_path)).collect()}
    assert same == {r["source_path"]: r["size"] for r in rows if r["size"]}
    manifest = spark.createDataFrame(rows, listed.schema)
    os.remove(tmp_path / "gone.txt")
    os.remove(tmp_path / "folder.txt")
    (tmp_path / "folder.txt").mkdir()
    (tmp_path / "grows.txt").write_bytes(b"x" * 60)
    got = {r["name"]: (r["state"], r["content"]) for r in FS.read_files(manifest, max_size=40).collect()}
    assert got == {
        "a.txt": ("read", b"xxx"), "gone.txt": ("missing", None), "folder.txt": ("unreadable", None), "big.txt": ("oversized", None),
        "grows.txt": ("oversized", None), "empty.txt": ("read", b""), "b.txt": ("read", b"deep"),
    }
    assert FS.read_files(manifest.limit(0)).count() == 0
    assert FS.list_files(spark, str(tmp_path / "nowhere")).count() == 0
    odd = spark.createDataFrame([("x", "nosuch://host/file", 1)], "name string, source_path string, size bigint")
    assert FS.read_files(odd).first()["state"] == "unreadable"


def test_incremental_run_through_spark_reader(spark, tmp_path):
    from vecweave.plans.retrieval import claim, read_with_spark

    files = tmp_path / "files"
    files.mkdir()
    for name in ("stays.txt", "goes.txt"):
        (files / name).write_text(name)
    now = F.lit("2030-01-01").cast("timestamp")
    due, _ = claim(spark, str(files), None, str(tmp_path / "work"), now)
    os.remove(files / "goes.txt")
    run = process_incremental(spark, str(files), None, str(tmp_path / "work2"), now, due=due, reader=read_with_spark(str(files)))
    assert {r["status"] for r in run.transitions.filter("seq = 1").collect()} == {"completed", "failed"}
    assert [r["content"] for r in run.chunks.collect()] == ["stays.txt"]


def test_listing_stream_remembers_one_offset(spark, tmp_path):
    import json

    from vecweave.sources import files as FS

    folder, state = tmp_path / "in", str(tmp_path / "state")
    (folder / "sub").mkdir(parents=True)

    def arrivals():
        out = str(tmp_path / "out")
        stream = FS.stream_listing(spark, str(folder), "*.txt", settle=0.0)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["name"] for r in spark.read.parquet(out).collect())

    for i in range(5):
        (folder / f"a{i}.txt").write_text("one")
    (folder / "other.bin").write_text("no")
    assert arrivals() == [f"a{i}.txt" for i in range(5)]
    for i in range(3):
        (folder / "sub" / f"b{i}.txt").write_text("two")
    want = [f"a{i}.txt" for i in range(5)] + [f"b{i}.txt" for i in range(3)]
    assert arrivals() == want and arrivals() == want
    (folder / "a1.txt").write_text("a new version")
    assert arrivals() == sorted(want + ["a1.txt"])
    offsets = [json.loads((tmp_path / "state" / "offsets" / n).read_text().splitlines()[-1]) for n in os.listdir(tmp_path / "state" / "offsets") if n.isdigit()]
    assert all(set(o) == {"time", "path"} for o in offsets)


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(600):
        os.makedirs(tmp_path / "in" / f"k={i}")
        (tmp_path / "in" / f"k={i}" / "a.txt").write_text("x" * (i % 7))
    listed = list_files(spark, str(tmp_path / "in"), "*.txt")
    assert listed.rdd.getNumPartitions() <= LISTING_TASKS
    assert sorted((r["source_path"].rsplit("/", 2)[1], r["size"]) for r in listed.collect()) == sorted((f"k={i}", i % 7) for i in range(600))


def test_page_files_share_folders_and_keep_every_row(spark, tmp_path):
    rows = [(i, f"<p>{i}</p>") for i in range(2500)] + [(7, "again"), (None, "no id"), (2600, None)]
    write_pages(spark.createDataFrame(rows, "page_id long, html string").repartition(1), str(tmp_path / "pages"))
    assert len(os.listdir(tmp_path / "pages")) == 3
    read = {}
    for folder, _, names in os.walk(tmp_path / "pages"):
        assert not any(n.startswith("_") for n in names)
        read |= {n: open(f"{folder}/{n}").read() for n in names}
    assert len(read) == 2502 and read["page_id=2600.txt"] == "\n" and read["page_id=None.txt"] == "no id\n"
    assert sorted(read["page_id=7.txt"].split()) == ["<p>7</p>", "again"] and read["page_id=8.txt"] == "<p>8</p>\n"


def test_presentations_are_parsed_in_pieces_of_few_bytes(spark, monkeypatch):
    assert list(X.pieces(pa.array([b"12", b"345", None, b"6", b""]), 3)) == [(0, 1), (1, 2), (3, 2)]
    assert list(X.pieces(pa.array([], pa.binary()), 3)) == [(0, 0)] and list(X.pieces(pa.array(["12345"]), 3)) == [(0, 1)]
    # Texts of over a megabyte, so a batch of all of them is several pieces.
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab <&> "), 200_000), F.col("id")).alias("text")).coalesce(1)
    made = X.extract_pptx(docs.select("doc_id", "text", F.lit("deck.pptx").alias("name"), _deck("text").alias("content")))
    wrong = made.join(docs.withColumnRenamed("text", "whole"), "doc_id").filter("text IS DISTINCT FROM whole OR error IS NOT NULL")
    assert made.count() == 12 and wrong.count() == 0
