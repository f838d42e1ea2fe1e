"""Operators put together: incremental processing and question answering over a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.operators.chunking import build_chunks, chunk
from vecweave.operators.ledger import claim_transitions, fingerprint, ledger_state, outcome_transitions, pending
from vecweave.operators.prompts import QUESTION_PROMPT, assemble_context
from vecweave.operators.search import fetch, search
from vecweave.sources.extract import Parser, extract
from vecweave.sources.files import MISSING, READ, list_manifest, read_files
from vecweave.sources.manifest import MAX_FILE_SIZE, extension, filter_manifest, load_content



def answer_prompts(
    questions: DataFrame,
    store: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    k: int = 5,
    template: str = QUESTION_PROMPT,
    **options: object,
) -> DataFrame:
    """Questions (``query_id, question``) to prompts with the k best contents as context."""
    queries = embed(questions.select("query_id", F.col("question").alias("text"))).select("query_id", "embedding")
    hits = fetch(search(queries, store.select("id", "embedding"), k, **options), store.select("id", "content", "embedding"))
    return assemble_context(hits, questions, template=template)


def read_with_spark(root: str) -> Callable[[DataFrame, int], DataFrame]:
    """A reader of the files under ``root`` through Spark's own file source: any Hadoop path, one scan of the whole
    folder, and no reason for a file that gives no bytes."""

    def read(manifest: DataFrame, max_size: int) -> DataFrame:
        spark = manifest.sparkSession
        spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
        files = load_content(spark, root, wanted=manifest, max_size=max_size).select("source_path", "content")
        state = F.when(F.col("content").isNull(), MISSING).otherwise(READ)
        return manifest.join(files, "source_path", "left").withColumn("state", state).withColumn("read_error", F.when(F.col("content").isNull(), "the file gave no bytes"))

    return read


@dataclass
class Processed:
    """What one incremental run makes: chunks, and ledger transitions to append."""

    chunks: DataFrame
    transitions: DataFrame


def claim(
    spark: SparkSession,
    path: str,
    transitions: DataFrame | None,
    work_dir: str,
    now: Column,
    instance: str = "spark",
    types: tuple[str, ...] = ("txt", "json", "pptx"),
    max_size: int = MAX_FILE_SIZE,
) -> tuple[DataFrame, DataFrame]:
    """The files this instance may process now, and the transitions that claim them.

    Append the claims to the log before the work starts, so that other instances leave the files
    alone. The list is written once, to ``due`` in ``work_dir``; a run again replaces it.
    """
    manifest = filter_manifest(list_manifest(spark, path), types=types, max_size=max_size)
    manifest = manifest.withColumn(
        "fingerprint", fingerprint(F.col("source_path"), F.col("last_modified"), F.col("size"))
    )
    if transitions is None:
        due = manifest.withColumn("seq", F.lit(0).cast("bigint"))
    else:
        due = pending(manifest, ledger_state(transitions), now, instance)
        # New transitions of a file follow its old ones, also where the clock stands still.
        last = transitions.groupBy("fingerprint").agg((F.max("seq") + 1).alias("seq"))
        due = due.join(last, "fingerprint", "left").withColumn("seq", F.coalesce("seq", F.lit(0)))
    due.write.mode("overwrite").parquet(f"{work_dir}/due")
    due = spark.read.parquet(f"{work_dir}/due")
    return due, claim_transitions(due, instance, now, F.col("seq"))


def _extract_due(due, work_dir, max_size, parsers, reader) -> DataFrame:
    """The due files' texts and errors, in one folder that a run again replaces. No other file is opened."""
    own = ["fingerprint", "seq"]
    files = reader(due.select("source_path", "name", "size", *own), max_size)
    folder = f"{work_dir}/texts"
    made = extract(files, parsers)
    unread = F.col("state") != READ
    text, error = F.when(~unread, F.col("text")), F.when(unread, F.concat_ws(": ", "state", "read_error")).otherwise(F.col("error"))
    carried = [c for c in own if c in made.columns]
    made.select("source_path", "name", "size", *carried, text.alias("text"), error.alias("error")).write.mode("overwrite").parquet(folder)
    texts = due.sparkSession.read.parquet(folder)
    # Texts are shuffled to their files only where the reader gave back no more than the columns it knows.
    return texts if carried == own else texts.drop(*own).join(due.select("source_path", *own), "source_path")


def process_incremental(
    spark: SparkSession,
    path: str,
    transitions: DataFrame | None,
    work_dir: str,
    now: Column,
    instance: str = "spark",
    strategy: str = "fixed",
    size: int = 512,
    types: tuple[str, ...] = ("txt", "json", "pptx"),
    parsers: dict[str, Parser] | None = None,
    max_size: int = MAX_FILE_SIZE,
    due: DataFrame | None = None,
    reader: Callable[[DataFrame, int], DataFrame] = read_files,
) -> Processed:
    """Extract and chunk the files the ledger says are pending.

    A file that is gone, cannot be read, has grown beyond ``max_size`` or cannot be parsed is
    recorded as failed with its reason and the others go on; only due files are opened. ``reader``
    gives their bytes (``read_with_spark`` for paths that only Spark opens). ``due`` is the list of an earlier
    ``claim``; without it the run claims for itself. The extracted text is written once to
    ``work_dir`` (a folder of this run that all executors see), and both results read it, so no
    file is parsed twice and a lost executor costs a re-read. The same call again replaces it.
    """
    if due is None:
        due, _ = claim(spark, path, transitions, work_dir, now, instance, types, max_size)
    extracted = _extract_due(due, work_dir, max_size, parsers, reader)
    good = extracted.filter(F.col("error").isNull()).select(
        F.col("source_path").alias("source"), "text", "size", extension(F.col("name")).alias("doc_type")
    )
    chunks = build_chunks(
        chunk(good, strategy, size), strategy, F.col("doc_type"), file_size=F.col("size"), created_at=now.cast("timestamp")
    ).drop("size", "doc_type")
    return Processed(chunks, outcome_transitions(extracted.select("fingerprint", "seq", "error"), instance, now, now))
