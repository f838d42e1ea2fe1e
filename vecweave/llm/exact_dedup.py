"""Exact deduplication through recipes of content-defined chunks. DataFrame functions only.

A text, white space normalised, is cut where its content says so: after at least ``MIN_CHUNK``
characters at the next full stop, question mark, line start or the like, at the latest after
``MAX_CHUNK``. A document's recipe is its ordered list of chunk identifiers; equal texts have
equal recipes. The chunk texts travel once, as distinct rows, to verify the identifiers: an
identifier that turns out to stand for two chunks is replaced by the chunk's own text. From
then on only recipes travel, never documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecweave.session import shared_dir

MIN_CHUNK, MAX_CHUNK = 512, 4096
# A cut follows one of these: it depends on the text around it only.
CUT = "[.!?;:|]"
_CHUNK = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?(?:{CUT}|\\z)|.{{1,{MAX_CHUNK}}}"
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
KEY = ["recipe", "spelled"]


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def chunks(text: Column) -> Column:
    """The chunks of a text in order; concatenated they are the text."""
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def _texts(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("t"))


def ambiguous(texts: DataFrame, identifier=F.xxhash64) -> DataFrame:
    """Identifiers (``h``) that stand for more than one chunk text; normally none.

    Each distinct chunk is moved once; copies meet before the shuffle.
    """
    pieces = texts.select(F.explode(chunks(F.col("t"))).alias("c")).select(identifier("c").alias("h"), "c")
    return pieces.groupBy("h", "c").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def recipes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", identifier=F.xxhash64) -> DataFrame:
    """``doc_id, sha, recipe, spelled``: equal texts, and only they, agree in the last two.

    ``recipe`` is the list of chunk identifiers. ``spelled`` is null but for documents with an
    ambiguous identifier, where it lists those chunks themselves with their places.
    """
    texts = _texts(docs, text, id_col)
    rows = texts.select("doc_id", F.sha2("t", 256).alias("sha"), F.transform(chunks(F.col("t")), lambda c: identifier(c)).alias("recipe"))
    doubtful = ambiguous(texts, identifier)
    path = shared_dir(docs.sparkSession, "ambiguous")
    doubtful.write.parquet(path)
    doubtful = docs.sparkSession.read.parquet(path)
    kind = "array<struct<i:int,c:string>>"
    if doubtful.isEmpty():
        return rows.withColumn("spelled", F.lit(None).cast(kind))
    placed = texts.select("doc_id", F.sha2("t", 256).alias("sha"), F.posexplode(chunks(F.col("t"))).alias("i", "c"))
    spelled = (
        placed.withColumn("h", identifier("c"))
        .join(doubtful, "h")
        .distinct()
        .groupBy(F.col("doc_id").alias("_d"), F.col("sha").alias("_s"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("spelled"))
    )
    same = (F.col("sha") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return rows.join(spelled, same, "left").select("doc_id", "sha", "recipe", F.col("spelled").cast(kind))


def groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", identifier=F.xxhash64) -> DataFrame:
    """One row per distinct (doc_id, text): ``doc_id, keep_id, group_size, copies, text_sha256``.

    Rows are counted before they meet, so a text that a third of all rows share is one row per
    task; documents then find their group by a join that adaptive execution may split.
    """
    each = recipes(docs, text, id_col, identifier).groupBy("doc_id", "sha", *KEY).agg(F.count("*").alias("copies"))
    whole = each.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    a, b = each.alias("a"), whole.alias("b")
    on = (F.col("a.recipe") == F.col("b.recipe")) & F.col("a.spelled").eqNullSafe(F.col("b.spelled"))
    return a.join(b, on).select("a.doc_id", "b.keep_id", "b.group_size", "a.copies", F.col("a.sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the smallest doc_id stays. Of rows repeated with that doc_id
    one stays. Null doc_ids come after all others: such a row stays only if its group has no
    doc_id, and then one does, with a null keep_id. A null text is an empty one. Other columns
    are not read; an empty table gives no rows.
    """
    rows = groups(docs, text, id_col).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; names of other columns do not matter."""
    spark = docs.sparkSession
    path = shared_dir(spark, "groups")
    groups(docs, text, id_col).write.parquet(path)
    found = spark.read.parquet(path)
    names = docs.columns
    lower = [c.lower() for c in names]
    i, t = lower.index(id_col.lower()), lower.index(text.lower())
    plain = docs.toDF(*[f"_c{k}" for k in range(len(names))]).withColumn("_sha", F.sha2(normalised(F.col(f"_c{t}")), 256))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    same = (F.col("_sha") == F.col("text_sha256")) & F.col(f"_c{i}").eqNullSafe(F.col("doc_id"))
    gone = found.filter(~stays).select("doc_id", "text_sha256")
    rest = plain.join(gone, same, "left_anti")
    twice = found.filter(stays & (F.col("copies") > 1)).select("doc_id", "text_sha256")
    if not twice.isEmpty():
        once = rest.join(twice, same, "left_semi").dropDuplicates([f"_c{i}", "_sha"])
        rest = rest.join(twice, same, "left_anti").unionByName(once)
    return rest.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(names)])
