"""The vector dataset, filled from ``documents`` with mock vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecweave.catalogue.base import documents, query, r, table
from vecweave.operators import store as S
from vecweave.operators.buckets import BucketedVectors
from vecweave.operators.embedding import embed_mock
from vecweave.session import shared_dir, stored

DIM = 8

SQL_ROUNDTRIP = """SELECT doc_id::VARCHAR AS id, md5(text) AS digest, source, lang, doc_id + 1704067200 AS created,
       CASE WHEN doc_id % 10 <> 9 THEN 8 END AS dims FROM documents"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document; every tenth has no vector."""
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("content"),
        "source",
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("created_at"),
        "lang",
        "doc_id",
    )
    made = embed_mock(docs, DIM, text="content")
    return made.withColumn("embedding", F.when(F.col("doc_id") % 10 != 9, F.col("embedding"))).withColumn(
        "embedding_model", F.lit("mock-8")
    ).withColumn("vector_id", F.lit(None).cast("string"))


def new_store(spark: SparkSession) -> S.VectorStore:
    return S.VectorStore(spark, shared_dir(spark, "store"))


@query(
    "store_append",
    """SELECT id, count(*) AS copies, min(source) AS source, min(md5(text)) AS digest, min(model) AS embedding_model
FROM (SELECT doc_id::VARCHAR AS id, source, text, 'mock-8' AS model FROM documents WHERE doc_id % 10 <> 9
      UNION ALL SELECT doc_id::VARCHAR, source, text, 'mock-8' FROM documents WHERE doc_id % 10 <> 9 AND lang = 'en') x
GROUP BY 1""",
)
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, then the English ones again: appending keeps both copies and skips rows without a vector."""
    store, rows = new_store(spark), chunks(spark, sf_dir).drop("doc_id")
    store.append(rows)
    store.append(rows.filter("lang = 'en'"))
    return store.read().groupBy("id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("source").alias("source"),
        F.min(F.md5("content")).alias("digest"),
        F.min("embedding_model").alias("embedding_model"),
    )


@query(
    "store_upsert",
    """SELECT doc_id::VARCHAR AS id, md5(CASE WHEN lang = 'en' THEN text ELSE 'v2 ' || text END) AS digest,
       CASE WHEN lang = 'en' THEN source ELSE 'rev-2' END AS source
FROM documents WHERE doc_id % 10 <> 9
UNION ALL SELECT 'new-' || doc_id, md5('v2 ' || text), 'rev-2' FROM documents WHERE doc_id % 10 <> 9 AND lang <> 'en'""",
)
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions of the other languages' chunks and as many new ids: the later revision wins."""
    store, rows = new_store(spark), chunks(spark, sf_dir).drop("doc_id")
    store.upsert(rows)
    changed = rows.filter("lang <> 'en'")
    named = changed.withColumn("id", F.explode(F.array(F.col("id"), F.concat(F.lit("new-"), F.col("id")))))
    revised = named.withColumn("rev", F.explode(F.array(F.lit(2), F.lit(1))))
    incoming = revised.withColumn("content", F.concat(F.lit("v"), F.col("rev"), F.lit(" "), F.col("content"))).withColumn(
        "source", F.concat(F.lit("rev-"), F.col("rev"))
    )
    store.upsert(incoming, order=[F.col("rev")])
    return store.read().select("id", F.md5("content").alias("digest"), "source")


@query(
    "store_delete",
    """SELECT doc_id::VARCHAR AS id, true AS deleted_any FROM documents d
WHERE doc_id % 10 <> 9 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""",
)
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete the documents labelled toxic."""
    store = new_store(spark)
    store.append(chunks(spark, sf_dir))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    deleted = store.delete(toxic)
    return store.read().select("id", F.lit(deleted).alias("deleted_any"))


@query(
    "store_stats",
    """SELECT count(*) AS document_count, 8 AS dimension, min(doc_id) + 1704067200 AS earliest, max(doc_id) + 1704067200 AS latest,
       true AS has_bytes FROM documents WHERE doc_id % 10 <> 9""",
)
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    store.append(chunks(spark, sf_dir))
    return store.stats().select(
        "document_count",
        "dimension",
        F.unix_seconds("earliest").alias("earliest"),
        F.unix_seconds("latest").alias("latest"),
        (F.col("size_bytes") > 0).alias("has_bytes"),
    )


SQL_MOCK_OF = """(('0x' || substr(md5(md5(content) || ':' || i), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1.0::DOUBLE)::FLOAT::DOUBLE"""


def _with_vectors(rows: DataFrame) -> DataFrame:
    flat = rows.select("id", F.md5("content").alias("digest"), "source", F.unix_seconds("created_at").alias("created"), F.posexplode("embedding").alias("pos", "x"))
    return flat.withColumn("x", r(F.col("x").cast("double")))


@query(
    "bucket_upsert",
    f"""WITH u AS (
  SELECT doc_id::VARCHAR AS id, CASE WHEN lang = 'en' THEN text ELSE 'v2 ' || text END AS content, CASE WHEN lang = 'en' THEN source ELSE 'rev-2' END AS source,
         doc_id + 1704067200 AS created FROM documents WHERE doc_id % 10 <> 9
  UNION ALL SELECT 'new-' || doc_id, 'v2 ' || text, 'rev-2', doc_id + 1704067200 FROM documents WHERE doc_id % 10 <> 9 AND lang <> 'en')
SELECT id, md5(content) AS digest, source, created, i::INT AS pos, round({SQL_MOCK_OF}, 6) + 0.0 AS x FROM u, (SELECT unnest(range({DIM})) AS i)""",
)
def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``store_upsert``, in hash buckets; vectors and times are compared too."""
    store, rows = BucketedVectors(spark, shared_dir(spark, "buckets"), 16), chunks(spark, sf_dir).drop("doc_id")
    store.upsert(rows)
    changed = rows.filter("lang <> 'en'")
    named = changed.withColumn("id", F.explode(F.array(F.col("id"), F.concat(F.lit("new-"), F.col("id")))))
    revised = named.withColumn("rev", F.explode(F.array(F.lit(2), F.lit(1)))).filter("embedding IS NOT NULL")
    texts = revised.withColumn("content", F.concat(F.lit("v"), F.col("rev"), F.lit(" "), F.col("content"))).withColumn("source", F.concat(F.lit("rev-"), F.col("rev")))
    store.upsert(embed_mock(texts, DIM, text="content"), order=[F.col("rev")])
    return _with_vectors(store.read())


@query(
    "bucket_delete",
    f"""SELECT doc_id::VARCHAR AS id, md5(content) AS digest, source, doc_id + 1704067200 AS created, i::INT AS pos, round({SQL_MOCK_OF}, 6) + 0.0 AS x
FROM (SELECT *, text AS content FROM documents) d, (SELECT unnest(range({DIM})) AS i)
WHERE doc_id % 10 <> 9 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""",
)
def bucket_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete the documents labelled toxic from hash buckets."""
    store = BucketedVectors(spark, shared_dir(spark, "buckets"), 16)
    store.append(chunks(spark, sf_dir).drop("doc_id"))
    store.delete(table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id")))
    return _with_vectors(store.read())


@query(
    "bucket_stats",
    """SELECT count(*) AS document_count, 8 AS dimension, min(doc_id) + 1704067200 AS earliest, max(doc_id) + 1704067200 AS latest FROM documents WHERE doc_id % 10 <> 9""",
)
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = BucketedVectors(spark, shared_dir(spark, "buckets"), 16)
    store.append(chunks(spark, sf_dir))
    return store.stats().select("document_count", "dimension", F.unix_seconds("earliest").alias("earliest"), F.unix_seconds("latest").alias("latest"))


@query(
    "created_order",
    """SELECT row_number() OVER (ORDER BY created DESC, id)::BIGINT AS place, id, created
FROM (SELECT doc_id::VARCHAR AS id, doc_id % 97 + 1704067200 AS created FROM documents)""",
)
def created_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by time, newest first; places are counted from the partitions of the sort."""
    rows = chunks(spark, sf_dir).select("id", F.timestamp_seconds(F.col("doc_id") % 97 + 1704067200).alias("created_at"))
    ordered = stored(S.by_time(rows).withColumn("n", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("n", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    # One row per partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    placed = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    place = F.col("start") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(place.cast("bigint").alias("place"), "id", F.unix_seconds("created_at").alias("created"))


@query("export_parquet", SQL_ROUNDTRIP)
def export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "export")
    S.export(chunks(spark, sf_dir).drop("doc_id", "lang"), path, "parquet")
    return _roundtrip(spark.read.parquet(path))


@query(
    "facets",
    """SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2""",
)
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.facets(table(spark, sf_dir, "documents").select("source", "lang"), ["source", "lang"])


@query(
    "vector_ids",
    """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 10 <> 9 THEN 'vec_' || doc_id END AS vector_id FROM documents""",
)
def vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assign_vector_ids(chunks(spark, sf_dir)).select("id", "vector_id")


def _roundtrip(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.md5("content").alias("digest"),
        "source",
        F.element_at("metadata", F.lit("lang")).alias("lang"),
        F.unix_seconds("created_at").alias("created"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"),
    )


@query("jsonl_roundtrip", SQL_ROUNDTRIP)
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(S.from_records(S.to_records(chunks(spark, sf_dir).drop("doc_id", "lang"))))


@query("export_jsonl", SQL_ROUNDTRIP)
def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "export")
    S.export(S.to_records(chunks(spark, sf_dir).drop("doc_id", "lang")), path, "jsonl")
    return _roundtrip(S.from_records(spark.read.schema("record string").json(path)))
