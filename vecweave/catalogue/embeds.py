"""Making vectors from ``documents``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.catalog import MODELS, model_catalog
from vecweave.catalogue.base import DIM, documents, query, r, sql_hash_vectors
from vecweave.operators import embedding as E
from vecweave.operators.stats import embedding_stats

MOCK_DIM = 8
# The catalogue's demonstration provider refuses texts longer than this.
REFUSED_CHARS = 4000

SQL_WORDS = "len(regexp_extract_all(text, '\\S+'))"
SQL_PRICES = "prices(model, price, max_tokens) AS (VALUES " + ", ".join(
    f"('{name}', {'NULL' if price is None else repr(price / 1000)}::DOUBLE, {limit})" for name, _, _, limit, price, _ in MODELS
) + ")"


def sql_mock(cast: str) -> str:
    return f"""SELECT doc_id, i::INT AS pos,
       round((('0x' || substr(md5(md5(text) || ':' || i), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1.0::DOUBLE)::{cast}::DOUBLE, 6) + 0.0 AS x
FROM (SELECT doc_id, text, unnest(range({MOCK_DIM})) AS i FROM documents) d"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", r(F.col("x").cast("double")))


@query("mock_embedding", sql_mock("DOUBLE"))
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(E.embed_mock(documents(spark, sf_dir), MOCK_DIM))


@query(
    "hashing_embedding",
    f"""WITH {sql_hash_vectors('e', '(SELECT doc_id AS id, text FROM documents)')}
SELECT id AS doc_id, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v) / n, 6) + 0.0 AS x FROM e""",
)
def hashing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(E.embed_hashing(documents(spark, sf_dir), DIM))


@query("embed_provider", sql_mock("FLOAT"))
def embed_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider path: batches of 100 texts per call inside the tasks."""
    return _flat(E.embed_with(documents(spark, sf_dir).select("doc_id", "text"), "mock", "mock-8", dim=MOCK_DIM))


def _refusing_provider(model: str, limit: int) -> E.Embedder:
    def embed(texts: Sequence[str]) -> list[list[float]]:
        if any(len(t) > limit for t in texts):
            raise ValueError("text too long")
        return [[float(len(t))] for t in texts]

    return embed


E.register_provider("refusing", _refusing_provider)


@query(
    "embed_failures",
    f"""SELECT source, CASE WHEN length(text) > {REFUSED_CHARS} THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN length(text) > {REFUSED_CHARS} THEN 'text too long' END AS error, count(*) AS n,
       sum(CASE WHEN length(text) > {REFUSED_CHARS} THEN 0 ELSE length(text) END)::DOUBLE AS total
FROM documents GROUP BY 1, 2, 3""",
)
def embed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that fails whole batches: only the refused texts end as failed."""
    done = E.embed_with(documents(spark, sf_dir).select("source", "text"), "refusing", "r", 20, limit=REFUSED_CHARS)
    total = F.coalesce(F.sum(F.element_at("embedding", 1).cast("double")), F.lit(0.0))
    return done.groupBy("source", "status", "error").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@query(
    "embed_cache_hits",
    """WITH known AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE lang = 'en')
SELECT d.source, count(*) AS n, count(DISTINCT md5(d.text)) AS n_distinct,
       count(k) AS hits, count(*) AS n_vectors
FROM documents d LEFT JOIN known ON k = md5(d.text) GROUP BY 1""",
)
def embed_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the English texts are known; the rest are made once per distinct text."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    embed = lambda d: E.embed_mock(d, MOCK_DIM)
    cache = embed(docs.filter("lang = 'en'").select(F.md5("text").alias("text_key"), "text")).select("text_key", "embedding")
    done = E.embed_cached(docs, cache, embed, id_column="doc_id")
    return done.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("text_key").alias("n_distinct"),
        F.count(F.when(F.col("cache_hit"), 1)).alias("hits"),
        F.count("embedding").alias("n_vectors"),
    )


@query(
    "embed_cached_vectors",
    f"""WITH known AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE lang = 'en')
SELECT doc_id, k IS NOT NULL AS cache_hit, i::INT AS pos,
       round((('0x' || substr(md5(md5(text) || ':' || i), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1.0::DOUBLE)::DOUBLE, 6) + 0.0 AS x
FROM (SELECT doc_id, text, unnest(range({MOCK_DIM})) AS i FROM documents) d LEFT JOIN known ON k = md5(text)
UNION ALL SELECT -1, true, -1, (SELECT count(DISTINCT md5(text)) FROM documents)::DOUBLE""",
)
def embed_cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors themselves, and as last row the entries of the cache after the run."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    embed = lambda d: E.embed_mock(d, MOCK_DIM)
    cache = embed(docs.filter("lang = 'en'").select(F.md5("text").alias("text_key"), "text")).select("text_key", "embedding")
    done = E.embed_cached(docs, cache, embed, id_column="doc_id")
    flat = done.select("doc_id", "cache_hit", F.posexplode("embedding").alias("pos", "x")).withColumn("x", r(F.col("x").cast("double")))
    entries = cache.select("text_key").union(E.cache_entries(done).select("text_key")).agg(F.count_distinct("text_key").cast("double").alias("x"))
    return flat.unionByName(entries.select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit(True).alias("cache_hit"), F.lit(-1).alias("pos"), "x"))


# Bytes of text that one task sorts.
SORTED_BYTES = 64 << 20


def _counting_provider(model: str, limit: int) -> E.Embedder:
    def embed(texts: Sequence[str]) -> E.Embedded:
        if any(len(t) > limit for t in texts):
            raise ValueError("text too long")
        return E.Embedded([[float(len(t))] for t in texts], {"total_tokens": sum(len(t.encode()) for t in texts)})

    return embed


E.register_provider("counting", _counting_provider)


@query(
    "embed_accounting",
    f"""SELECT count(*) AS total_chunks, count(*) FILTER (length(text) <= {REFUSED_CHARS}) AS embedded_chunks,
       count(*) FILTER (length(text) > {REFUSED_CHARS}) AS failed_chunks,
       sum(CASE WHEN length(text) <= {REFUSED_CHARS} THEN octet_length(encode(text)) ELSE 0 END)::BIGINT AS total_tokens,
       round(count(*) FILTER (length(text) <= {REFUSED_CHARS}) / count(*) * 100, 6) AS success_rate,
       true AS has_time, 50 AS largest_call, count(*) FILTER (length(text) <= {REFUSED_CHARS}) AS n_vectors
FROM documents""",
)
def embed_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results table that embedding leaves: tokens as the provider reports them, calls within the model's largest batch."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # Short texts come first, so the first calls of a partition are full ones. A partition is sorted whole, so it has a bounded size.
    tasks = max(2, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SORTED_BYTES))
    docs = docs.repartition(tasks, "doc_id").sortWithinPartitions(F.length("text"))
    vectors, calls = E.embed_accounted(docs, "counting", "llamacpp/default", 1000, limit=REFUSED_CHARS)
    totals = embedding_stats(calls).select("total_chunks", "embedded_chunks", "failed_chunks", "total_tokens", r("success_rate").alias("success_rate"), (F.col("total_processing_time") > 0).alias("has_time"))
    largest = calls.agg(F.max("n_embedded").alias("largest_call"))
    made = vectors.agg(F.count("embedding").alias("n_vectors"))
    wide = totals.unionByName(largest, True).unionByName(made, True)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])


@query(
    "plan_batches",
    f"""WITH b AS (
  SELECT doc_id, {SQL_WORDS} AS words, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 8 AS bucket FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS rn FROM b)
SELECT bucket || '-' || (rn // 20) AS batch_id, 'text-embedding-3-small' AS model, count(*)::INT AS n_chunks,
       floor(sum(words) * 1.3::DOUBLE)::BIGINT AS est_tokens, 'pending' AS status
FROM n GROUP BY 1""",
)
def plan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = E.plan_batches(documents(spark, sf_dir), 20, id_column="doc_id", buckets=8)
    return plan.select("batch_id", "model", "n_chunks", "est_tokens", "status")


_MODEL_OF = "CASE WHEN doc_id % 3 = 0 THEN 'cohere.embed-english-v3' WHEN doc_id % 3 = 1 THEN 'text-embedding-004' ELSE 'my-deployment' END"


@query(
    "input_validation",
    f"""WITH {SQL_PRICES},
v AS (SELECT doc_id, {_MODEL_OF} AS model, floor({SQL_WORDS} * 1.3::DOUBLE)::BIGINT AS est_tokens, text FROM documents)
SELECT doc_id, v.model, est_tokens, text IS NULL AS is_null, NOT regexp_matches(text, '\\S') AS is_blank,
       est_tokens > coalesce(max_tokens, 8192) AS too_long,
       text IS NOT NULL AND regexp_matches(text, '\\S') AND est_tokens <= coalesce(max_tokens, 8192) AS valid
FROM v LEFT JOIN prices p ON p.model = v.model""",
)
def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text", F.expr(_MODEL_OF).alias("model"))
    return E.validate_inputs(rows).select("doc_id", "model", "est_tokens", "is_null", "is_blank", "too_long", "valid")


@query(
    "token_cost",
    f"""WITH {SQL_PRICES},
w AS (SELECT source, model, {SQL_WORDS} AS words
      FROM documents, (SELECT model FROM prices UNION ALL SELECT 'my-deployment') m),
t AS (SELECT model, source, count(*) AS n_texts, floor(sum(words) * 1.3::DOUBLE)::BIGINT AS tokens FROM w GROUP BY 1, 2)
SELECT t.model, source, n_texts, tokens, round(tokens * coalesce(price, 0.0), 9) AS cost
FROM t LEFT JOIN prices p ON p.model = t.model""",
)
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents of each source would cost with each known model, and with an unknown one."""
    names = [m[0] for m in MODELS] + ["my-deployment"]
    docs = documents(spark, sf_dir).select("source", E.word_count(F.col("text")).alias("words"))
    # Words are summed per source first; the models multiply one row per source.
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("words").alias("words"))
    priced = sums.withColumn("model", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn(
        "tokens", E.estimated_tokens(F.col("words"))
    )
    return E.with_cost(priced, model_catalog(spark)).select(
        "model", "source", "n_texts", "tokens", F.round("cost", 9).alias("cost")
    )


@query(
    "embedding_usage",
    f"""WITH {SQL_PRICES},
t AS (SELECT {_MODEL_OF.replace('text-embedding-004', 'text-embedding-3-large')} AS model, lang, count(*) AS n_texts,
             floor(sum({SQL_WORDS}) * 1.3::DOUBLE)::BIGINT AS tokens FROM documents GROUP BY 1, 2)
SELECT t.model, lang, n_texts, tokens, round(tokens * coalesce(price, 0.0), 9) AS cost
FROM t LEFT JOIN prices p ON p.model = t.model""",
)
def embedding_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.expr(_MODEL_OF.replace("text-embedding-004", "text-embedding-3-large"))
    rows = documents(spark, sf_dir).select("text", "lang", model.alias("model"))
    return E.embedding_usage(rows, ["lang"]).withColumn("cost", F.round("cost", 9))
