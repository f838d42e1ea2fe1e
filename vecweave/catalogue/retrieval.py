"""Retrieval over ``documents`` with the ``benchmark`` texts as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.catalogue.base import DIM, documents, query, r, sql_hash_vectors, table
from vecweave.catalogue.chunks import SIZE, SQL_FIXED
from vecweave.catalogue.files import write_files
from vecweave.operators.buckets import BucketedVectors
from vecweave.operators.chunking import chunk_fixed
from vecweave.operators.embedding import embed_hashing
from vecweave.operators.prompts import history_window, render_prompt
from vecweave.operators.search import expanded_context, hybrid_search, search
from vecweave.plans.retrieval import answer_prompts, process_incremental
from vecweave.session import shared_dir

# Fixed values of the example queries.
KEYWORDS = ["the", "une", "der"]
TEMPLATE = (
    "Embed this {document_type} chunk {chunk_index} of {domain} text, cut by {chunking_strategy}.\n"
    "Metadata: {metadata}\nContent: {content}\n"
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).withColumnRenamed("question", "text")
    return embed_hashing(asked, DIM).select("query_id", "embedding")


def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))
    return embed_hashing(docs, DIM, text="content")


SQL_HITS = f"""WITH {sql_hash_vectors('q', '(SELECT item_id AS id, text FROM benchmark)')},
{sql_hash_vectors('d', '(SELECT doc_id AS id, text FROM documents)')},
ranked AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.id AS query_id, d.id, list_inner_product(q.v, d.v) / (q.n * d.n) AS score FROM q, d) x)
"""


@query(
    "document_search",
    SQL_HITS
    + """SELECT query_id, rank::INT AS rank, id, round(score, 6) + 0.0 AS similarity_score FROM ranked WHERE rank <= 10""",
)
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = document_store(spark, sf_dir).select("id", "embedding")
    found = search(queries(spark, sf_dir), store, 10)
    return found.select("query_id", "rank", "id", r("similarity_score").alias("similarity_score"))


@query(
    "hybrid_search",
    SQL_HITS
    + f""", kept AS (
  SELECT r.query_id, r.rank, r.id, r.score FROM ranked r JOIN documents d ON d.doc_id = r.id
  WHERE r.rank <= 20 AND ({' OR '.join(f"contains(lower(d.text), '{w} ')" for w in KEYWORDS)}))
SELECT query_id, rank::INT AS rank, id, similarity_score FROM (
  SELECT query_id, id, round(score, 6) + 0.0 AS similarity_score,
         row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM kept) x
WHERE rank <= 10""",
)
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = document_store(spark, sf_dir).select("id", "content", "embedding")
    found = hybrid_search(queries(spark, sf_dir), store, [f"{w} " for w in KEYWORDS])
    return found.select("query_id", "rank", "id", r("similarity_score").alias("similarity_score"))


@query(
    "rag_context",
    SQL_HITS
    + """, c AS (
  SELECT r.query_id, string_agg(d.text, chr(10) || chr(10) ORDER BY r.rank) AS context
  FROM ranked r JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 5 GROUP BY 1)
SELECT b.item_id AS query_id, length(coalesce(context, ''))::INT AS context_chars,
       md5('Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || 'Answer:') AS prompt
FROM benchmark b LEFT JOIN c ON c.query_id = b.item_id""",
)
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question text to prompt: embed, search, assemble."""
    store = document_store(spark, sf_dir).select("id", "content", "embedding")
    made = answer_prompts(questions(spark, sf_dir), store, lambda d: embed_hashing(d, DIM), k=5)
    return made.select("query_id", F.length("context").alias("context_chars"), F.md5("prompt").alias("prompt"))


@query(
    "neighbor_context",
    f"""WITH {SQL_FIXED},
keyed AS (SELECT doc_id * 100000 + chunk_index AS id, doc_id, chunk_index, content AS text FROM fixed),
{sql_hash_vectors('q', '(SELECT item_id AS id, text FROM benchmark)')},
{sql_hash_vectors('d', '(SELECT id, text FROM keyed)')},
ranked AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.id AS query_id, d.id, list_inner_product(q.v, d.v) / (q.n * d.n) AS score FROM q, d) x),
blocks AS (
  SELECT r.query_id, r.rank, string_agg(n.text, chr(10) ORDER BY n.chunk_index) AS block
  FROM ranked r JOIN keyed h ON h.id = r.id
  JOIN keyed n ON n.doc_id = h.doc_id AND n.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2
  WHERE r.rank <= 5 GROUP BY 1, 2)
SELECT query_id, sum(length(block))::BIGINT AS block_chars,
       md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context
FROM blocks GROUP BY 1""",
)
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks, each with two chunks on either side of it in its document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chunks = chunk_fixed(docs, SIZE).select(
        (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("id"),
        F.col("doc_id").alias("source"),
        "chunk_index",
        "content",
    )
    store = embed_hashing(chunks, DIM, text="content").select("id", "source", "chunk_index", "embedding")
    context = expanded_context(search(queries(spark, sf_dir), store, 5), chunks, n=2)
    seps = (F.size(F.split("context", "\n\n---\n\n")) - 1) * 7
    return context.select(
        "query_id", (F.length("context") - seps).cast("bigint").alias("block_chars"), F.md5("context").alias("context")
    )


SQL_HISTORY = """SELECT conv_id, turn, md5(coalesce(string_agg(role || ': ' || text, chr(10)) OVER (
         PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '')) AS history
FROM conversations"""


@query("history_window_blocks", SQL_HISTORY)
def history_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every conversation treated as endless and cut into blocks of five turns."""
    told = history_window(table(spark, sf_dir, "conversations"), 4, width=5, max_rows=1)
    return told.select("conv_id", "turn", F.md5("history").alias("history"))


@query("history_window", SQL_HISTORY)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = history_window(table(spark, sf_dir, "conversations"), 4)
    return told.select("conv_id", "turn", F.md5("history").alias("history"))


@query(
    "prompt_render",
    f"""WITH {SQL_FIXED}
SELECT doc_id, chunk_index::INT AS chunk_index, md5(
  'Embed this txt chunk ' || chunk_index || ' of legal text, cut by fixed.' || chr(10) ||
  'Metadata: {{"chunk_index":"' || chunk_index || '","chunking_strategy":"fixed","type":"txt"}}' || chr(10) ||
  'Content: ' || content || chr(10)) AS prompt
FROM fixed""",
)
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_fixed(documents(spark, sf_dir).select("doc_id", "text"), SIZE).withColumn(
        "metadata",
        F.create_map(
            F.lit("type"), F.lit("txt"),
            F.lit("chunking_strategy"), F.lit("fixed"),
            F.lit("chunk_index"), F.col("chunk_index").cast("string"),
        ),
    )
    done = render_prompt(chunks, TEMPLATE, {"domain": "legal"})
    return done.select("doc_id", "chunk_index", F.md5("prompt").alias("prompt"))


@query(
    "files_to_context",
    f"""WITH f AS (SELECT doc_id, text || chr(10) AS t FROM documents),
c AS (SELECT doc_id, i, substr(t, i * 2000 + 1, 2000) AS content FROM (SELECT doc_id, t, unnest(range((length(t) + 1999) // 2000)) AS i FROM f)),
keyed AS (SELECT doc_id * 100000 + i AS id, content AS text FROM c),
{sql_hash_vectors('q', '(SELECT item_id AS id, text FROM benchmark)')},
{sql_hash_vectors('d', 'keyed')},
ranked AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.id AS query_id, d.id, list_inner_product(q.v, d.v) / (q.n * d.n) AS score FROM q, d) x),
best AS (
  SELECT r.query_id, string_agg(k.text, chr(10) || chr(10) ORDER BY r.rank) AS context FROM ranked r JOIN keyed k USING (id) WHERE r.rank <= 5 GROUP BY 1)
SELECT b.item_id AS query_id, length(coalesce(context, ''))::INT AS context_chars,
       md5('Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || 'Answer:') AS prompt
FROM benchmark b LEFT JOIN best ON best.query_id = b.item_id""",
)
def files_to_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to prompts: list, read, extract and chunk what the ledger says is due, embed, store by bucket, search, assemble."""
    path, now = shared_dir(spark, "text-files"), F.lit("2024-02-01").cast("timestamp")
    write_files(documents(spark, sf_dir).select("doc_id", "text"), path)
    run = process_incremental(spark, path, None, shared_dir(spark, "extracted"), now, size=2000)
    doc = F.regexp_extract("source", r"doc_id=(\d+)", 1).cast("bigint")
    chunks = run.chunks.withColumn("id", F.format_string("%020d", doc * 100000 + F.col("chunk_index")))
    store = BucketedVectors(spark, shared_dir(spark, "vectors"), 16)
    store.upsert(embed_hashing(chunks, DIM, text="content"))
    made = answer_prompts(questions(spark, sf_dir), store.read(), lambda d: embed_hashing(d, DIM), k=5)
    return made.select("query_id", F.length("context").alias("context_chars"), F.md5("prompt").alias("prompt"))
