"""Chunking of ``documents``, each chunk shown by its length and digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.catalogue.base import DIM, documents, query, r
from vecweave.operators import chunking as C

SIZE = 512


def shown(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


SQL_SHOWN = "SELECT doc_id, chunk_index::INT AS chunk_index, length(content)::INT AS n_chars, md5(content) AS digest"

SQL_FIXED = f"""fixed AS (
  SELECT doc_id, source, i AS chunk_index, substr(text, i * {SIZE} + 1, {SIZE}) AS content
  FROM (SELECT doc_id, source, text, unnest(range((length(text) + {SIZE - 1}) // {SIZE})) AS i FROM documents) d)"""

# The separator before a sentence is replaced by a mark, as the regular expressions here have no lookbehind.
SQL_SENTENCES = r"""sents AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)"""

SQL_PACKS = f"""packs AS (
  SELECT doc_id, 1 AS i, 0 AS chunk, s[1] AS cur, NULL::VARCHAR AS done, s FROM sents
  UNION ALL
  SELECT doc_id, i + 1,
         CASE WHEN length(cur) + length(s[i + 1]) > {SIZE} THEN chunk + 1 ELSE chunk END,
         CASE WHEN length(cur) + length(s[i + 1]) > {SIZE} THEN s[i + 1] ELSE cur || ' ' || s[i + 1] END,
         CASE WHEN length(cur) + length(s[i + 1]) > {SIZE} THEN cur END, s
  FROM packs WHERE i < len(s)),
sentence_chunks AS (
  SELECT doc_id, chunk - 1 AS chunk_index, done AS content FROM packs WHERE done IS NOT NULL
  UNION ALL
  SELECT doc_id, chunk, cur FROM packs WHERE i = len(s) AND cur <> '')"""


@query("chunk_fixed", f"WITH {SQL_FIXED} {SQL_SHOWN} FROM fixed")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(C.chunk_fixed(texts(spark, sf_dir), SIZE))


@query(
    "chunk_overlap",
    f"""WITH o AS (
  SELECT doc_id, i AS chunk_index, substr(text, i * 448 + 1, {SIZE}) AS content
  FROM (SELECT doc_id, text, unnest(range((length(text) + 447) // 448)) AS i FROM documents) d
  WHERE i = 0 OR i * 448 + 64 < length(text))
{SQL_SHOWN} FROM o""",
)
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(C.chunk_fixed(texts(spark, sf_dir), SIZE, overlap=64))


@query("chunk_sentence", f"WITH RECURSIVE {SQL_SENTENCES}, {SQL_PACKS} {SQL_SHOWN} FROM sentence_chunks")
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(C.chunk_sentence(texts(spark, sf_dir), SIZE))


@query("chunk_semantic", f"""WITH {SQL_SENTENCES},
one AS (SELECT doc_id, unnest(s) AS sent, generate_subscripts(s, 1) AS i FROM sents),
h AS (
  SELECT doc_id, i, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, i, unnest(regexp_split_to_array(lower(sent), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM one) x WHERE t <> ''),
c AS (SELECT doc_id, i, h % {DIM} AS b, sum(CASE WHEN (h // {DIM}) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM h GROUP BY ALL),
sq AS (SELECT doc_id, i, sum(s * s) AS sq FROM c GROUP BY ALL),
dots AS (SELECT a.doc_id, a.i, sum(a.s * b.s) AS d FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.b = b.b AND b.i = a.i + 1 GROUP BY ALL),
gaps AS (
  SELECT o.doc_id, o.i,
         CASE WHEN coalesce(x.sq, 0) * coalesce(y.sq, 0) = 0 THEN 1.0
              ELSE 1.0 - coalesce(d.d, 0) / sqrt(x.sq * y.sq) END AS gap
  FROM one o JOIN one p ON p.doc_id = o.doc_id AND p.i = o.i + 1
  LEFT JOIN sq x ON x.doc_id = o.doc_id AND x.i = o.i
  LEFT JOIN sq y ON y.doc_id = o.doc_id AND y.i = o.i + 1
  LEFT JOIN dots d ON d.doc_id = o.doc_id AND d.i = o.i),
sorted AS (SELECT doc_id, list(gap ORDER BY gap) AS g, (count(*) - 1) * 0.9::DOUBLE AS place FROM gaps GROUP BY 1),
limits AS (
  SELECT doc_id, g[floor(place)::INT + 1] + (g[least(floor(place)::INT + 2, len(g))] - g[floor(place)::INT + 1]) * (place - floor(place)) AS lim
  FROM sorted),
marked AS (
  SELECT o.doc_id, o.i, o.sent, CASE WHEN g.gap > l.lim THEN 1 ELSE 0 END AS brk
  FROM one o LEFT JOIN gaps g ON g.doc_id = o.doc_id AND g.i = o.i - 1 LEFT JOIN limits l ON l.doc_id = o.doc_id),
seg AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM marked),
whole AS (SELECT doc_id, seg, string_agg(sent, ' ' ORDER BY i) AS t FROM seg GROUP BY ALL),
cut AS (
  SELECT doc_id, seg, j, substr(t, j * {SIZE} + 1, {SIZE}) AS content
  FROM (SELECT *, unnest(range((length(t) + {SIZE - 1}) // {SIZE})) AS j FROM whole) w),
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg, j) - 1 AS chunk_index, content FROM cut)
{SQL_SHOWN} FROM numbered""")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(C.chunk_semantic(texts(spark, sf_dir), SIZE, threshold_pct=90.0, dim=DIM))


@query("chunk_dispatch", f"WITH {SQL_FIXED} {SQL_SHOWN} FROM fixed")
def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semantic strategy asked to fall back to fixed slices."""
    return shown(C.chunk(texts(spark, sf_dir), "semantic", SIZE, fallback="fixed"))


@query(
    "chunk_ids",
    f"""WITH {SQL_FIXED}
SELECT sha256(f.source || chr(1) || 'fixed' || chr(1) || chunk_index || chr(1) || content) AS id, f.source,
       chunk_index::INT AS chunk_index, 'txt' AS type, 'fixed' AS chunking_strategy,
       octet_length(encode(d.text))::VARCHAR AS file_size
FROM fixed f JOIN documents d USING (doc_id)""",
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("source", "text", F.octet_length("text").alias("bytes"))
    built = C.build_chunks(C.chunk_fixed(docs, SIZE), "fixed", file_size=F.col("bytes"))
    return built.select(
        "id",
        "source",
        "chunk_index",
        *[F.element_at("metadata", F.lit(k)).alias(k) for k in ("type", "chunking_strategy", "file_size")],
    )


@query(
    "chunk_stats",
    f"""WITH {SQL_FIXED}
SELECT source, count(*) AS n_chunks, min(length(content))::INT AS min_chars, round(avg(length(content)), 6) AS avg_chars,
       max(length(content))::INT AS max_chars,
       floor(sum(len(regexp_extract_all(content, '\\S+'))) * 1.3::DOUBLE)::BIGINT AS est_tokens
FROM fixed GROUP BY 1""",
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("source", "text")
    return C.chunk_stats(C.chunk_fixed(docs, SIZE), "source").withColumn("avg_chars", r("avg_chars"))
