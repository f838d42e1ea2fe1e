"""Registration of the named queries and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIM = 64


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL for the same result where SQL can say it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A table of fewer bytes than this is dealt to all cores; no larger one is ever shuffled to be read.
SMALL_TABLE = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table too small to have many splits; any other is read as it is."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_TABLE else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: caller, time, tokens and latency."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("value") * 10).cast("bigint").alias("tokens"),
        F.col("value").alias("response_time"),
    )


SQL_REQUEST_LOG = """log AS (
  SELECT event_id AS request_id, user_id AS key, ts, epoch_us(ts) AS us,
         floor(value * 10)::BIGINT AS tokens, value AS response_time
  FROM events)"""


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; never a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def sql_hash_vectors(name: str, rows: str, dim: int = DIM) -> str:
    """CTEs: ``<name>`` with ``id, v`` (dense signed counts as doubles) and ``n`` (length).

    ``rows`` is a table or subquery with ``id, text``.
    """
    return f"""{name}_h AS (
  SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h
  FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {rows}) x
  WHERE t <> ''),
{name}_s AS (
  SELECT id, h % {dim} AS b, sum(CASE WHEN (h // {dim}) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s
  FROM {name}_h GROUP BY 1, 2),
{name} AS (
  SELECT g.id, list(coalesce(s.s, 0.0) ORDER BY g.b) AS v, sqrt(sum(coalesce(s.s * s.s, 0.0))) AS n
  FROM (SELECT i.id, b.b FROM (SELECT DISTINCT id FROM {name}_s) i, (SELECT unnest(range({dim})) AS b) b) g
  LEFT JOIN {name}_s s ON s.id = g.id AND s.b = g.b
  GROUP BY g.id HAVING n > 0)"""
