"""Job statistics, the ledger, usage metering and sampling, over ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.catalog import QUOTA_PRESETS
from vecweave.catalogue.base import SQL_REQUEST_LOG, documents, query, r, request_log, table
from vecweave.operators import ledger as L
from vecweave.operators import sampling, stats, usage
from vecweave.session import shared_dir

# --- statistics: each event is one result; errors are failures.


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processing results."""
    ok = F.col("event_type") != "error"
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("job_id"),
        F.col("user_id"),
        ok.alias("success"),
        F.when(ok, (F.col("event_id") % 5).cast("int")).otherwise(0).alias("n_embedded"),
        F.col("value").alias("processing_time"),
        F.when(F.col("event_id") % 7 != 0, F.create_map(F.lit("total_tokens"), k))
        .otherwise(F.create_map().cast("map<string,bigint>"))
        .alias("token_usage"),
        F.when(~ok, F.concat(F.lit("failed "), F.col("event_id") % 3)).alias("error"),
    )


SQL_STATS = """SELECT {keys} embedded + failed AS total_chunks, embedded AS embedded_chunks, failed AS failed_chunks,
       tokens AS total_tokens, round(t, 4) AS total_processing_time,
       round(CASE WHEN embedded + failed > 0 THEN t / (embedded + failed) ELSE 0 END, 9) AS average_embedding_time,
       round(embedded / greatest(1, embedded + failed) * 100, 6) AS success_rate
FROM (SELECT {keys} sum(CASE WHEN event_type <> 'error' THEN event_id % 5 ELSE 0 END)::BIGINT AS embedded,
             count(*) FILTER (event_type = 'error') AS failed,
             sum(CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k')::BIGINT ELSE 0 END)::BIGINT AS tokens,
             sum(value) AS t FROM events {group}) x"""


def shown_stats(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("total_processing_time", F.round("total_processing_time", 4))
        .withColumn("average_embedding_time", F.round("average_embedding_time", 9))
        .withColumn("success_rate", F.round("success_rate", 6))
    )


@query("embedding_stats", SQL_STATS.format(keys="", group=""))
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_stats(stats.embedding_stats(results(spark, sf_dir)))


SQL_BATCHES = """b AS (
  SELECT event_id // 50 AS batch_id, count(*)::INT AS n_chunks, max(ts) AS ended,
         min(CASE WHEN event_type = 'error' AND value > 60 THEN 'slow ' || event_type END) AS error
  FROM events GROUP BY 1)"""


@query(
    "batch_status",
    f"""WITH {SQL_BATCHES}
SELECT CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, count(*) AS n_batches,
       sum(n_chunks)::BIGINT AS n_chunks, max(epoch_us(ended)) AS last_us, count(error) AS n_errors, min(error) AS sample_error
FROM b GROUP BY 1""",
)
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of fifty events; one with a slow error has failed."""
    events = table(spark, sf_dir, "events").withColumn("batch_id", F.floor(F.col("event_id") / 50))
    slow = (F.col("event_type") == "error") & (F.col("value") > 60)
    batches = events.groupBy("batch_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_chunks"),
        F.max(F.col("ts").cast("timestamp")).alias("at"),
        F.lit("processing").alias("status"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        F.lit(None).cast("string").alias("error"),
    )
    failures = events.filter(slow).groupBy("batch_id").agg(F.min(F.concat(F.lit("slow "), "event_type")).alias("error"))
    done = stats.mark_batches(batches, failures, F.col("at"))
    return (
        stats.batch_status(done)
        .withColumn("last_us", F.unix_micros("last_processed_at"))
        .drop("last_processed_at")
    )


@query(
    "run_summary",
    """SELECT coalesce(m, 'unknown') AS model, count(*) AS chunks_processed, count(*) FILTER (event_type <> 'error') AS embeddings_generated,
       round(max(epoch_us(ts) / 1e6 - epoch_us(TIMESTAMP '2024-01-01') / 1e6), 3) AS seconds
FROM (SELECT *, CASE WHEN user_id % 3 > 0 THEN 'model-' || user_id % 3 END AS m FROM events) e GROUP BY 1""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("model-"), F.col("user_id") % 3)).alias("embedding_model"),
        F.when(F.col("event_type") != "error", F.array(F.col("value").cast("float"))).alias("embedding"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    told = stats.run_summary(stats.observed_counts(made, "embedded"), F.lit("2024-01-01").cast("timestamp"), F.col("ts"))
    return told.withColumn("seconds", F.round("seconds", 3))


# --- ledger: users are files, events their transitions.

SQL_TRANSITIONS = """t AS (
  SELECT user_id::VARCHAR AS fingerprint, event_id AS seq, ts, 'worker-' || event_id % 3 AS instance_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'processing'
              WHEN event_type IN ('purchase', 'signup') THEN 'completed' ELSE 'failed' END AS status,
         CASE WHEN event_type = 'error' THEN 'error ' || event_id % 10 END AS error_message
  FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY fingerprint ORDER BY ts, seq) AS prev FROM t),
f AS (SELECT *, status = 'processing' AND coalesce(prev, '') = 'failed' AS retry,
             status = 'processing' AND coalesce(prev, '') <> 'failed' AS reset FROM p),
g AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY ts, seq) AS island FROM f),
history AS (SELECT *, (sum(CASE WHEN retry THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint, island ORDER BY ts, seq))::INT AS retry_count FROM g),
state AS (
  SELECT fingerprint, status, instance_id, started_at, CASE WHEN status <> 'processing' THEN ts END AS completed_at,
         error_message, retry_count
  FROM (SELECT *, max(CASE WHEN status = 'processing' THEN ts END) OVER (PARTITION BY fingerprint) AS started_at,
               row_number() OVER (PARTITION BY fingerprint ORDER BY ts DESC, seq DESC) AS rn FROM history) h
  WHERE rn = 1)"""

NOW = "2024-01-31 00:00:00"


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("fingerprint"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("worker-"), F.col("event_id") % 3).alias("instance_id"),
        F.when(kind.isin("view", "click"), "processing")
        .when(kind.isin("purchase", "signup"), "completed")
        .otherwise("failed")
        .alias("status"),
        F.when(kind == "error", F.concat(F.lit("error "), F.col("event_id") % 10)).alias("error_message"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user of the events and as many files nobody has seen."""
    users = table(spark, sf_dir, "events").groupBy("user_id").count()
    both = users.select(F.explode(F.array(F.col("user_id"), F.col("user_id") + 1000000)).alias("user_id"))
    return both.select(F.col("user_id").cast("string").alias("fingerprint"))


SQL_MANIFEST = """m AS (SELECT DISTINCT u::VARCHAR AS fingerprint FROM (
  SELECT user_id AS u FROM events UNION ALL SELECT user_id + 1000000 FROM events) x)"""


@query("ledger_history", f"WITH {SQL_TRANSITIONS} SELECT fingerprint, seq, status, retry_count FROM history")
def ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger_history(transitions(spark, sf_dir)).select("fingerprint", "seq", "status", "retry_count")


@query("ledger_history_blocks", f"WITH {SQL_TRANSITIONS} SELECT fingerprint, seq, status, retry_count FROM history")
def ledger_history_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every file treated as a long history and cut into days."""
    history = L.ledger_history(transitions(spark, sf_dir), block_seconds=86400, max_rows=1)
    return history.select("fingerprint", "seq", "status", "retry_count")


@query(
    "ledger_state",
    f"""WITH {SQL_TRANSITIONS} SELECT fingerprint, status, instance_id, epoch_us(started_at) AS started_us,
       epoch_us(completed_at) AS completed_us, error_message, retry_count FROM state""",
)
def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = L.ledger_state(transitions(spark, sf_dir))
    return (
        state.withColumn("started_us", F.unix_micros("started_at"))
        .withColumn("completed_us", F.unix_micros("completed_at"))
        .drop("started_at", "completed_at")
    )


@query(
    "ledger_pending",
    f"""WITH {SQL_TRANSITIONS}, {SQL_MANIFEST},
v AS (SELECT m.fingerprint,
  CASE WHEN s.status IS NULL THEN 'new' WHEN s.status = 'completed' THEN 'completed'
       WHEN s.status = 'processing' AND s.instance_id <> 'worker-1' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(s.started_at) < 43200000000 THEN 'busy elsewhere'
       WHEN s.status = 'processing' AND s.instance_id <> 'worker-1' THEN 'timed out elsewhere'
       WHEN s.status = 'failed' AND s.retry_count < 3 THEN 'retry' WHEN s.status = 'failed' THEN 'retries used up' ELSE 'own' END AS reason
  FROM m LEFT JOIN state s ON s.fingerprint = m.fingerprint)
SELECT fingerprint, reason, reason IN ('new', 'timed out elsewhere', 'retry', 'own') AS can_process FROM v""",
)
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files worker-1 may take, with twelve hours of patience for the others."""
    state = L.ledger_state(transitions(spark, sf_dir))
    now = F.lit(NOW).cast("timestamp")
    return L.pending_verdict(manifest(spark, sf_dir), state, now, "worker-1", timeout_seconds=43200)


@query(
    "ledger_summary",
    f"""WITH {SQL_TRANSITIONS} SELECT count(*) AS total, count(*) FILTER (status = 'processing') AS processing,
       count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM state""",
)
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger_summary(L.ledger_state(transitions(spark, sf_dir)))


@query("reset_failed", f"WITH {SQL_TRANSITIONS} SELECT fingerprint, status, retry_count FROM state WHERE status <> 'failed'")
def reset_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reset_failed(L.ledger_state(transitions(spark, sf_dir))).select("fingerprint", "status", "retry_count")


@query(
    "completed_files",
    f"""WITH {SQL_TRANSITIONS}, {SQL_MANIFEST}
SELECT m.fingerprint FROM m JOIN state s ON s.fingerprint = m.fingerprint AND s.status = 'completed'""",
)
def completed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.completed_files(manifest(spark, sf_dir), L.ledger_state(transitions(spark, sf_dir)))


# --- usage: users are callers. An hour is the window, as the events are sparse.

HOUR = 3600
RANGE = "PARTITION BY key ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW"


SQL_TRAILING = f"""WITH {SQL_REQUEST_LOG},
w AS (SELECT *, count(*) OVER h AS n, sum(tokens) OVER h AS t, min(us) OVER h AS oldest
      FROM log WINDOW h AS ({RANGE.format(HOUR * 1000000)}))
SELECT request_id, n AS requests_in_window, t::BIGINT AS tokens_in_window, n > 1 OR t > 600 AS over_limit,
       round(CASE WHEN n > 1 OR t > 600 THEN {HOUR} - (us - oldest) / 1e6 ELSE 0 END, 6) AS wait_seconds FROM w"""


def _trailing(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    used = usage.trailing_usage(request_log(spark, sf_dir), HOUR, requests_limit=1, tokens_limit=600, **options)
    return used.select(
        "request_id", "requests_in_window", "tokens_in_window", "over_limit", r("wait_seconds").alias("wait_seconds")
    )


@query("trailing_usage", SQL_TRAILING)
def trailing_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trailing(spark, sf_dir)


@query("trailing_usage_blocks", SQL_TRAILING)
def trailing_usage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every caller treated as very busy and cut into blocks of time."""
    return _trailing(spark, sf_dir, max_rows=1)


@query("trailing_usage_one_caller", SQL_TRAILING.replace("PARTITION BY key", "PARTITION BY 1"))
def trailing_usage_one_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests as those of one caller, cut into slices of rows."""
    log = request_log(spark, sf_dir).withColumn("key", F.lit(1))
    used = usage.trailing_usage(log, HOUR, requests_limit=1, tokens_limit=600, max_rows=1000)
    return used.select("request_id", "requests_in_window", "tokens_in_window", "over_limit", r("wait_seconds").alias("wait_seconds"))


@query(
    "burst_usage",
    f"""WITH {SQL_REQUEST_LOG}
SELECT request_id, count(*) OVER h AS burst_requests, count(*) OVER h > 2 AS over_burst
FROM log WINDOW h AS ({RANGE.format(4 * HOUR * 1000000 - 1)})""",
)
def burst_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.burst_usage(request_log(spark, sf_dir), 4 * HOUR, 2).select("request_id", "burst_requests", "over_burst")


SQL_ADAPTATION = f"""WITH {SQL_REQUEST_LOG},
w AS (SELECT *, avg(response_time) OVER (PARTITION BY key ORDER BY us, request_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m FROM log),
s AS (SELECT *, CASE WHEN response_time <> 0 THEN m * 0.7::DOUBLE + response_time * 0.3::DOUBLE ELSE m END AS smoothed FROM w),
a AS (SELECT *, CASE WHEN smoothed > 25 THEN -0.2 WHEN smoothed > 15 THEN -0.1 WHEN smoothed < 7.5 THEN 0.1 ELSE 0.0 END::DOUBLE AS adj FROM s)
SELECT request_id, round(smoothed, 9) AS smoothed_latency, adj AS adjustment,
       greatest(1, floor(60 * (adj + 1.0::DOUBLE)))::BIGINT AS suggested_rpm FROM a"""


def _adaptation(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    asked = usage.latency_adaptation(request_log(spark, sf_dir), 60, target=15.0, maximum=25.0, **options)
    return asked.select(
        "request_id",
        F.round("smoothed_latency", 9).alias("smoothed_latency"),
        "adjustment",
        F.col("suggested_rpm").cast("bigint").alias("suggested_rpm"),
    )


@query("latency_adaptation", SQL_ADAPTATION)
def latency_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptation(spark, sf_dir)


@query("latency_adaptation_blocks", SQL_ADAPTATION)
def latency_adaptation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptation(spark, sf_dir, max_rows=1, block_seconds=86400)


@query(
    "usage_report",
    f"""WITH {SQL_REQUEST_LOG},
w AS (SELECT *, count(*) OVER h > 1 AS over_limit,
             us <= epoch_us(TIMESTAMP '2024-01-30 12:00:00') AND epoch_us(TIMESTAMP '2024-01-30 12:00:00') - us < 86400000000 AS recent
      FROM log WINDOW h AS ({RANGE.format(86400000000)}))
SELECT key, count(*) AS total_requests, sum(tokens)::BIGINT AS total_tokens, count(*) FILTER (over_limit) AS limit_hits,
       round(avg(response_time), 4) AS mean_latency, count(*) FILTER (recent) AS requests_in_last_window,
       coalesce(sum(tokens) FILTER (recent), 0)::BIGINT AS tokens_in_last_window
FROM w GROUP BY 1""",
)
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    told = usage.usage_report(request_log(spark, sf_dir), now, 86400, requests_limit=1)
    return told.withColumn("mean_latency", F.round("mean_latency", 4))


SQL_PRESETS = "presets(preset, rpm, tpm, burst) AS (VALUES " + ", ".join(
    f"('{n}', {rpm}, {'NULL' if tpm is None else tpm}, {burst})" for n, rpm, tpm, burst, _ in QUOTA_PRESETS
) + ")"


@query(
    "quota_fit",
    f"""WITH {SQL_REQUEST_LOG}, {SQL_PRESETS},
w AS (SELECT key, count(*) OVER h AS n, sum(tokens) OVER h AS t FROM log WINDOW h AS ({RANGE.format(60000000)})),
peak AS (SELECT key, max(n) AS peak_requests, max(t)::BIGINT AS peak_tokens FROM w GROUP BY 1)
SELECT key, preset, peak_requests, peak_tokens, peak_requests <= burst AS fits_burst,
       peak_requests <= rpm AND (tpm IS NULL OR peak_tokens <= tpm) AS fits
FROM peak, presets""",
)
def quota_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = usage.quota_fit(request_log(spark, sf_dir))
    return fit.select("key", "preset", "peak_requests", "peak_tokens", "fits_burst", "fits")


# --- sampling.

MAX_BYTES = 30000


SQL_SPLIT = f"""WITH RECURSIVE d AS (
  SELECT source, doc_id, octet_length(encode(text)) + 1 AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
  FROM documents),
p AS (
  SELECT source, doc_id, rn, bytes AS used, 1 AS part FROM d WHERE rn = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.rn, CASE WHEN p.used + d.bytes > {MAX_BYTES} THEN d.bytes ELSE p.used + d.bytes END,
         CASE WHEN p.used + d.bytes > {MAX_BYTES} THEN p.part + 1 ELSE p.part END
  FROM p JOIN d ON d.source = p.source AND d.rn = p.rn + 1)
SELECT source, doc_id, part::BIGINT AS part FROM p"""


@query("split_by_bytes", SQL_SPLIT)
def split_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("source", "doc_id", "text")
    return sampling.split_by_bytes(docs, MAX_BYTES).select("source", "doc_id", "part")


@query("split_by_bytes_cells", SQL_SPLIT)
def split_by_bytes_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every source treated as too large for one pass."""
    docs = documents(spark, sf_dir).select("source", "doc_id", "text")
    return sampling.split_by_bytes(docs, MAX_BYTES, max_rows=1).select("source", "doc_id", "part")


@query(
    "split_parts_written",
    SQL_SPLIT.replace("SELECT source, doc_id, part::BIGINT AS part FROM p", "") + """SELECT source, part::INT AS part, sum(octet_length(encode(text)) + 1)::BIGINT AS n_bytes, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest
FROM p JOIN documents USING (source, doc_id) GROUP BY 1, 2""",
)
def split_parts_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as files, read back whole; ids are made sparse and far apart on the way."""
    docs = documents(spark, sf_dir).select("source", (F.col("doc_id") * F.col("doc_id") * 1_000_003).alias("doc_id"), "text")
    path = shared_dir(spark, "parts")
    sampling.write_parts(sampling.split_by_bytes(docs, MAX_BYTES, max_rows=1, block_rows=20), path)
    files = spark.read.text(path, wholetext=True)
    return files.select("source", "part", F.octet_length("value").cast("bigint").alias("n_bytes"), F.md5("value").alias("digest"))


@query("sample_exact", "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.sample_exact(docs, 100, id_column="doc_id")


@query(
    "sample_exact_large",
    "SELECT event_id, event_type FROM events ORDER BY md5(event_id || ':7'), event_id LIMIT (SELECT count(*) // 2 FROM events)",
)
def sample_exact_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events, by the bucket count path."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.sample_exact(events, events.count() // 2, 7, "event_id", small=0)
