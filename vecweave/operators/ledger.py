"""Which documents still need work: a transition log and the state derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecweave.plans.blocks import MAX_KEY_ROWS, carry_in, in_block, into_blocks
from vecweave.schemas import JOB_STATUSES, require

MAX_RETRIES = 3
PROCESSING_TIMEOUT_SECONDS = 3600
# Blocks of a very long history span this many seconds.
BLOCK_SECONDS = 3600


def fingerprint(path: Column, modified: Column, size: Column) -> Column:
    """First 16 hex digits of sha256 over path, modification time in microseconds and size."""
    parts = [path, F.unix_micros(modified).cast("string"), size.cast("string")]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def content_fingerprint(content: Column) -> Column:
    """The same form from the bytes, for stores whose modification times change."""
    return F.substring(F.sha2(content, 256), 1, 16)


def ledger_history(
    transitions: DataFrame, block_seconds: int = BLOCK_SECONDS, max_rows: int = MAX_KEY_ROWS
) -> DataFrame:
    """Each transition with the retry count in force after it.

    A start that follows a failure adds one; any other start sets the count to zero.
    Both the previous status and the count are scans along a file's transitions. A file
    with a very long history is cut into time blocks, which take over one summary row
    per earlier block.
    """
    keys = ["fingerprint"]
    coarse = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / block_seconds)
    rows, cut = into_blocks(transitions, keys, coarse, max_rows)
    ordered = in_block(keys).orderBy("ts", "seq")
    previous = F.lag("status").over(ordered)
    if cut:
        rows = carry_in(
            rows,
            keys,
            {"_last": F.max_by("status", F.struct("ts", "seq"))},
            {"_earlier": lambda w: F.last("_last").over(w)},
        )
        previous = F.coalesce(previous, "_earlier")
    start = F.col("status") == "processing"
    retried = start & F.col("_previous").eqNullSafe("failed")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        rows.withColumn("_previous", previous)
        .withColumn("_retry", F.when(retried, 1).otherwise(0))
        .withColumn("_retries", F.sum("_retry").over(running))
        # The number of retries at the latest start that set the count to zero.
        .withColumn("_base", F.max(F.when(start & (F.col("_retry") == 0), F.col("_retries"))).over(running))
    )
    before, base = F.lit(0), F.col("_base")
    if cut:
        counted = carry_in(
            counted,
            keys,
            {"_n": F.sum("_retry"), "_b": F.max("_base")},
            {
                "_before": lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0)),
                "_base_before": lambda w: F.max(F.col("_before") + F.col("_b")).over(w),
            },
        )
        before = F.coalesce("_before", F.lit(0))
        base = F.coalesce(before + F.col("_base"), "_base_before")
    count = before + F.col("_retries") - F.coalesce(base, F.lit(0))
    return counted.withColumn("retry_count", count.cast("int")).select(*transitions.columns, "retry_count")


def ledger_state(transitions: DataFrame) -> DataFrame:
    """Latest state per file, aggregated from the history with partial aggregation."""
    at = F.struct("ts", "seq")
    history = ledger_history(transitions)
    started = F.when(F.col("status") == "processing", F.col("ts"))
    return (
        history.groupBy("fingerprint")
        .agg(
            F.max_by(F.struct("status", "instance_id", "ts", "error_message", "retry_count"), at).alias("_now"),
            F.max(started).alias("started_at"),
        )
        .select(
            "fingerprint",
            "_now.status",
            "_now.instance_id",
            "started_at",
            F.when(F.col("_now.status").isin("completed", "failed"), F.col("_now.ts")).alias("completed_at"),
            "_now.error_message",
            "_now.retry_count",
        )
    )


def pending_verdict(
    manifest: DataFrame,
    ledger: DataFrame,
    now: Column,
    instance: str,
    timeout_seconds: int = PROCESSING_TIMEOUT_SECONDS,
    max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """Each manifest row with ``can_process`` and the ``reason``."""
    state = ledger.select(
        "fingerprint",
        F.col("status").alias("_status"),
        F.col("instance_id").alias("_owner"),
        F.col("started_at").alias("_started"),
        F.col("retry_count").alias("_retries"),
    )
    status = F.col("_status")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_started").cast("timestamp"))
    own = F.col("_owner").eqNullSafe(F.lit(instance))
    recent = age < timeout_seconds * 1_000_000
    reason = (
        F.when(status.isNull(), "new")
        .when(status == "completed", "completed")
        .when((status == "processing") & ~own & recent, "busy elsewhere")
        .when((status == "processing") & ~own, "timed out elsewhere")
        .when((status == "failed") & (F.col("_retries") < max_retries), "retry")
        .when(status == "failed", "retries used up")
        .when(own, "own")
        .otherwise("owned elsewhere")
    )
    return (
        manifest.join(state, "fingerprint", "left")
        .withColumn("reason", reason)
        .withColumn("can_process", F.col("reason").isin("new", "timed out elsewhere", "retry", "own"))
        .drop("_status", "_owner", "_started", "_retries")
    )


def pending(manifest: DataFrame, ledger: DataFrame, now: Column, instance: str, **limits: int) -> DataFrame:
    """The manifest rows this instance may process now."""
    verdict = pending_verdict(manifest, ledger, now, instance, **limits)
    return verdict.filter("can_process").drop("can_process", "reason")


def ledger_summary(ledger: DataFrame) -> DataFrame:
    def of(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1)).alias(status)

    return ledger.agg(F.count(F.lit(1)).alias("total"), of("processing"), of("completed"), of("failed"))


def files_by_status(ledger: DataFrame, status: str) -> DataFrame:
    return ledger.filter(F.col("status") == require(status, JOB_STATUSES, "status"))


def completed_files(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Manifest rows already finished."""
    return manifest.join(files_by_status(ledger, "completed").select("fingerprint"), "fingerprint", "left_semi")


def reset_failed(ledger: DataFrame) -> DataFrame:
    """The ledger without its failed entries, which makes those files new again."""
    return ledger.filter(~F.col("status").eqNullSafe("failed"))


def reset_failed_transitions(transitions: DataFrame) -> DataFrame:
    """The log without the files whose latest state is failed."""
    failed = files_by_status(ledger_state(transitions), "failed").select("fingerprint")
    return transitions.join(failed, "fingerprint", "left_anti")


def claim_transitions(due: DataFrame, instance: str, now: Column, seq: Column | int = 0) -> DataFrame:
    """A ``processing`` transition for each due file (``fingerprint``), to append before the work starts."""
    seq = F.lit(seq) if isinstance(seq, int) else seq
    return due.select(
        "fingerprint",
        seq.cast("bigint").alias("seq"),
        now.cast("timestamp").alias("ts"),
        F.lit(instance).alias("instance_id"),
        F.lit("processing").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def outcome_transitions(outcomes: DataFrame, instance: str, started: Column, finished: Column) -> DataFrame:
    """Start and end transitions of processed files (``fingerprint, error``) to append to the log.

    A column ``seq`` of ``outcomes`` is the number of a file's first new transition.
    """
    base = F.col("seq") if "seq" in outcomes.columns else F.lit(0)
    end = F.when(F.col("error").isNull(), "completed").otherwise("failed")
    none = F.lit(None).cast("string")

    def entry(seq: int, at: Column, status: Column, message: Column) -> Column:
        return F.struct(
            (base + seq).cast("bigint").alias("seq"),
            at.alias("ts"),
            F.lit(instance).alias("instance_id"),
            status.alias("status"),
            message.alias("error_message"),
        )

    both = F.array(entry(0, started, F.lit("processing"), none), entry(1, finished, end, F.col("error")))
    return outcomes.select("fingerprint", F.explode(both).alias("_t")).select("fingerprint", "_t.*")
