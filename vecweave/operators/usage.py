"""Usage metering over a request log ``key, ts, tokens, response_time``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecweave.catalog import QUOTA_PRESETS
from vecweave.plans.blocks import BLOCK, MAX_KEY_ROWS, carry_in, large_keys, null_safe_join, originals, overlapping_blocks, position_in_key
from vecweave.session import shared_dir

MICROS = 1_000_000
MINUTE_SECONDS = 60
LATENCY_HISTORY = 100
# A block of responses holds this many histories, so one row in a thousand is copied.
_HISTORIES_PER_BLOCK = 1000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# Rows of one slice of a busy caller.
_SLICE_ROWS = 1_000_000


def _running(log: DataFrame, spans: dict[str, int], max_rows: int) -> DataFrame:
    """The log with what its caller has in each trailing window at each request.

    A request counts from its own time on and stops counting when it leaves the window, so it is
    written as +1 and, for each window, as -1 at its exit; counts are then running totals, one
    pass over a caller's rows in order, however many fall into one window. ``spans`` maps a
    name to the microsecond after which a request has left. Adds ``_n_<name>, _t_<name>`` and
    ``_oldest_<name>``, the time of the oldest request inside.

    Requests leave in the order they came, so the oldest one inside is the one after the last that left:
    each exit row carries the time of the next request.
    """
    names = list(log.columns)
    timed = log.withColumn("_us", micros(F.col("ts")))
    coming = Window.partitionBy("key").orderBy("_us")
    cut = large_keys(log, ["key"], max_rows) is not None
    if cut:
        timed, coming = _sliced(timed, "_us"), Window.partitionBy("key", BLOCK).orderBy("_us")
        first = timed.groupBy("key", BLOCK).agg(F.min("_us").alias("_first"))
        first = first.withColumn("_after", F.lead("_first").over(Window.partitionBy("key").orderBy(BLOCK))).drop("_first")
        timed = null_safe_join(timed, first, ["key", BLOCK])
    else:
        timed = timed.withColumn("_after", F.lit(None).cast("bigint"))
    # Requests of one time leave together: the largest of their next times is the later one.
    timed = timed.withColumn("_next", F.coalesce(F.lead("_us").over(coming), "_after")).drop("_after", BLOCK)
    moves = [F.struct(F.lit(True).alias("in"), F.col("_us").alias("at"), F.lit(None).cast("string").alias("name"))]
    moves += [F.struct(F.lit(False).alias("in"), (F.col("_us") + leave).alias("at"), F.lit(name).alias("name")) for name, leave in spans.items()]
    rows = timed.withColumn("_m", F.explode(F.array(*moves)))
    in_, at, name = F.col("_m.in"), F.col("_m.at"), F.col("_m.name")
    rows = rows.withColumn("_at", at)
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    steps = {}
    for span in spans:
        sign = F.when(in_, 1).when(name == span, -1).otherwise(0)
        steps[f"_n_{span}"] = F.sum(sign)
        steps[f"_t_{span}"] = F.sum(sign * tokens)
        steps[f"_k_{span}"] = F.sum(sign * F.col("tokens").isNotNull().cast("int"))
        steps[f"_oldest_{span}"] = F.max(F.when(~in_ & (name == span), F.col("_next")))
    steps["_began"] = F.min(F.when(in_, F.col("_us")))
    keep = F.col("_m.in")
    if not cut:
        order = Window.partitionBy("key").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
        rows = rows.select("*", *[c.over(order).alias(n) for n, c in steps.items()]).filter(keep)
    else:
        rows = _sliced(rows, "_at")
        join = {"_began": F.least} | {f"_oldest_{x}": F.greatest for x in spans}
        carried = {
            f"_c{n}": (lambda w, n=n: (F.min if n == "_began" else F.max if n in join else F.sum)(f"_s{n}").over(w)) for n in steps
        }
        rows = carry_in(rows, ["key"], {f"_s{n}": c for n, c in steps.items()}, carried)
        order = Window.partitionBy("key", BLOCK).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
        here = rows.select("*", *[c.over(order).alias(n) for n, c in steps.items()]).filter(keep)
        zero = F.lit(0)
        for n in steps:
            total = join[n](F.col(n), F.col(f"_c{n}")) if n in join else F.coalesce(n, zero) + F.coalesce(f"_c{n}", zero)
            here = here.withColumn(n, total).drop(f"_c{n}")
        rows = here.drop(BLOCK)
    for span in spans:
        rows = rows.withColumn(f"_oldest_{span}", F.coalesce(f"_oldest_{span}", "_began"))
        rows = rows.withColumn(f"_t_{span}", F.when(F.col(f"_k_{span}") > 0, F.col(f"_t_{span}")))
    return rows.select(*names, "_us", *[f"_{c}_{x}" for x in spans for c in ("n", "t", "oldest")])


def _sliced(rows: DataFrame, at: str) -> DataFrame:
    """Rows with ``_block``: slices of about equal numbers of rows along (key, time), equal times together.

    Range partitioning cuts them; the result is stored, as a second computation could cut elsewhere.
    """
    slices = max(-(-rows.count() // _SLICE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.repartitionByRange(slices, "key", at).withColumn(BLOCK, F.spark_partition_id().cast("bigint"))
    path = shared_dir(rows.sparkSession, "slices")
    spread.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def trailing_usage(
    log: DataFrame,
    window_seconds: int = MINUTE_SECONDS,
    requests_limit: int | None = None,
    tokens_limit: int | None = None,
    burst_seconds: int | None = None,
    burst_limit: int | None = None,
    max_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Requests and tokens of the caller in the window that ends at each request.

    The window includes the request itself and both of its ends. With limits, adds
    ``over_limit`` and the seconds until the oldest request leaves the window. With
    ``burst_seconds``, adds the shorter burst count, whose far end is excluded.
    """
    spans = {"window": window_seconds * MICROS + 1} | ({"burst": burst_seconds * MICROS} if burst_seconds else {})
    rows = _running(log, spans, max_rows)
    out = rows.withColumn("requests_in_window", F.col("_n_window")).withColumn("tokens_in_window", F.col("_t_window"))
    over = F.lit(False)
    if requests_limit is not None:
        over = over | (F.col("requests_in_window") > requests_limit)
    if tokens_limit is not None:
        over = over | (F.coalesce("tokens_in_window", F.lit(0)) > tokens_limit)
    if burst_seconds:
        out = out.withColumn("burst_requests", F.col("_n_burst"))
        if burst_limit is not None:
            out = out.withColumn("over_burst", F.col("burst_requests") > burst_limit)
    wait = F.lit(float(window_seconds)) - (F.col("_us") - F.col("_oldest_window")) / MICROS
    out = out.withColumn("over_limit", over).withColumn("wait_seconds", F.when(F.col("over_limit"), wait).otherwise(0.0))
    return out.drop("_us", *[f"_{c}_{x}" for x in spans for c in ("n", "t", "oldest")])


def burst_usage(
    log: DataFrame, burst_seconds: int, max_burst_requests: int, max_rows: int = MAX_KEY_ROWS
) -> DataFrame:
    """Requests within the burst window against the burst limit."""
    rows = _running(log, {"burst": burst_seconds * MICROS}, max_rows)
    out = rows.withColumn("burst_requests", F.col("_n_burst")).drop("_us", "_n_burst", "_t_burst", "_oldest_burst")
    return out.withColumn("over_burst", F.col("burst_requests") > max_burst_requests)


def latency_adaptation(
    log: DataFrame,
    base_rpm: int = 60,
    target: float = 2.0,
    maximum: float = 10.0,
    factor: float = 0.1,
    history: int = LATENCY_HISTORY,
    block_seconds: int = 3600,
    tie: str = "request_id",
    max_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Rate adjustment each response asks for.

    The mean of the last ``history`` latencies counts 0.7 and the latest 0.3 (a latency
    of zero is not weighted). Above ``maximum`` the rate falls by 2 * factor, above
    ``target`` by factor, below half the target it rises by factor.
    """
    placed, cut = position_in_key(
        log.withColumn("_us", micros(F.col("ts"))),
        ["key"],
        [F.col("_us"), F.col(tie)],
        F.floor(F.col("_us") / (block_seconds * MICROS)),
        max_rows,
    )
    spread = overlapping_blocks(placed, F.col("_pos"), history * _HISTORIES_PER_BLOCK, history - 1, cut)
    recent = Window.partitionBy("key", BLOCK).orderBy("_pos").rowsBetween(-(history - 1), 0)
    latest = F.col("response_time")
    mean = F.avg("response_time").over(recent)
    weighted = F.when(latest != 0, mean * 0.7 + latest * 0.3).otherwise(mean)
    adjustment = (
        F.when(F.col("smoothed_latency") > maximum, -2 * factor)
        .when(F.col("smoothed_latency") > target, -factor)
        .when(F.col("smoothed_latency") < target * 0.5, factor)
        .otherwise(0.0)
    )
    return originals(
        spread.withColumn("smoothed_latency", weighted)
        .withColumn("adjustment", adjustment)
        .withColumn("suggested_rpm", F.greatest(F.lit(1), F.floor(F.lit(base_rpm) * (F.col("adjustment") + 1.0))))
    ).drop("_us", "_pos")


def usage_report(log: DataFrame, now: Column, window_seconds: int = MINUTE_SECONDS, **limits: int) -> DataFrame:
    """Totals, limit hits, mean latency and last-window counts per caller."""
    measured = trailing_usage(log, window_seconds, **limits)
    recent = (micros(now) - micros(F.col("ts"))) < window_seconds * MICROS
    recent = recent & (micros(F.col("ts")) <= micros(now))
    return measured.groupBy("key").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum("tokens").alias("total_tokens"),
        F.count(F.when(F.col("over_limit"), 1)).alias("limit_hits"),
        F.avg("response_time").alias("mean_latency"),
        F.count(F.when(recent, 1)).alias("requests_in_last_window"),
        F.coalesce(F.sum(F.when(recent, F.col("tokens"))), F.lit(0)).alias("tokens_in_last_window"),
    )


def quota_fit(log: DataFrame) -> DataFrame:
    """Peak usage in any trailing minute of each caller against every preset.

    The thirteen presets are literals, so each caller's one row grows to thirteen.
    """
    peaks = (
        trailing_usage(log)
        .groupBy("key")
        .agg(
            F.max("requests_in_window").alias("peak_requests"),
            F.max("tokens_in_window").alias("peak_tokens"),
        )
    )
    presets = F.array(
        *[
            F.struct(
                F.lit(name).alias("preset"),
                F.lit(rpm).cast("bigint").alias("requests_per_minute"),
                F.lit(tpm).cast("bigint").alias("tokens_per_minute"),
                F.lit(burst).cast("bigint").alias("max_burst_requests"),
            )
            for name, rpm, tpm, burst, _ in QUOTA_PRESETS
        ]
    )
    fits_tokens = F.col("tokens_per_minute").isNull() | (F.col("peak_tokens") <= F.col("tokens_per_minute"))
    return (
        peaks.withColumn("_p", F.explode(presets))
        .select("key", "peak_requests", "peak_tokens", "_p.*")
        .withColumn("fits_burst", F.col("peak_requests") <= F.col("max_burst_requests"))
        .withColumn("fits", (F.col("peak_requests") <= F.col("requests_per_minute")) & fits_tokens)
    )
