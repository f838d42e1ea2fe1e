"""Equi-joins whose left side may have keys that hold much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecweave.session import shared_dir

# Lists of large keys up to this length are handled as literals by ``blocks``.
MAX_HOT_KEYS = 1024
ROWS_PER_SALT = 1_000_000
# A side of at most this many narrow rows is broadcast.
MAX_SENT_ROWS = 100_000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Column,
    how: str = "left",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join on ``key``, with the rows of hot keys spread over several tasks.

    The rows of each key on the left are counted first (the key column only, with partial
    aggregation). Without a hot key this is a plain join. Otherwise every key of more than
    ``rows_per_salt`` rows gets ceil(n / rows_per_salt) salts: left rows pick one from
    ``spread``, and the one right row of the key is copied to each. The list of hot keys is
    a stored table; Spark broadcasts it while it is small and joins it otherwise. Null keys
    match nothing and go round the join.
    """
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_salt)
    path = shared_dir(left.sparkSession, "hot-keys")
    counts.select(key, F.ceil(F.col("n") / rows_per_salt).cast("int").alias("_salts")).write.parquet(path)
    hot = left.sparkSession.read.parquet(path)
    if hot.isEmpty():
        return left.join(right, key, how)
    salts = F.coalesce("_salts", F.lit(1))
    salted_left = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(F.pmod(F.xxhash64(spread), salts)).cast("int"))
        .drop("_salts")
    )
    salted_right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def checked_broadcast(rows: DataFrame, max_rows: int = MAX_SENT_ROWS) -> DataFrame:
    """``rows`` computed once and counted: a broadcast side if there are few, else a plain one."""
    path = shared_dir(rows.sparkSession, "side")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    return F.broadcast(rows) if rows.count() <= max_rows else rows
