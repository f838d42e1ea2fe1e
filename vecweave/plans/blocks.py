"""Ordered windows that stay balanced when one key holds much of the data.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. That is the
right plan while keys are small, so the keys are counted first (a scan of the key
columns with partial aggregation). Keys over the limit are cut into blocks along their
order. Windows run inside (key, block); what a block needs from earlier blocks arrives
either as a summary row (``carry_in``) or as copies of the few rows it looks back on
(``overlapping_blocks``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vecweave.plans.skew import MAX_HOT_KEYS

BLOCK = "_block"
COPY = "_copy"
# A key with more rows than this is cut into blocks.
MAX_KEY_ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches null keys; the right side's key columns are dropped."""
    renamed = right
    for c in on:
        renamed = renamed.withColumnRenamed(c, f"_r_{c}")
    matches = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, matches, how).drop(*[f"_r_{c}" for c in on])


def in_block(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK)


def large_keys(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame | None:
    """The keys with more than ``max_rows`` rows; None where there are none.

    Only up to ``MAX_HOT_KEYS`` of them come to the driver; with more, every key counts
    as large and the result has no rows to join.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    found = counts.select(*keys).limit(MAX_HOT_KEYS + 1).collect()
    if not found:
        return None
    schema = df.select(*keys).schema
    return df.sparkSession.createDataFrame(found if len(found) <= MAX_HOT_KEYS else [], schema)


def into_blocks(
    df: DataFrame, keys: list[str], coarse: Column, max_rows: int = MAX_KEY_ROWS
) -> tuple[DataFrame, bool]:
    """Add ``_block`` and say whether any key was cut.

    ``coarse`` must not decrease along the order of a key (an hour of a timestamp, a range
    of a sequence number). A key within the limit is one block.
    """
    hot = large_keys(df, keys, max_rows)
    if hot is None:
        return df.withColumn(BLOCK, F.lit(0).cast("bigint")), False
    block = coarse.cast("bigint")
    if hot.isEmpty():
        return df.withColumn(BLOCK, block), True
    marked = null_safe_join(df, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys)
    return marked.withColumn(BLOCK, F.when(F.col("_hot"), block).otherwise(F.lit(0))).drop("_hot"), True


def carry_in(
    df: DataFrame,
    keys: list[str],
    summary: dict[str, Column],
    carried: dict[str, Callable[[WindowSpec], Column]],
) -> DataFrame:
    """Add to each row what the earlier blocks of its key amount to; null in the first block.

    ``summary`` is aggregated per (key, block), with partial aggregation before the
    shuffle. ``carried`` is evaluated over the summaries of the earlier blocks, which
    is one slim row per block.
    """
    blocks = df.groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in summary.items()])
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    for name, fn in carried.items():
        blocks = blocks.withColumn(name, fn(earlier))
    return null_safe_join(df, blocks.select(*keys, BLOCK, *carried), [*keys, BLOCK])


def position_in_key(
    df: DataFrame, keys: list[str], order: list[Column], coarse: Column, max_rows: int = MAX_KEY_ROWS
) -> tuple[DataFrame, bool]:
    """Add ``_pos``, the 1-based row number within the key, and say whether any key was cut."""
    rows, cut = into_blocks(df, keys, coarse, max_rows)
    here = F.row_number().over(in_block(keys).orderBy(*order)).cast("bigint")
    if not cut:
        return rows.withColumn("_pos", here).drop(BLOCK), False
    placed = carry_in(
        rows.withColumn("_in", here),
        keys,
        {"_n": F.count(F.lit(1))},
        {"_before": lambda w: F.sum("_n").over(w)},
    )
    return placed.withColumn("_pos", F.coalesce("_before", F.lit(0)) + F.col("_in")).drop("_in", "_before", BLOCK), True


def overlapping_blocks(df: DataFrame, at: Column, width: int, reach: int, cut: bool = True) -> DataFrame:
    """Put each row in block floor(at / width) and copy it to every later block that looks back on it.

    A row at ``a`` is needed by rows up to ``a + reach``. Windows over (key, ``_block``)
    that reach back at most ``reach`` are then exact for rows whose ``_copy`` is false;
    the share of copies is reach / width. With ``cut`` false each key stays one block.
    """
    if not cut:
        return df.withColumn(BLOCK, F.lit(0).cast("bigint")).withColumn(COPY, F.lit(False))
    home = F.floor(at / width)
    last = F.floor((at + reach) / width)
    return (
        df.withColumn("_home", home)
        .withColumn(BLOCK, F.explode(F.sequence(F.col("_home"), last)))
        .withColumn(COPY, F.col(BLOCK) > F.col("_home"))
        .drop("_home")
    )


def originals(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(COPY)).drop(COPY, BLOCK)
