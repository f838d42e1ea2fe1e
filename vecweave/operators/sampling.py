"""Splitting ordered rows by size and drawing exact samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecweave.functions.binding import once
from vecweave.plans.blocks import BLOCK, MAX_KEY_ROWS, carry_in, in_block, large_keys, null_safe_join
from vecweave.sources.files import opened

DEFAULT_MAX_BYTES = 199_000_000
# A cell covers this many full parts; a super-cell this many cells.
_FAN = 64
# Samples up to this size are taken as a plain top-n.
SMALL_SAMPLE = 10_000
# Bytes of a part that are held before they are written.
WRITE_BYTES = 1 << 20
# What Spark writes as a number in the name of a partition's folder, control characters besides.
_ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


def _line_bytes(df: DataFrame, key: str, order: str, line: str) -> DataFrame:
    return df.select(key, order, (F.octet_length(line) + 1).cast("bigint").alias("_bytes"))


def _equal_blocks(lines: DataFrame, order: str, block_rows: int) -> Column:
    """The number of the block of each line. The cuts come from a quantile sketch: as many as there are blocks."""
    n = lines.count()
    blocks = max(1, -(-n // block_rows))
    if blocks == 1:
        return F.lit(0).cast("bigint")
    # One literal: an expression for each share would be slower to plan than all the rest.
    shares = F.split(F.lit(",".join(repr(i / blocks) for i in range(1, blocks))), ",").cast("array<double>")
    accuracy = max(10_000, 10 * blocks)
    cuts = np.unique(np.array(lines.agg(F.percentile_approx(order, shares, accuracy).alias("c")).first()["c"]))

    @F.arrow_udf("bigint")
    def block(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, values.to_numpy(zero_copy_only=False), "right").astype(np.int64))

    return once(block)(order)


def byte_offsets(lines: DataFrame, key: str, order: str, block_rows: int) -> DataFrame:
    """``key, order, _start, _end``: the bytes each line takes in its key's file.

    The blocks of the running sum are ranges of ``order`` with about ``block_rows`` lines each, cut
    at quantiles, so it does not matter how its values are spread.
    """
    rows = lines.withColumn(BLOCK, _equal_blocks(lines, order, block_rows))
    here = in_block([key]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = carry_in(
        rows.withColumn("_sum", F.sum("_bytes").over(here)),
        [key],
        {"_total": F.sum("_bytes")},
        {"_before": lambda w: F.sum("_total").over(w)},
    )
    end = F.coalesce("_before", F.lit(0)) + F.col("_sum")
    return summed.select(key, order, (end - F.col("_bytes")).alias("_start"), end.alias("_end"))


def _next_starts(start: np.ndarray, end: np.ndarray, max_bytes: int) -> np.ndarray:
    """For a part that starts at row i: the row that starts the part after it."""
    fits = np.searchsorted(end, start + max_bytes, side="right")
    return np.maximum(fits, np.arange(len(start)) + 1)


def _enter(ends: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """First possible part start that the part filled up to ``limit`` has no room for."""
    return np.searchsorted(ends, limit, side="right")


def split_by_bytes(
    df: DataFrame,
    max_bytes: int = DEFAULT_MAX_BYTES,
    key: str = "source",
    order: str = "doc_id",
    line: str = "text",
    max_rows: int = MAX_KEY_ROWS,
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Add ``part``: consecutive lines of a key, each part at most ``max_bytes``.

    A new part begins where the next line would not fit; a line larger than a part
    stands alone. Only (key, order, bytes) are grouped, never the lines. (key, order)
    must be unique.

    A key of up to ``max_rows`` lines is packed in one pass. If some key is larger, no
    task sees a whole key, and the result is still that of one pass: lines are grouped
    in cells of a fixed byte range, each cell works out where it is left for every line
    that may be its first part start, those small tables are chained over cells and
    super-cells, and each cell then numbers its lines from its true entry.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be at least 1")
    lines = _line_bytes(df, key, order, line)
    if large_keys(lines, [key], max_rows) is None:
        numbered = _pack_small_keys(lines, key, order, max_bytes)
    else:
        numbered = _pack_in_cells(lines, key, order, max_bytes, block_rows)
    return null_safe_join(df, numbered, [key, order], "inner")


def _folder(name: str, value: str | None) -> str:
    """A partition's folder as Spark names it, so that reading finds the value again."""
    return f"{name}=" + ("".join(f"%{ord(c):02X}" if c < " " or c in _ESCAPED else c for c in value) if value else "__HIVE_DEFAULT_PARTITION__")


def write_parts(parted: DataFrame, path: str, key: str = "source", order: str = "doc_id", line: str = "text") -> None:
    """One text file per key and part under ``path``, its lines in order. A part is bounded in bytes, so one task writes it.

    The folders are those of ``partitionBy(key, "part")``, but the tasks write the files themselves, as ``read_files``
    opens them: a committer that renames each of so many small files takes far longer than the rest.
    """
    system, root, _ = opened(path)
    if system.get_file_info(root).type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} is there already")
    system.create_dir(root)
    dealt = parted.select(F.col(key).cast("string").alias("key"), "part", F.col(order).alias("order"), F.coalesce(F.col(line), F.lit("")).alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, _ = opened(path)
        name, n, held, out = f"part-{TaskContext.get().partitionId():05d}", 0, None, None

        def place(n: int) -> tuple[str, str]:
            folder = f"{root}/{_folder(key, held[0])}/{_folder('part', str(held[1]))}"
            # Readers leave out names that begin so, until the file is whole.
            return f"{folder}/_{name}-{n}", f"{folder}/{name}-{n}.txt"

        for batch in batches:
            for at, value in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if out is None or at != held:
                    if out is not None:
                        out.close()
                        system.move(*place(n))
                        n += 1
                    held = at
                    system.create_dir(place(n)[0].rsplit("/", 1)[0])
                    out = system.open_output_stream(place(n)[0], buffer_size=WRITE_BYTES)
                out.write((value + "\n").encode())
        if out is not None:
            out.close()
            system.move(*place(n))
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "order").drop("order")
    dealt.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    system.open_output_stream(f"{root}/_SUCCESS").close()


def _part_numbers(start: np.ndarray, end: np.ndarray, max_bytes: int, first: int, parts: int) -> np.ndarray:
    """Part of each line, when ``first`` is the first line that starts one and ``parts`` came before."""
    following = _next_starts(start, end, max_bytes)
    starts = []
    while first < len(start):
        starts.append(first)
        first = int(following[first])
    return parts + np.searchsorted(np.array(starts, dtype=np.int64), np.arange(len(start)), "right")


def _pack_small_keys(lines: DataFrame, key: str, order: str, max_bytes: int) -> DataFrame:
    types = dict(lines.dtypes)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        end = np.cumsum(pdf["_bytes"].to_numpy())
        part = _part_numbers(end - pdf["_bytes"].to_numpy(), end, max_bytes, 0, 0)
        return pdf[[key, order]].assign(part=part.astype(np.int64))

    return lines.groupBy(key).applyInPandas(pack, f"`{key}` {types[key]}, `{order}` {types[order]}, part bigint")


def _pack_in_cells(lines: DataFrame, key: str, order: str, max_bytes: int, block_rows: int) -> DataFrame:
    width = max_bytes * _FAN
    placed = byte_offsets(lines, key, order, block_rows).withColumn("_cell", F.floor(F.col("_start") / width))
    key_type = lines.schema[key].dataType.simpleString()
    order_type = lines.schema[order].dataType.simpleString()
    chain_type = f"`{key}` {key_type}, _cell bigint, _ends bigint, _limit bigint, _parts bigint"
    entry_type = f"`{key}` {key_type}, _cell bigint, _limit bigint, _parts bigint"

    def cell_chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_start")
        start, end = pdf["_start"].to_numpy(), pdf["_end"].to_numpy()
        following = _next_starts(start, end, max_bytes)
        n = len(start)
        first_byte = int(pdf["_cell"].iloc[0]) * width
        firsts = max(1, int(np.searchsorted(start, first_byte + max_bytes)))
        at = np.arange(firsts)
        parts = np.ones(firsts, dtype=np.int64)
        while True:
            on = following[at] < n
            if not on.any():
                break
            at[on] = following[at[on]]
            parts[on] += 1
        return pd.DataFrame(
            {
                key: pdf[key].iloc[0],
                "_cell": pdf["_cell"].iloc[0],
                "_ends": end[:firsts],
                "_limit": start[at] + max_bytes,
                "_parts": parts,
            }
        )

    def by_cell(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        pdf = pdf.sort_values(["_cell", "_ends"])
        return [
            (int(c), g["_ends"].to_numpy(), g["_limit"].to_numpy(), g["_parts"].to_numpy())
            for c, g in pdf.groupby("_cell", sort=True)
        ]

    def pass_through(cell: tuple, limit: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, ends, limits, counts = cell
        i = _enter(ends, limit)
        starts_here = i < len(ends)
        j = np.minimum(i, len(ends) - 1)
        return np.where(starts_here, limits[j], limit), parts + np.where(starts_here, counts[j], 0)

    def super_chain(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = by_cell(pdf)
        _, ends, limit, parts = cells[0]
        for cell in cells[1:]:
            limit, parts = pass_through(cell, limit, parts)
        return pd.DataFrame(
            {key: pdf[key].iloc[0], "_cell": cells[0][0] // _FAN, "_ends": ends, "_limit": limit, "_parts": parts}
        )

    def walk(pdf: pd.DataFrame, limit: int, parts: int) -> pd.DataFrame:
        at, count, rows = np.array([limit]), np.array([parts]), []
        for cell in by_cell(pdf):
            rows.append((pdf[key].iloc[0], cell[0], int(at[0]), int(count[0])))
            at, count = pass_through(cell, at, count)
        return pd.DataFrame(rows, columns=[key, "_cell", "_limit", "_parts"])

    def walk_super(cells: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        cells = cells.drop(columns="_super")
        return walk(cells, int(entry["_limit"].iloc[0]), int(entry["_parts"].iloc[0]))

    def number(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_start")
        start, end = rows["_start"].to_numpy(), rows["_end"].to_numpy()
        first = int(_enter(end, np.array([int(entry["_limit"].iloc[0])]))[0])
        part = _part_numbers(start, end, max_bytes, first, int(entry["_parts"].iloc[0]))
        return pd.DataFrame({key: rows[key].to_numpy(), order: rows[order].to_numpy(), "part": part.astype(np.int64)})

    chains = placed.groupBy(key, "_cell").applyInPandas(cell_chain, chain_type)
    grouped = chains.withColumn("_super", F.floor(F.col("_cell") / _FAN))
    supers = grouped.groupBy(key, "_super").applyInPandas(lambda p: super_chain(p), chain_type)
    # One row per super-cell and possible entry: a 4096th of the parts at most.
    super_entries = (
        supers.groupBy(key)
        .applyInPandas(lambda p: walk(p, -1, 0), entry_type)
        .withColumnRenamed("_cell", "_super")
    )
    entries = (
        grouped.groupBy(key, "_super").cogroup(super_entries.groupBy(key, "_super")).applyInPandas(walk_super, entry_type)
    )
    return (
        placed.groupBy(key, "_cell")
        .cogroup(entries.groupBy(key, "_cell"))
        .applyInPandas(number, f"`{key}` {key_type}, `{order}` {order_type}, part bigint")
    )


def sample_order(id_column: Column, seed: int) -> Column:
    return F.md5(F.concat(id_column.cast("string"), F.lit(f":{seed}")))


def sample_exact(
    df: DataFrame, n: int, seed: int = 42, id_column: str = "id", small: int = SMALL_SAMPLE
) -> DataFrame:
    """Exactly n rows, the same ones for the same seed; an error if there are fewer.

    Rows are ordered by a hash of their id. A large sample finds the hash bucket that
    holds the n-th row from bucket counts and sorts only that bucket.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    available = df.count()
    if n > available:
        raise ValueError(f"requested {n} rows, but only {available} are available")
    ordered = df.withColumn("_order", sample_order(F.col(id_column), seed))
    by = [F.col("_order"), F.col(id_column)]
    if n == 0:
        return df.limit(0)
    if n <= small:
        return ordered.orderBy(*by).limit(n).drop("_order")
    return _large_sample(ordered, by, n).drop("_order")


def _large_sample(ordered: DataFrame, by: list[Column], n: int) -> DataFrame:
    bucketed = ordered.withColumn("_bucket", F.conv(F.substring("_order", 1, 4), 16, 10).cast("int"))
    # At most 65,536 rows.
    counts = bucketed.groupBy("_bucket").count()
    upto = F.sum("count").over(Window.orderBy("_bucket"))
    cut = (
        counts.withColumn("_upto", upto)
        .filter(F.col("_upto") >= n)
        .agg(F.min(F.struct("_bucket", (n - (F.col("_upto") - F.col("count"))).alias("_left"))).alias("_cut"))
        .first()["_cut"]
    )
    whole = bucketed.filter(F.col("_bucket") < cut["_bucket"])
    rest = bucketed.filter(F.col("_bucket") == cut["_bucket"]).orderBy(*by).limit(cut["_left"])
    return whole.unionByName(rest).drop("_bucket")
