"""Whole Arrow batches of texts as byte arrays: words, rolling hashes, slices of bounded size.

The Python stages of this subpackage work on the bytes of many texts at once. A batch is cut
into slices of ``SLICE_BYTES`` so that a worker's memory follows the slice (or the one longest
text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# White space of all contracts here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# First bytes of code points.
LEAD = (np.arange(256) & 0xC0) != 0x80


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` for runs of rows; null counts as empty.

    ``offsets`` has one entry more than rows and starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any byte spans from one running sum.

    The hash of a span is the sum of a random value per byte times a power of an odd number,
    modulo 2**64; odd numbers have inverses, so a span's value does not depend on its place.
    With ``fold`` the letters A-Z count as a-z.
    """

    def __init__(self, seed: int, fold: bool = False):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            self.table[65:91] = self.table[97:123]
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                a = np.full(n, base % (1 << 64), np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])


def words_of(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without bytes of ``apart``, and where each text's words begin among them."""
    n = len(data)
    inner = np.zeros(n + 1, bool)
    inner[1:] = ~apart[data]
    # A text's end ends its last word.
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inner[1:] & (~inner[:-1] | cut[:-1]))
    after = np.ones(n, bool)
    after[:-1] = ~inner[2:] | cut[1:-1]
    ends = np.flatnonzero(inner[1:] & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, for rows that hold ``bounds[i]:bounds[i + 1]``."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(bounds: np.ndarray, size: int) -> np.ndarray:
    """First items of all runs of ``size`` items that stay within a row."""
    first = np.arange(bounds[-1])
    last = np.repeat(bounds[1:], np.diff(bounds))
    return first[first + size <= last]


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of an item array within each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does its key occur more than once, and does it follow an equal one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    later[order[1:][same]] = True
    return many, later
