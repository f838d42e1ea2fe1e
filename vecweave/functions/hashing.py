"""Deterministic text vectors from md5, row by row and without a shuffle."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecweave.functions.binding import let, once
from vecweave.functions.text import tokens

_HALF = float(2**31)
# Counts held at once while a batch is turned into vectors: rows x dimensions.
_MAX_COUNTS = 8_000_000


def hash32(text: Column) -> Column:
    """The first 8 hex digits of md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def mock_vector(text: Column, dim: int) -> Column:
    """Pseudo-random vector in [-1, 1) that depends only on the text.

    The text is digested once; the components come from digests of that short seed.
    """
    return let(
        F.md5(text),
        lambda seed: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: hash32(F.concat(seed, F.lit(":"), i)) / F.lit(_HALF) - F.lit(1.0),
        ),
    )


def token_hashes(words: pa.Array) -> np.ndarray:
    """The hash of each token; every distinct token of the batch is digested once."""
    coded = words.dictionary_encode()
    distinct = [int(md5(w.encode()).hexdigest()[:8], 16) for w in coded.dictionary.to_pylist()]
    return np.array(distinct, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def signed_counts(hashes: np.ndarray, starts: np.ndarray, dim: int) -> np.ndarray:
    """Signed hashed counts per row: token hash h adds +1 or -1 at position h mod dim.

    Row i has the hashes ``starts[i]:starts[i+1]``.
    """
    rows = len(starts) - 1
    row = np.repeat(np.arange(rows), np.diff(starts))
    part = hashes[starts[0] : starts[-1]]
    sign = 1.0 - 2.0 * ((part // dim) % 2)
    return np.bincount(row * dim + part % dim, weights=sign, minlength=rows * dim).reshape(rows, dim)


def _offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a list column, with null lists empty."""
    filled = column.fill_null([]) if column.null_count else column
    return filled.offsets.to_numpy()


def hashing_vector(text: Column, dim: int) -> Column:
    """Unit-length token-count vector; null for a text without tokens or with counts that cancel out.

    Tokens are made natively; the counting is one numpy pass per Arrow batch.
    """

    @F.arrow_udf("array<double>")
    def vectors(words: pa.Array) -> pa.Array:
        lists = words.fill_null([]) if words.null_count else words
        starts = _offsets(lists)
        hashes = token_hashes(lists.values)
        step = max(1, _MAX_COUNTS // dim)
        out = []
        for s in range(0, len(lists), step):
            counts = signed_counts(hashes, starts[s : s + step + 1], dim)
            length = np.sqrt((counts * counts).sum(axis=1))
            unit = counts / np.where(length > 0, length, 1.0)[:, None]
            ends = np.arange(len(unit) + 1, dtype=np.int32) * dim
            mask = pa.array(length == 0)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array((unit + 0.0).ravel()), mask=mask))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return once(vectors)(tokens(text))


def adjacent_distances(sentence_list: Column, dim: int) -> Column:
    """Cosine distance of each sentence of a row to the next, over hashed token counts.

    Counts are whole numbers, so the sums are exact. A sentence without a direction has
    similarity 0 to its neighbours.
    """

    @F.arrow_udf("array<double>")
    def distances(documents: pa.Array) -> pa.Array:
        docs = documents.fill_null([]) if documents.null_count else documents
        doc_starts = docs.offsets.to_numpy()
        sents = docs.values
        sent_starts = sents.offsets.to_numpy()
        hashes = token_hashes(sents.values)
        total = len(sents)
        gap = np.ones(max(total - 1, 0))
        step = max(1, _MAX_COUNTS // dim)
        for s in range(0, total - 1, step):
            # One sentence more than the step, so that each pair is seen once.
            counts = signed_counts(hashes, sent_starts[s : min(s + step, total - 1) + 2], dim)
            square = (counts * counts).sum(axis=1)
            scale = np.sqrt(square[:-1] * square[1:])
            dot = (counts[:-1] * counts[1:]).sum(axis=1)
            gap[s : s + len(dot)] = 1.0 - np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
        keep = np.ones(len(gap), dtype=bool)
        # A pair that spans two documents is no pair.
        seams = doc_starts[1:-1] - 1
        keep[seams[(seams >= 0) & (seams < len(gap))]] = False
        sizes = np.maximum(np.diff(doc_starts) - 1, 0)
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(gap[keep]))

    return once(distances)(F.transform(sentence_list, tokens))
