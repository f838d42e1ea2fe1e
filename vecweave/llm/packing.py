"""Bounded-space online packing of token lists into sequences.

Each partition packs its documents as they come, with ``OPEN`` open windows: a piece goes
where it leaves the least room. If it fits nowhere the fullest window is emitted, and if that
one lacks more than ``SLACK`` tokens it is first filled with a part of the piece. What is
open at a partition's end is few; those leftovers are merged over groups of partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.llm.bpe import Encoder
from vecweave.llm.components import stored

LENGTH, OPEN, SLACK = 1024, 16, 8
END_ID = 0
# Leftovers of so many partitions are merged in one task: at most GROUP * OPEN windows.
GROUP = 64

Piece = tuple[int, int, int]  # document, start, length


class Packer:
    """Online best fit with a bounded number of open windows; ``add`` returns what it emits."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN, slack: int = SLACK):
        self.length, self.windows, self.slack = length, windows, slack
        self.open: list[tuple[int, list]] = []  # (room, pieces), least room first

    def add(self, document, size: int) -> Iterator[list]:
        start = 0
        while size - start >= self.length:
            yield [(document, start, self.length)]
            start += self.length
        while start < size:
            need = size - start
            at = bisect_left(self.open, need, key=lambda w: w[0])
            if at < len(self.open):
                room, pieces = self.open.pop(at)
            elif len(self.open) < self.windows:
                room, pieces = self.length, []
            else:
                room, pieces = self.open.pop(0)
                if room > self.slack:
                    need = room
                else:
                    yield pieces
                    room, pieces = self.length, []
            pieces.append((document, start, need))
            start += need
            if room == need:
                yield pieces
            else:
                insort(self.open, (room - need, pieces), key=lambda w: w[0])


_PIECES = "doc_id {0}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, part int"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]


def pack(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, windows: int = OPEN) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and then id 0, so a null or empty text is one token. Repeated rows
    are packed each. Documents are packed where they are read, without a shuffle; the pieces
    (no texts, no ids) are written once to the shared folder, and only leftovers meet again.
    ``sequence_id`` is not dense. Other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer = Encoder(path), Packer(length, windows)
        number = part << 36
        held: dict[int, tuple] = {}  # documents with pieces that are not emitted yet
        next_doc = 0

        def rows_of(sequences: list[list], leftover: bool) -> pa.RecordBatch:
            nonlocal number
            out = []
            for pieces in sequences:
                offset = 0
                for doc, start, size in pieces:
                    doc_id, ids, count = held[doc]
                    crc = zlib.crc32(ids[start : start + size].tobytes())
                    out.append((doc_id, start, size, crc, len(ids), number, offset, part if leftover else None))
                    offset += size
                    if count == size:
                        del held[doc]
                    else:
                        held[doc] = (doc_id, ids, count - size)
                number += 1
            columns = list(zip(*out)) or [()] * len(_NAMES)
            types = [id_type, *[pa.int64()] * 6, pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            doc_ids = batch.column(0).to_pylist()
            for first, end, ids, bounds in encoder.column(batch.column(1)):
                emitted = []
                for k in range(end - first):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], END_ID).astype("<u4")
                    held[next_doc] = (doc_ids[first + k], own, len(own))
                    emitted += packer.add(next_doc, len(own))
                    next_doc += 1
                yield rows_of(emitted, False)
        yield rows_of([pieces for _, pieces in packer.open], True)

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = stored(rows.mapInArrow(run, _PIECES.format(kind)), "pieces")
    merged = pieces.filter("part IS NOT NULL").withColumn("_g", (F.col("part") / GROUP).cast("int"))
    merged = merged.groupBy("_g").applyInArrow(lambda t: _merge(t, length), _PIECES.format(kind))
    return pieces.filter("part IS NULL").unionByName(merged).drop("part")


def _merge(table: pa.Table, length: int) -> pa.Table:
    """Best fit of all pieces of some partitions' leftovers, longest first, none cut."""
    table = table.select(_NAMES).sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
    sizes = table["length"].to_pylist()
    base = (1 << 62) + min(table["part"].to_pylist()) // GROUP * (1 << 36)
    rooms: list[tuple[int, int]] = []
    sequence, offset, count = [], [], 0
    for size in sizes:
        at = bisect_left(rooms, (size, -1))
        room, number = rooms.pop(at) if at < len(rooms) else (length, count)
        count += number == count
        sequence.append(base + number)
        offset.append(length - room)
        if room > size:
            insort(rooms, (room - size, number))
    for name, values in (("sequence_id", sequence), ("offset", offset)):
        table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
    return table
