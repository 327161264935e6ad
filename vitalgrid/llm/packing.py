"""Packing of tokenised documents into sequences of fixed capacity by bounded-space online best-fit.

Every task packs the pieces of its input partition with a fixed number of open sequences ("bins"). A bitset has
one bit for each free space some open bin has; the best fit of a piece is the lowest bit at or above its length.
A piece without a fit opens a bin; when that is one too many, the fullest closes for good. The place of a piece
is final when it is chosen, so a task holds only its open bins and the pieces it looks ahead: of the next LOOK_AHEAD ones the
longest are placed first (0.6 % fewer sequences than as they come, on 10,000 documents). Full pieces are sequences by themselves.

The tokenised pieces (a few numbers each) are written to a table first, so that texts are encoded once and a
packing task, reading many small files, sees far more pieces than fit into the open bins.

Null and empty texts are one piece with the end id alone. Ties between bins with the same space go to the one
that reached it last. Repeated rows and repeated or null ids are packed like any other row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder
from .words import field, small_batches
from .work import stored

CAPACITY, OPEN_BINS, END_ID, LOOK_AHEAD = 4096, 2048, 1, 10_000
PIECES = "piece int, start long, length long, ids_crc32 long"
PLACES = "sequence_id long, offset long"


class BestFit:
    """Open bins by free space."""

    def __init__(self, capacity: int, open_bins: int, first_id: int) -> None:
        self.capacity, self.limit, self.next_id = capacity, open_bins, first_id
        self.free = 0  # bit s: some open bin has s free
        self.bins: dict[int, list[int]] = {}
        self.n_open = 0

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        chosen = stack.pop()
        if not stack:
            del self.bins[space]
            self.free ^= 1 << space
        self.n_open -= 1
        return chosen

    def _put(self, space: int, name: int) -> None:
        if space:
            self.bins.setdefault(space, []).append(name)
            self.free |= 1 << space
            self.n_open += 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to `capacity` tokens."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            name = self._take(space)
        else:
            space, name = self.capacity, self.next_id
            self.next_id += 1
            if length < space and self.n_open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        self._put(space - length, name)
        return name, self.capacity - space


def _pieces(id_col: str, text_col: str, capacity: int, end_id: int, path: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, step = encoder(path), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in small_batches(batches, text_col):
            rows: list[list[int]] = [[], [], [], [], []]
            for i, text in enumerate(field(batch, text_col).to_pylist()):
                ids = tokens.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    for column, value in zip(rows, (i, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.record_batch([field(batch, id_col).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])],
                                  [id_col, "piece", "start", "length", "ids_crc32"])
        tokens.forget()
    return run


def _looked_ahead(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in order, `size` at a time whatever the session's batches are."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= size:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from whole.slice(0, size).combine_chunks().to_batches()
            held, rows = whole.slice(size).to_batches(), rows - size
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _packed(capacity: int, open_bins: int, look_ahead: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        bins = BestFit(capacity, open_bins, (context.partitionId() if context else 0) << 40)
        for batch in _looked_ahead(batches, look_ahead):
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            order = np.argsort(-lengths, kind="stable")
            places = [bins.place(n) for n in lengths[order].tolist()]
            out = np.empty((len(places), 2), np.int64)
            out[order] = np.array(places, np.int64).reshape(-1, 2)
            yield pa.record_batch([*batch.columns, pa.array(out[:, 0]), pa.array(out[:, 1])], [*batch.schema.names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         end_id: int = END_ID, vocabulary: str | None = None, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, sequence_id, offset.

    The next `look_ahead` pieces of a task are placed in the order of their lengths, longest first; 1 places them as they come.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col), F.col(text_col))
    pieces = stored(texts.mapInArrow(_pieces(id_col, text_col, capacity, end_id, vocabulary), f"`{id_col}` {kind}, {PIECES}"))
    return pieces.mapInArrow(_packed(capacity, open_bins, look_ahead), f"`{id_col}` {kind}, {PIECES}, {PLACES}")
