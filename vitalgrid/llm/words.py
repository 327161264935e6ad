"""Words of whole texts as numpy arrays: byte classes, word bounds, 64-bit word hashes.

Words are maximal runs of bytes of one class. All word classes used here hold every byte above 0x7F and leave
out some ASCII bytes, so runs of bytes and runs of code points are the same thing in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 3
INVERSE = pow(BASE, -1, 1 << 64)


def word_class(delimiters: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte that belongs to a word; `delimiters` are closed ranges of bytes that do not."""
    inside = np.ones(256, bool)
    for low, high in delimiters:
        inside[low:high + 1] = False
    return inside


#: `[^\x20\x09-\x0D]+`
SPACED = word_class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing)
ALPHANUMERIC = word_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(7)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest slice so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_powers = _Powers()
SLICE = 1 << 18


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the bounds of each (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of the batch, or of the struct column `row` that carries the input."""
    at = batch.schema.get_field_index("row")
    if at >= 0 and pa.types.is_struct(batch.column(at).type):
        return batch.column(at).field(name)
    return batch.column(batch.schema.get_field_index(name))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text, or one row."""
    for batch in batches:
        _, bounds = texts_of(field(batch, column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """Words of a list of texts: `starts` and `ends` in `data`, and `first[i]:first[i + 1]` are those of text i."""

    def __init__(self, column: pa.Array, inside: np.ndarray = SPACED) -> None:
        data, bounds = texts_of(column)
        self.data, self.bounds = LOWER[data], bounds
        word = inside[self.data]
        before = np.empty(len(word), bool)
        if len(word):
            before[0] = False
            before[1:] = word[:-1]
            cut = bounds[:-1][bounds[:-1] < len(word)]
            before[cut] = False
            self.starts = np.flatnonzero(word & ~before)
            after = np.empty(len(word), bool)
            after[-1] = False
            after[:-1] = word[1:]
            cut = bounds[1:][bounds[1:] > 0] - 1
            after[cut] = False
            self.ends = np.flatnonzero(word & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, bounds).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out, i, n = np.empty(len(self), np.uint64), 0, len(self)
        while i < n:
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + SLICE, "right")))
            size = int(self.ends[j - 1] - base)
            _powers.need(size)
            total = np.empty(size + 1, np.uint64)
            total[0] = 0
            np.cumsum(BYTE_VALUE[self.data[base:base + size]] * _powers.up[:size], out=total[1:])
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = (total[e] - total[s]) * _powers.down[s]
            i = j
        return mixed(out)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` values from each position on; the last width - 1 positions have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + n]
    return mixed(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] values, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + shift
