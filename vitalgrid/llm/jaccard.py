"""Exact Jaccard self-join of documents' word shingles by token-combination prefixes, and its link classes.

Sets. A document's set holds the distinct `SHINGLE`-word shingles of its whole lower-cased text (the sequence
itself if it has fewer words) as 64-bit hashes; equal sets are one node, named by a fingerprint of the set.

Order and classes. All shingles are counted over all sets. Those in more than F sets are class 2, those in more
than 32 F class 3; of the rest, those in more than R sets are class 1 and the others class 0. R is the smallest
power of two from 1 on above which at most MOST_SHARED shingles lie, F that from LEAST_FREQUENT on with at most
MOST_FREQUENT, so that the bitmaps that tell map tasks the class (8 MB each, that of R up to 32 MB as shingles
grow in number, see `hash_bitmap`) leave bits clear. Any two sets order their shingles alike: by class, then by
hash. With R = 1 class 0 holds shingles of one set only, which sign nothing: a set whose prefix lies in class 0
is done without a signature. This is what keeps signatures few, so R stays 1 as long as the bitmap allows.

Prefixes. With at most e of a set's shingles missing in the partner, a prefix is long enough once the sum over its
cells of (shingles in the cell - k + 1) exceeds e: then some cell keeps k common shingles, and their combination
is a common signature. Classes 0 and 1 are one cell with k = 1. Classes 2 and 3 have k = 2 and 3 and are divided by hash
into 2**band / 8 cells, so that a cell has few combinations however long the text; band is log2 of the set size,
and a set whose partners may lie in the next band signs for both. Below 16 shingles k is 1 everywhere.
A partner of at least 3/4 the size leaves e = n/4 (probing prefix), one at least as large e = n/7 (indexing
prefix); a pair is a candidate only if the smaller set's signature lies in its indexing prefix.

Hot signatures. Up to SMALL_BUCKET sets with one signature are paired directly. In a larger bucket each set is
paired with LEADERS leaders of about its size; true links unite most of the bucket. Only where sets of different components then
meet in a bucket are all their candidates verified, the members outside the bucket's largest component against
all. Two sets that share a signature are thus either verified or already connected, so no link class is lost and
no bucket is expanded into all pairs.

Verification compares whole sets, of texts that the JVM picks by their row keys. Pairs are gathered in the cells of a grid of node hashes, so that a pair found
in many buckets is verified once and a text goes once to each cell that needs it; no pair is ever a row.

Traffic is packed, one row per (task, slice of the hash space): shingles as the three bytes that the slice leaves open,
sorted signatures as 16-bit differences.

Null and empty texts, and texts without words, have an empty set, no links and their own id as component. A null
id takes part but never names a component unless all of them are null. Repeated rows fall into one class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .words import SPACED, Words, field, mixed, ranges, small_batches, windows
from .work import BITMAP_BITS, ROW, dealt, hash_bitmap, in_bitmap, marked, row_key, rows_of, stored, tasks_of, unpacked

SHINGLE, PERCENT = 5, 75
LEAST_FREQUENT, MOST_FREQUENT = 32, 1 << 24
MOST_SHARED, MOST_BITS = 1 << 28, 28
SMALL_BUCKET, LEADERS = 8, 4
CELL_NODES, CELL_PAIRS, BLOCK = 20_000, 50_000, 1024
CHUNK, MOST_PAIRS = 400_000, 1_000_000
BATCH = 1_500_000  # bytes of text at once
LOW_BITS = 24
ONE = np.uint64(1)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text on end, and the bounds of each text's."""
    words = Words(column, SPACED)
    hashes, first, counts = words.hashes(), words.first, words.counts
    every = windows(hashes, width)
    n_windows = np.maximum(counts - width + 1, 0)
    values = every[ranges(first[:-1], n_windows)] if len(every) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(counts)), n_windows)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = [int(windows(hashes[first[i]:first[i + 1]] + np.uint64(counts[i]), int(counts[i]))[0]) for i in short]
        values = np.concatenate((values, np.array(whole, np.uint64)))
        text = np.concatenate((text, short))
        order = np.argsort(text, kind="stable")
        values, text = values[order], text[order]
    edges = np.searchsorted(text, np.arange(len(counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=len(counts)))))


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set; 0 for an empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    sizes = np.diff(bounds).astype(np.uint64)
    return np.where(sizes > 0, mixed(total[bounds[1:]] - total[bounds[:-1]] + sizes), np.uint64(0))


def errors(n: np.ndarray | int, percent: int):
    """Most shingles a set of n may miss in a partner of at least `percent` % of its size; in one at least as large."""
    probe = n - -(-percent * n // 100)
    index = n - -(-2 * percent * n // (100 + percent))
    return probe, index


def packed(values: np.ndarray) -> bytes:
    """Sorted non-negative integers as 16-bit differences; 65535 adds and goes on."""
    steps = np.diff(values, prepend=0).astype(np.int64)
    more = steps // 65535
    if not more.any():
        return steps.astype(np.uint16).tobytes()
    out = np.full(len(values) + int(more.sum()), 65535, np.uint16)
    out[np.arange(len(values)) + np.cumsum(more)] = steps % 65535
    return out.tobytes()


def unpacked_values(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def part_bits(tasks: int) -> int:
    """Slices of the hash space: at least 4096 and 16 a task."""
    return max(12, (16 * tasks - 1).bit_length())


def _cut(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order, slice and value in it, of 64-bit hashes."""
    short = (hashes >> np.uint64(64 - bits - LOW_BITS)).astype(np.int64)
    order = np.argsort(short)
    short = short[order]
    return order, short >> LOW_BITS, short & ((1 << LOW_BITS) - 1)


def _slices(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(parts):
        return
    edge = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(parts)], strict=True):
        yield int(parts[a]), a, b


def short_slices(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, pa.Array]:
    """Slices of the hash space that have some of the hashes, and these: the three bytes that follow the slice's bits."""
    short = np.sort(hashes >> np.uint64(64 - bits - LOW_BITS))
    parts = (short >> np.uint64(LOW_BITS)).astype(np.int64)
    edge = np.flatnonzero(np.diff(parts, prepend=-1))
    data = np.ascontiguousarray(short.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    bounds = 3 * np.append(edge, len(short)).astype(np.int32)
    return parts[edge], pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def short_values(data: bytes) -> np.ndarray:
    """The sorted values of three bytes each."""
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return np.sort(out.view("<u4")[:, 0])


# ---- sets and counts

def _sets(id_col: str, text_col: str, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col, BATCH):
            values, bounds = shingle_sets(field(batch, text_col), width)
            yield pa.record_batch([field(batch, id_col), field(batch, "key"), pa.array(fingerprints(values, bounds).view(np.int64)), pa.array(np.diff(bounds))], ["id", "key", "node", "n"])
    return run


class _Seen:
    """Passes every set once per task."""

    def __init__(self) -> None:
        self.known: set[int] = set()

    def new(self, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), bool)
        for i, node in enumerate(nodes.tolist()):
            if node and node not in self.known:
                self.known.add(node)
                out[i] = True
        return out


def _distinct_sets(batches: Iterator[pa.RecordBatch], text_col: str, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(values, bounds, nodes) of sets that this task has not had yet."""
    seen = _Seen()
    for batch in small_batches(batches, text_col, BATCH):
        values, bounds = shingle_sets(field(batch, text_col), width)
        nodes = fingerprints(values, bounds)
        new = seen.new(nodes)
        sizes = np.diff(bounds)[new]
        yield values[ranges(bounds[:-1][new], sizes)], np.concatenate(([0], np.cumsum(sizes))), nodes[new]


def _shingles(text_col: str, width: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            parts, data = short_slices(np.concatenate(held), bits)
            held.clear()
            return pa.record_batch([pa.array(parts, pa.int32()), data], ["part", "data"])
        for values, _, _ in _distinct_sets(batches, text_col, width):
            held.append(values)
            size += len(values)
            if size >= CHUNK:
                yield out()
                size = 0
        if held:
            yield out()
    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows sorted by part, one part at a time."""
    current, held = None, []
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != current and held:
                yield current, held
                held = []
            current = part
            held.append(data)
    if held:
        yield current, held


def _frequent(bits: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in _by_part(batches):
            low = short_values(b"".join(data))
            edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            low, n = low[edge].astype(np.int64), np.diff(np.append(edge, len(low)))
            often = n > least
            if often.any():
                short = (np.int64(part) << LOW_BITS | low[often]).astype(np.uint64)
                yield pa.record_batch([pa.array((short << np.uint64(64 - bits - LOW_BITS)).view(np.int64)), pa.array(n[often])], ["hash", "n"])
    return run


def frequent_shingles(texts: DataFrame, text_col: str, width: int) -> DataFrame:
    """(hash, n): shingles of more than one set, counted by the leading bits of their hash."""
    bits = part_bits(tasks_of(texts.sparkSession))
    slices = dealt(texts.select(text_col).mapInArrow(_shingles(text_col, width, bits), "part int, data binary")).sortWithinPartitions("part")
    return stored(slices.mapInArrow(_frequent(bits, 1), "hash long, n long"))


def frequency_floors(frequent: DataFrame, *bounds: tuple[int, int]) -> list[tuple[int, int]]:
    """For each (least, most) the smallest power of two from `least` on with at most `most` shingles above it, and their number."""
    level = F.floor(F.log2(F.col("n") - 1)).cast("int")  # above 2**level
    levels = {r["level"]: r["count"] for r in frequent.groupBy(level.alias("level")).count().collect()}  # at most 64 rows
    out = []
    for least, most in bounds:
        floor = least.bit_length() - 1
        above = lambda: sum(n for k, n in levels.items() if k >= floor)  # noqa: B023, E731
        while above() > most:
            floor += 1
        out.append((1 << floor, above()))
    return out


def bits_for(n: int) -> int:
    """Bits of the bitmap of n hashes: a quarter of them set as far as MOST_BITS allows."""
    return min(MOST_BITS, max(BITMAP_BITS, (4 * n - 1).bit_length()))


# ---- signatures

def band_of(n: int) -> int:
    return int(n).bit_length() - 1


def _prefix(cells: np.ndarray, k: np.ndarray, allowed: int) -> int:
    """Shortest prefix whose cells exceed `allowed`; cells and k are those of the ordered shingles."""
    order = np.argsort(cells, kind="stable")
    sorted_cells = cells[order]
    edge = np.concatenate(([True], sorted_cells[1:] != sorted_cells[:-1]))
    rank = np.arange(len(cells)) - np.maximum.accumulate(np.where(edge, np.arange(len(cells)), 0))
    counts = np.empty(len(cells), bool)
    counts[order] = rank + 1 >= k[order]
    total = np.cumsum(counts)
    at = int(np.searchsorted(total, allowed + 1))
    return min(at + 1, len(cells))


def combinations(values: np.ndarray, cells: np.ndarray, k: int, salt: int, index: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all k-combinations within each cell, and whether each lies in the first `index` positions."""
    order = np.argsort(cells, kind="stable")
    v, c, inside = values[order], cells[order], order < index
    largest = int(np.bincount(np.unique(c, return_inverse=True)[1]).max())
    out, flags = [], []
    for d in range(1, largest):
        same = np.flatnonzero(c[:-d] == c[d:])
        pair = mixed(v[same] + mixed(v[same + d] + np.uint64(salt)))
        flag = inside[same] & inside[same + d]
        if k == 2:
            out.append(pair)
            flags.append(flag)
            continue
        for e in range(d + 1, largest):
            third = same + e
            ok = third < len(c)
            ok[ok] = c[third[ok]] == c[same[ok]]
            out.append(mixed(pair[ok] + mixed(v[third[ok]])))
            flags.append(flag[ok] & inside[third[ok]])
    return (np.concatenate(out), np.concatenate(flags)) if out else (np.zeros(0, np.uint64), np.zeros(0, bool))


def signatures(values: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set (sorted hashes with their classes 0 to 3) and whether each is in the indexing prefix."""
    n = len(values)
    probe, index = errors(n, percent)
    order = np.argsort(classes, kind="stable")
    if classes[order[probe]] <= 1:
        return values[order[:probe + 1]], np.arange(probe + 1) <= index
    v, c = values[order], np.maximum(classes[order].astype(np.int64), 1)
    bands = [band_of(n)]
    if band_of(n * 100 // percent) > bands[0]:
        bands.append(bands[0] + 1)
    out, flags = [], []
    for band in bands:
        k = c if band >= 4 else np.ones(n, np.int64)
        groups = max(1, (1 << band) // 8)
        cells = np.where(k == 1, 0, 1 + 2 * (v % np.uint64(groups)).astype(np.int64) + (c == 3))
        long, short = _prefix(cells, k, probe), _prefix(cells, k, index)
        for width in (1, 2, 3):
            at = np.flatnonzero(k[:long] == width)
            if len(at) < width:
                continue
            if width == 1:
                out.append(v[at])
                flags.append(at < short)
            else:
                inside = np.flatnonzero(at < short)
                sig, flag = combinations(v[at], cells[at], width, 1000 * band + width, len(inside))
                out.append(sig)
                flags.append(flag)
    sig, flag = np.concatenate(out), np.concatenate(flags)
    order = np.lexsort((~flag, sig))
    sig, flag = sig[order], flag[order]
    first = np.concatenate(([True], sig[1:] != sig[:-1]))
    return sig[first], flag[first]


def _signatures(text_col: str, width: int, percent: int, bits: int, bitmaps: list, unique: bool) -> Callable:
    """Packed (signature, set, size, flag); `unique` says that class 0 shingles are in one set only. bitmaps: (bitmap, bits)
    of classes 1, 2 and 3, each of shingles that the one before has, too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            sig, node, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order, parts, low = _cut(sig, bits)
            node, n = node[order], n[order]
            rows = []
            for p, a, b in _slices(parts):
                steps = packed(low[a:b])
                rows.append((p, len(steps).to_bytes(4, "little") + steps + node[a:b].tobytes() + n[a:b].tobytes()))
            held.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "data"])
        for values, bounds, nodes in _distinct_sets(batches, text_col, width):
            classes, at = np.zeros(len(values), np.int8), np.arange(len(values))
            for k, (bitmap, size_) in enumerate(bitmaps, 1):
                at = at[in_bitmap(bitmap.value, values[at], size_)]
                classes[at] = k
            n = np.diff(bounds)
            alone = np.concatenate(([0], np.cumsum(classes == 0)))
            alone = alone[bounds[1:]] - alone[bounds[:-1]]
            # a set whose prefix is all of class 0 signs nothing if these are unique
            for i in np.flatnonzero(alone <= errors(n, percent)[0]) if unique else range(len(nodes)):
                node, a, b = nodes[i], bounds[i], bounds[i + 1]
                sig, flag = signatures(values[a:b], classes[a:b], percent)
                if unique:
                    own = np.isin(sig, values[a:b][classes[a:b] == 0], assume_unique=True)
                    sig, flag = sig[~own], flag[~own]
                held.append((sig, np.full(len(sig), node), (np.uint32(b - a) << np.uint32(1)) | flag.astype(np.uint32)))
                size += len(sig)
                if size >= CHUNK:
                    yield out()
                    size = 0
        if held:
            yield out()
    return run


def _entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = int.from_bytes(data[:4], "little")
    low = unpacked_values(data[4:4 + steps])
    at = 4 + steps
    return low, np.frombuffer(data, np.uint8)[at:at + 8 * len(low)].copy().view(np.uint64), np.frombuffer(data, np.uint8)[at + 8 * len(low):].copy().view(np.uint32)


def cells_of(both: np.ndarray, grid: int) -> np.ndarray:
    """Cell of each pair in a grid of node hashes."""
    row, column = (mixed(both[:, i] ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(grid) for i in (0, 1))
    return (row * np.uint64(grid) + column).astype(np.int64)


def distinct_pairs(both: np.ndarray) -> np.ndarray:
    """The distinct rows of two columns, sorted."""
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return both[np.concatenate(([True], (both[1:] != both[:-1]).any(axis=1)))] if len(both) else both


class _Pairs:
    """Distinct pairs, sorted in each pair, gathered for their cells; memory is bounded by MOST_PAIRS pairs."""

    def __init__(self, grid: int) -> None:
        self.grid, self.held, self.size = grid, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append(np.sort(np.stack((a, b), axis=1), axis=1))
            self.size += len(a)
            if self.size > MOST_PAIRS:
                self.held = [distinct_pairs(np.concatenate(self.held))]
                self.size = len(self.held[0])

    def rows(self) -> list[tuple[int, bytes]]:
        if not self.held:
            return []
        both = distinct_pairs(np.concatenate(self.held))
        self.held, self.size = [], 0
        cell = cells_of(both, self.grid)
        order = np.argsort(cell, kind="stable")
        return [(c, both[order[a:b]].tobytes()) for c, a, b in _slices(cell[order])]


def _buckets(percent: int, grid: int) -> Callable:
    """Candidate pairs of small buckets, leader pairs of large ones, and the distinct large buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, known = _Pairs(grid), set()

        def out() -> pa.RecordBatch:
            rows = pairs.rows()
            return pa.record_batch([pa.array([0] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["kind", "name", "data"])
        for part, data in _by_part(batches):
            low, node, n = (np.concatenate(x) for x in zip(*map(_entries, data), strict=True))
            flag, n = (n & np.uint32(1)).astype(bool), (n >> np.uint32(1)).astype(np.int64)
            order = np.lexsort((node, n, low))
            low, node, n, flag = low[order], node[order], n[order], flag[order]
            new = np.concatenate(([True], (low[1:] != low[:-1]) | (node[1:] != node[:-1]))) if len(low) else np.zeros(0, bool)
            low, node, n, flag = low[new], node[new], n[new], flag[new]
            edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            size = np.diff(np.append(edge, len(low)))
            run_size, run_first = np.repeat(size, size), np.repeat(edge, size)
            small = run_size <= SMALL_BUCKET
            for d in range(1, SMALL_BUCKET):
                x = np.flatnonzero(small[:-d] & (run_first[:-d] == run_first[d:]) & flag[:-d]) if len(low) > d else np.zeros(0, np.int64)
                x = x[100 * n[x] >= percent * n[x + d]]
                pairs.add(node[x], node[x + d])
            for first, m in zip(edge[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist(), strict=True):
                own, sizes, flags = node[first:first + m], n[first:first + m], flag[first:first + m]
                if not flags.any():
                    continue
                # leaders: the least hashes among sets of about one size; the others of that size go with them
                group = (np.log2(sizes) * 5).astype(np.int64)
                for g in np.unique(group):
                    at = np.flatnonzero(group == g)
                    close = np.flatnonzero((group >= g) & (group <= g + 1))
                    for lead in at[np.argsort(mixed(own[at]))[:LEADERS]].tolist():
                        near = close[100 * np.minimum(sizes[close], sizes[lead]) >= percent * np.maximum(sizes[close], sizes[lead])]
                        near = near[near != lead]
                        pairs.add(np.full(len(near), own[lead]), own[near])
                name = int(mixed(np.array([np.sum(mixed(own ^ flags.astype(np.uint64)), dtype=np.uint64)]))[0] >> ONE)
                if name not in known:
                    known.add(name)
                    yield pa.record_batch([pa.array([1], pa.int32()), pa.array([name], pa.int64()), pa.array([own.tobytes() + (sizes.astype(np.uint32) << np.uint32(1) | flags).astype(np.uint32).tobytes()], pa.binary())],
                                          ["kind", "name", "data"])
            if pairs.size > MOST_PAIRS // 2:
                yield out()
        yield out()
    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            m = len(data) // 12
            n = np.frombuffer(data, np.uint32, m, 8 * m)
            yield pa.record_batch([pa.array(np.full(m, bucket, np.int64)), pa.array(np.frombuffer(data, np.int64, m)), pa.array((n >> 1).astype(np.int64)), pa.array((n & 1).astype(bool))],
                                  ["bucket", "node", "n", "flag"])


def _open_pairs(percent: int, grid: int) -> Callable:
    """Pairs of different components in blocks of buckets; rows sorted by (bucket, i, j): node, n, flag, root, minor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, current = _Pairs(grid), [], None

        def done() -> None:
            node, n, flag, root, minor = (np.concatenate(x) for x in zip(*held, strict=True))
            node = node.view(np.uint64)
            rest = np.arange(len(node))
            for i in np.flatnonzero(minor):
                other = rest[(root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))]
                smaller = (n[other] < n[i]) | ((n[other] == n[i]) & (node[other] < node[i]))
                other = other[np.where(smaller, flag[other], flag[i])]
                pairs.add(np.full(len(other), node[i]), node[other])
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 8)]
            for a, b in zip(edge, [*edge[1:], len(keys)], strict=True):
                key = tuple(keys[a].tolist())
                if key != current and held:
                    done()
                    held = []
                current = key
                held.append([c[a:b] for c in columns])
            if pairs.size > MOST_PAIRS // 2:
                rows = pairs.rows()
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["cell", "data"])
        if held:
            done()
        rows = pairs.rows()
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["cell", "data"])
    return run


def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a cell as one row."""
    for cell, data in _by_part(batches):
        both = distinct_pairs(np.concatenate([np.frombuffer(d, np.uint64).reshape(-1, 2) for d in data]))
        yield pa.record_batch([pa.array([cell], pa.int64()), pa.array([both.tobytes()], pa.binary())], ["cell", "data"])


def _cell_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            nodes = np.unique(np.frombuffer(data, np.int64))
            yield pa.record_batch([pa.array(np.full(len(nodes), cell, np.int64)), pa.array(nodes)], ["cell", "node"])


# ---- verification

def _linked(width: int, percent: int) -> Callable:
    """Links of each cell; its texts (kind 0) come before its pairs (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets = None, {}
        for whole in batches:
            for batch in small_batches(iter([whole]), "text", BATCH):
                cells, kinds, nodes, data = (field(batch, c) for c in ("cell", "kind", "node", "data"))
                values, bounds = shingle_sets(field(batch, "text"), width)
                for i, (cell, kind) in enumerate(zip(cells.to_pylist(), kinds.to_pylist(), strict=True)):
                    if cell != current:
                        current, sets = cell, {}
                    if kind == 0:
                        sets[nodes[i].as_py()] = values[bounds[i]:bounds[i + 1]].copy()
                        continue
                    both = np.frombuffer(data[i].as_py(), np.int64).reshape(-1, 2)
                    edge = np.flatnonzero(np.concatenate(([True], both[1:, 0] != both[:-1, 0])))
                    links = []
                    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(both)], strict=True):
                        for start in range(a, b, 256):
                            links.append(_matches(sets, both[start:min(b, start + 256)], percent))
                    found = np.concatenate(links)
                    yield pa.record_batch([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])
    return run


def _matches(sets: dict[int, np.ndarray], both: np.ndarray, percent: int) -> np.ndarray:
    """The pairs of one left node that link."""
    one = sets[int(both[0, 0])]
    others = [sets[int(b)] for b in both[:, 1]]
    sizes = np.array([len(o) for o in others])
    values = np.concatenate(others)
    at = np.searchsorted(one, values)
    same = one[np.minimum(at, len(one) - 1)] == values
    common = np.add.reduceat(same, np.cumsum(sizes) - sizes)
    return both[100 * common >= percent * (len(one) + sizes - common)]


class Join:
    """The state of one self-join: the sets of all documents and the links found so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> None:
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
        self.kind = docs.schema[id_col].dataType.simpleString()
        self.sets = stored(self.texts.mapInArrow(_sets("id", "text", width), f"id {self.kind}, key struct<a:bigint,b:bigint>, node long, n long"))
        self.nodes = self.sets.where("n > 0").groupBy("node").agg(F.min("id").alias("id"))

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """Pairs to verify (cell, data), and the large buckets (bucket, node, n, flag)."""
        frequent = frequent_shingles(self.texts, "text", self.width)
        (rare, shared), (often, _) = frequency_floors(frequent, (1, MOST_SHARED), (LEAST_FREQUENT, MOST_FREQUENT))
        bitmaps = [(hash_bitmap(frequent.where(F.col("n") > floor), "hash", b), b) for floor, b in ((rare, bits_for(shared)), (max(rare, often), BITMAP_BITS), (32 * max(rare, often), BITMAP_BITS))]
        bits = part_bits(tasks_of(self.spark))
        entries = self.texts.select("text").mapInArrow(_signatures("text", self.width, self.percent, bits, bitmaps, rare == 1), "part int, data binary")
        found = stored(dealt(entries).sortWithinPartitions("part").mapInArrow(_buckets(self.percent, self.grid(self.nodes.count())), "kind int, name long, data binary"))
        large = found.where("kind = 1").select(F.col("name").alias("bucket"), "data").dropDuplicates(["bucket"]).mapInArrow(_members, "bucket long, node long, n long, flag boolean")
        return found.where("kind = 0").select(F.col("name").alias("cell"), "data"), large

    def grid(self, nodes: int, pairs: int = 0) -> int:
        """Side of the grid of cells: some cells a task, and few nodes and pairs in a cell."""
        return max(4, math.isqrt(4 * tasks_of(self.spark)) + 1, -(-nodes // CELL_NODES), math.isqrt(pairs // CELL_PAIRS) + 1)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (cell, data) that link, as (a, b). A text goes once to each cell that needs it."""
        pairs = stored(dealt(pairs, "cell").sortWithinPartitions("cell").mapInArrow(_distinct_pairs, "cell long, data binary"))
        needs = stored(pairs.mapInArrow(_cell_nodes, "cell long, node long"))
        # one row's text for each set; other texts stay in the JVM
        keys = stored(self.sets.select("node", "key").join(needs.select("node").distinct(), "node").groupBy("node").agg(F.min("key").alias("key")))
        texts = marked(self.texts.select("key", "text"), keys).where("maybe").select("key", "text").join(keys, "key").select("node", "text").dropDuplicates(["node"])
        nothing, no_text = F.lit(None).cast("binary"), F.lit(None).cast("string")
        routed = needs.join(texts, "node").select("cell", F.lit(0).alias("kind"), "node", "text", nothing.alias("data"))
        both = routed.union(pairs.select("cell", F.lit(1), F.lit(None).cast("long"), no_text, "data"))
        return stored(dealt(both, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_linked(self.width, self.percent), "a long, b long"))

    def open_pairs(self, large: DataFrame, roots: DataFrame) -> DataFrame | None:
        """Candidates (cell, data) of large buckets between different components; None if there are none."""
        members = large.join(roots, "node", "left").select("bucket", "node", "n", "flag", F.coalesce("root", "node").alias("root"))
        counts = members.groupBy("bucket", "root").agg(F.count("*").alias("m"))
        main = counts.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("m"), F.count("*").alias("roots")).where("roots > 1")
        main = stored(main.select("bucket", "main.root", "m", (F.col("m") - F.col("main.m")).alias("minors")).withColumnRenamed("root", "main"))
        size = main.agg(F.sum(F.col("m") * F.col("minors")), F.sum("m")).first()
        if size[0] is None:
            return None
        grid = self.grid(size[1] // 8, size[0])
        # a bucket is worked off in blocks of members (i) times blocks of minor members (j)
        rows = members.join(main, "bucket").withColumn("minor", F.col("root") != F.col("main"))
        side = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK).cast("int"))
        block = lambda c: F.pmod(F.xxhash64("node"), side(c)).cast("int")
        every = rows.select("bucket", block("m").alias("i"), F.explode(F.sequence(F.lit(0), side("minors") - 1)).alias("j"), "node", "n", "flag", "root", F.lit(False).alias("minor"))
        few = rows.where("minor").select("bucket", F.explode(F.sequence(F.lit(0), side("m") - 1)).alias("i"), block("minors").alias("j"), "node", "n", "flag", "root", F.lit(True).alias("minor"))
        blocks = every.union(few)
        blocks = blocks.repartition(tasks_of(self.spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        return blocks.mapInArrow(_open_pairs(self.percent, grid), "cell long, data binary")

    def roots(self) -> DataFrame:
        """(node, root) of the sets that link with another."""
        pairs, large = self.candidates()
        links = self.verified(pairs)
        roots = components(links)
        more = self.open_pairs(large, roots)
        if more is not None:
            extra = self.verified(more)
            if not extra.isEmpty():
                roots = components(links.union(extra))
        return roots

    def classes(self) -> DataFrame:
        """Per document: the id, n_shingles, component_id."""
        named = self.nodes.join(self.roots(), "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
        least = named.groupBy("root").agg(F.min("id").alias("component_id"))
        named = named.join(least, "root").select("node", "component_id")
        return self.sets.join(named, "node", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

    def surplus(self) -> tuple[DataFrame, DataFrame]:
        """Keys of rows to leave out, and keys of rows that stay once though they occur more than once."""
        rows = self.sets.where("n > 0").join(self.roots(), "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct(F.col("id").isNull().alias("no_id"), "id", "key").alias("row"))
        rows = stored(rows.groupBy("root", "row").agg(F.count("*").alias("m")))
        first = rows.groupBy("root").agg(F.min("row").alias("first"))
        rows = rows.join(first, "root").select("row.key", (F.col("row") == F.col("first")).alias("stays"), "m")
        return rows.where("NOT stays").select("key"), rows.where("stays AND m > 1").select("key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: the id, n_shingles and component_id, the smallest id reachable by links of at least `percent` % Jaccard."""
    return Join(docs, id_col, text_col, width, percent).classes().withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each link class: that of the smallest id, a null id last.

    Rows with an empty set all stay. Texts never leave the JVM here: rows that certainly stay are passed on where they
    are read; the others, told by a bitmap of fixed size, are joined with the keys to leave out.
    """
    out, once = Join(docs, id_col, text_col, width, percent).surplus()
    out, once = stored(out.select("key").distinct()), stored(once.select("key").distinct())
    rows = marked(rows_of(docs).withColumn("key", row_key(id_col, text_col, ROW)), out.union(once))
    unsure = rows.where("maybe").join(out, "key", "left_anti").select(ROW, "key")
    single = unsure.join(once, "key", "left_anti").select(ROW)
    repeated = unsure.join(once, "key", "left_semi").dropDuplicates(["key"]).select(ROW)
    return unpacked(rows.where("NOT maybe").select(ROW).union(single).union(repeated))
