"""Benchmark decontamination by a prefix-filtered join of item windows with whole documents.

A window is `width` consecutive words of an item (a shorter item is one window). All words of a window must
occur, so its one rarest word is a sufficient prefix. Per block of benchmark windows:

1. all words of the block are counted over all documents; that is the rarity order;
2. each distinct window is indexed under its rarest word with the place of that word in it;
3. a document word found in the index names a possible start; the start and the length must fit into the
   document (positional and length bounds), then the word hashes and at last the bytes are compared.

Blocks are at most BLOCK_BYTES of benchmark text (longer items are cut into pieces that overlap by width - 1
words), so what a task holds does not grow with the benchmark. Blocks are worked off one after another in one
pass over the documents and their hits are united.

Nulls and texts without words have no words and no hits. A null item id takes no part. Repeated document rows
each get their own result row; repeated item ids count once. Without items nothing is contaminated.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALPHANUMERIC, Words, field, ranges, small_batches
from .work import KEY, ROW, flat, row_key, row_schema, rows_of, rows_without, stored

WIDTH = 10
#: Benchmark text held by a task at once.
BLOCK_BYTES = 8_000_000
PIECE_WORDS = 50_000
RESULTS = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"


def _pieces(id_col: str, text_col: str, width: int) -> Callable:
    """Items as pieces of at most PIECE_WORDS words, joined by blanks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            ids, words = field(batch, id_col).to_pylist(), Words(field(batch, text_col), ALPHANUMERIC)
            out: list[tuple[str, str]] = []
            for i, name in enumerate(ids):
                own = range(int(words.first[i]), int(words.first[i + 1]))
                for start in range(0, max(1, len(own) - width + 1), PIECE_WORDS):
                    part = own[start:start + PIECE_WORDS + width - 1]
                    if len(part) and name is not None:
                        out.append((name, b" ".join(words.word(k) for k in part).decode()))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["item", "words"])
    return run


class Block:
    """Distinct windows of some items, indexed by their rarest word."""

    def __init__(self, rows: list[tuple[str, str]], width: int) -> None:
        items: dict[bytes, set[str]] = defaultdict(set)
        for name, text in rows:
            words = text.encode().split(b" ")
            for k in range(max(1, len(words) - width + 1)):
                items[b" ".join(words[k:k + width])].add(name)
        self.texts = sorted(items)
        self.items = [sorted(items[t]) for t in self.texts]
        column = Words(pa.array([t.decode() for t in self.texts], pa.string()), ALPHANUMERIC)
        self.widths, hashes = column.counts, column.hashes()
        self.table = np.zeros((len(self.texts), width), np.uint64)
        inside = np.arange(width)[None, :] < self.widths[:, None]
        self.table[inside] = hashes
        self.inside = inside
        self.vocabulary = np.unique(hashes)

    def index(self, counts: np.ndarray) -> None:
        """counts: of each word of the vocabulary, over all documents."""
        seen = counts[np.searchsorted(self.vocabulary, self.table).clip(0, len(counts) - 1)]
        # ties by hash, so that equal windows of other items choose the same word
        order = np.lexsort((self.table, np.where(self.inside, seen, np.iinfo(np.int64).max)), axis=1)
        place = order[:, 0]
        prefix = self.table[np.arange(len(place)), place]
        by = np.argsort(prefix, kind="stable")
        self.place = place[by]
        self.window = by
        self.prefixes, self.first = np.unique(prefix[by], return_index=True)
        self.first = np.append(self.first, len(by))
        self.coarse = coarse(self.prefixes)


def coarse(values: np.ndarray) -> np.ndarray:
    """A table over the top 16 bits, to pass over most other hashes quickly."""
    out = np.zeros(1 << 16, bool)
    out[(values >> np.uint64(48)).astype(np.int64)] = True
    return out


def known(values: np.ndarray, table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `hashes` of the sorted `values`, and which value each is."""
    at = np.flatnonzero(table[(hashes >> np.uint64(48)).astype(np.int64)])
    which = np.searchsorted(values, hashes[at]).clip(0, max(0, len(values) - 1))
    same = values[which] == hashes[at] if len(values) else np.zeros(len(at), bool)
    return at[same], which[same]


def _counts(text_col: str, shared) -> Callable:
    """Occurrences of the vocabulary's words in one partition of the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value
        table, total = coarse(values), np.zeros(len(values), np.int64)
        for batch in small_batches(batches, text_col):
            _, which = known(values, table, Words(field(batch, text_col), ALPHANUMERIC).hashes())
            total += np.bincount(which, minlength=len(values))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["word", "n"])
    return run


CHUNK = 1_000_000


def _hits(block: Block, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word positions) and windows of all occurrences."""
    at, which = known(block.prefixes, block.coarse, hashes)
    of_text = words.text_index()[at]
    starts, windows = [], []
    sizes = np.diff(block.first)[which]
    edges = np.concatenate(([0], np.cumsum(sizes)))
    i = 0
    while i < len(at):  # candidates in pieces of about CHUNK, however frequent a prefix word is
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + CHUNK, "right")) - 1)
        entry = ranges(block.first[which[i:j]], sizes[i:j])
        window = block.window[entry]
        text = np.repeat(of_text[i:j], sizes[i:j])
        start = np.repeat(at[i:j], sizes[i:j]) - block.place[entry]
        fits = (start >= words.first[text]) & (start + block.widths[window] <= words.first[text + 1])
        start, window = start[fits], window[fits]
        for k in range(block.table.shape[1]):
            inside = block.widths[window] > k
            same = ~inside | (hashes[np.minimum(start + k, len(hashes) - 1)] == block.table[window, k])
            start, window = start[same], window[same]
        starts.append(start)
        windows.append(window)
        i = j
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    window = np.concatenate(windows) if windows else np.zeros(0, np.int64)
    same = [b" ".join(words.word(s + k) for k in range(int(block.widths[w]))) == block.texts[w] for s, w in zip(start.tolist(), window.tolist(), strict=True)]
    same = np.array(same, bool)
    return start[same], window[same]


def _found(text_col: str, blocks: list, carried: str = ROW) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            words = Words(field(batch, text_col), ALPHANUMERIC)
            hashes = words.hashes()
            depth = np.zeros(len(words) + 1, np.int32)
            items: dict[int, set[str]] = defaultdict(set)
            for shared in blocks:
                block = shared.value
                start, window = _hits(block, words, hashes)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + block.widths[window], -1)
                text = np.searchsorted(words.first, start, "right") - 1
                for t, w in zip(text.tolist(), window.tolist(), strict=True):
                    items[t].update(block.items[w])
                if len(blocks) > 1:
                    shared.unpersist_local()
            hit = np.concatenate(([0], np.cumsum(np.cumsum(depth[:-1]) > 0)))
            n_hit = hit[words.first[1:]] - hit[words.first[:-1]]
            names = [sorted(items[i]) if i in items else [] for i in range(batch.num_rows)]
            yield pa.record_batch([
                batch.column(batch.schema.get_field_index(carried)), pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array(n_hit > 0, pa.bool_())],
                [carried, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])
    return run


class _Local:
    """A broadcast that a task can let go of before it takes the next."""

    def __init__(self, shared) -> None:
        self.shared = shared

    @property
    def value(self) -> Block:
        return self.shared.value

    def unpersist_local(self) -> None:
        self.shared.__dict__.pop("_value", None)


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, width: int) -> list:
    """The benchmark's windows in blocks of about BLOCK_BYTES, indexed by the rarest word of each."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL")
    pieces = items.mapInArrow(_pieces("item", "text", width), "item string, words string")
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = -(-size // BLOCK_BYTES)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, n_blocks))))
    texts = docs.select(text_col)
    blocks = []
    for b in range(n_blocks):
        block = Block([(r["item"], r["words"]) for r in pieces.where(F.col("block") == b).select("item", "words").distinct().collect()], width)  # about BLOCK_BYTES
        vocabulary = spark.sparkContext.broadcast(block.vocabulary)
        seen = texts.mapInArrow(_counts(text_col, vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most the block's words
        counts = np.zeros(max(1, len(block.vocabulary)), np.int64)
        for r in seen:
            counts[r["word"]] = r["n"]
        block.index(counts)
        blocks.append(_Local(spark.sparkContext.broadcast(block)))
    return blocks


def contamination_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                       width: int = WIDTH) -> DataFrame:
    """The documents as `row` with the result columns beside it."""
    blocks, rows = _blocks(docs, benchmark, text_col, item_col, item_text, width), rows_of(docs)
    return rows.mapInArrow(_found(text_col, blocks), row_schema(rows, RESULTS))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                         item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents without a benchmark window, with all their columns. Only keys come back from the scan."""
    blocks = _blocks(docs, benchmark, text_col, item_col, item_text, width)
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = texts.mapInArrow(_found("text", blocks, "key"), f"{KEY}, {RESULTS}")
    return rows_without(docs, stored(found.where("contaminated").select("key").distinct()), id_col, text_col)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                       width: int = WIDTH) -> DataFrame:
    """Per document: n_words, n_hit (words inside occurring windows), n_items, items, items_sha256, contaminated."""
    return flat(contamination_rows(docs, benchmark, text_col, item_col, item_text, width))
