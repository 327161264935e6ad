"""Ranked lexical search: hybrid of term-at-a-time and document-at-a-time evaluation over document shards.

Index. One pass over the texts makes shards of documents: their ids, lengths and, for terms that a query may hold (a bitmap
of fixed size tells, so at worst too many are kept), postings with term frequencies. Documents of a shard are numbered in the order of
their ids, so that a tie is settled by the smaller number. Document frequencies, the number of documents and of terms
are sums over the shards.

Search. Queries go to the shards in blocks of about BLOCK_TERMS terms, so a broadcast does not grow with the queries;
another block reads the shards again, not the texts. In a shard a query's shortest lists, up to a quarter of the shard's documents
together, are summed term at a time into accumulators. These then stand as one more sorted list, with bounds
of its own, beside the long lists. The lists are walked document at a time in blocks of SPAN documents: a block whose
bounds (weight times the greatest impact of a list in the block) do not reach the tenth best score so far is skipped; in the others
only documents of lists that the bounds of the rest cannot replace are gathered, and the remaining lists are probed for these alone. The
tenth best score is carried from shard to shard of a task, and starts at the tenth best accumulator. Nothing is skipped that
could equal the tenth best, so results are exact.

A document's weight of a term is w * ((10^9 tf) div (1000 tf + 8 m)), w = floor(1000 ln((2N + 2) / (2 df + 1))), and
m = 100 - B + ((B n N) div L), all in 64-bit integers (B n N in longer ones where it does not fit).

Rows. Null texts have no terms. A null query id takes no part; query rows with one id are one query. Every
document row counts by itself, repeated ones too; null document ids rank last among equal scores. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .words import ALPHANUMERIC, Words, field, small_batches
from .work import hash_bitmap, in_bitmap, stored, tasks_of

TOP, B = 10, 75
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 2_000_000
SPAN = 512
BLOCK_TERMS = 500_000


# ---- index

def term_counts(words: Words, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of the words that `keep` marks, sorted by text and term."""
    hashes, text = words.hashes(), words.text_index()
    if keep is not None and len(hashes):
        at = keep(hashes)
        hashes, text = hashes[at], text[at]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    edge = np.flatnonzero(new)
    return text[edge], hashes[edge], np.diff(np.append(edge, len(hashes)))


def _query_terms(item_col: str, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            text, term, n = term_counts(Words(field(batch, text_col), ALPHANUMERIC))
            yield pa.record_batch([field(batch, item_col).take(pa.array(text)), pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["item", "term", "n"])
    return run


SHARD = "lengths binary, terms binary, counts binary, docs binary, tfs binary, n_docs long, n_terms long"


def _shards(id_col: str, text_col: str, bitmap) -> Callable:
    """One row per shard: ids in ascending order, and each kept term's documents (numbers in that order) and frequencies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bitmap.value
        held: list[tuple] = []
        size = {"docs": 0, "postings": 0, "n_docs": 0, "n_terms": 0}

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            length, doc, term, tf = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            doc = number[doc]
            by = np.lexsort((doc, term))
            doc, term, tf = doc[by], term[by], tf[by]
            edge = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            blobs = [length[order].astype(np.int64), term[edge], np.diff(np.append(edge, len(term))).astype(np.int64), doc.astype(np.uint32), tf.astype(np.uint32)]
            row = pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order))), *(pa.array([b.tobytes()], pa.binary()) for b in blobs),
                                   pa.array([size["n_docs"]], pa.int64()), pa.array([size["n_terms"]], pa.int64())],
                                  ["ids", "lengths", "terms", "counts", "docs", "tfs", "n_docs", "n_terms"])
            held.clear()
            size.update(dict.fromkeys(size, 0))
            return row
        for batch in small_batches(batches, text_col):
            words = Words(field(batch, text_col), ALPHANUMERIC)
            text, term, tf = term_counts(words, lambda h: in_bitmap(table, h))
            kept, doc = np.unique(text, return_inverse=True)
            ids = field(batch, id_col).take(pa.array(kept))
            held.append((ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, words.counts[kept], doc + size["docs"], term, tf))
            size["docs"] += len(kept)
            size["postings"] += len(term)
            size["n_docs"] += int((words.counts > 0).sum())
            size["n_terms"] += len(words)
            if size["docs"] >= SHARD_DOCS or size["postings"] >= SHARD_POSTINGS:
                yield out()
        if held:
            yield out()
    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.record_batch([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["term", "n"])


# ---- search

def norms(lengths: np.ndarray, n_docs: int, n_terms: int, b: int) -> np.ndarray:
    """m of each document."""
    longest = int(lengths.max()) if len(lengths) else 0
    if b * longest * n_docs < 2 ** 63:
        return 100 - b + (b * lengths * n_docs) // n_terms
    return np.array([100 - b + b * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


class Shard:
    """Posting lists with impacts and the greatest impact of each span of documents."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int, b: int) -> None:
        self.size, self.terms, self.docs = len(lengths), terms, docs.astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        tf = tfs.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norms(lengths, n_docs, n_terms, b)[self.docs])
        self.spans = -(-self.size // SPAN)
        # (list, span) runs of postings
        span = np.repeat(np.arange(len(terms)), counts) * self.spans + self.docs // SPAN
        self.edge = np.flatnonzero(np.concatenate(([True], span[1:] != span[:-1]))) if len(span) else np.zeros(0, np.int64)
        self.run = span[self.edge]
        self.peak = np.maximum.reduceat(self.impact, self.edge) if len(span) else np.zeros(0, np.int64)
        self.edge = np.append(self.edge, len(span))
        self.most = np.maximum.reduceat(self.impact, self.first[:-1]) if len(terms) else np.zeros(0, np.int64)

    def list(self, t: int, weight: int) -> List:
        a, b = self.first[t], self.first[t + 1]
        i, j = np.searchsorted(self.run, (t * self.spans, (t + 1) * self.spans))
        return List(self.docs[a:b], self.impact[a:b] * weight, self.run[i:j] - t * self.spans, self.edge[i:j + 1] - a, self.peak[i:j] * weight, int(self.most[t]) * weight)


class List:
    """Sorted documents with scores; `spans` that hold some, their bounds in the list and greatest scores."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, spans: np.ndarray, edge: np.ndarray, peak: np.ndarray, most: int) -> None:
        self.docs, self.scores, self.spans, self.edge, self.peak, self.most = docs, scores, spans, edge, peak, most

    @classmethod
    def summed(cls, lists: list[List]) -> List:
        """Term-at-a-time accumulators of several lists as one list."""
        docs, scores = np.concatenate([x.docs for x in lists]), np.concatenate([x.scores for x in lists])
        order = np.argsort(docs, kind="stable")
        docs, scores = docs[order], scores[order]
        edge = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        docs, scores = docs[edge], np.add.reduceat(scores, edge)
        span = docs // SPAN
        edge = np.flatnonzero(np.concatenate(([True], span[1:] != span[:-1])))
        peak = np.maximum.reduceat(scores, edge)
        return cls(docs, scores, span[edge], np.append(edge, len(docs)), peak, int(peak.max()))

    def within(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.spans, span)
        if i == len(self.spans) or self.spans[i] != span:
            return self.docs[:0], self.scores[:0]
        return self.docs[self.edge[i]:self.edge[i + 1]], self.scores[self.edge[i]:self.edge[i + 1]]


def best_of(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's k best (document, score) for a query's lists, among those with at least `floor` and above 0."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = max(floor, 1)
    if not len(terms) or int((shard.most[terms] * weights).sum()) < floor:
        return nothing
    lists = sorted((shard.list(int(t), int(w)) for t, w in zip(terms, weights, strict=True)), key=lambda x: len(x.docs))
    room, short = shard.size // 4, 0
    while short < len(lists) and len(lists[short].docs) <= room:
        room -= len(lists[short].docs)
        short += 1
    if short > 1:
        lists = [List.summed(lists[:short]), *lists[short:]]
    if short and len(lists[0].docs) >= k:
        floor = max(floor, int(np.partition(lists[0].scores, -k)[-k]))
    lists.sort(key=lambda x: x.most)
    bound = np.zeros((len(lists), shard.spans), np.int64)
    for i, x in enumerate(lists):
        bound[i, x.spans] = x.peak
    until = np.cumsum(bound, axis=0)  # what the weakest lists can give together
    found, scores = nothing
    sums = np.zeros(SPAN, np.int64)
    for span in np.flatnonzero(until[-1] >= floor).tolist():
        if until[-1, span] < floor:
            continue
        needed = int(np.searchsorted(until[:, span], floor))  # lists before this one cannot reach the floor alone
        base, seen = span * SPAN, []
        for x in lists[needed:]:
            docs, values = x.within(span)
            sums[docs - base] += values
            seen.append(docs)
        docs = np.unique(np.concatenate(seen)) if len(seen) > 1 else seen[0]
        total = sums[docs - base]
        for d in seen:
            sums[d - base] = 0
        for i in range(needed - 1, -1, -1):
            more = total + until[i, span] >= floor
            docs, total = docs[more], total[more]
            if not len(docs):
                break
            own, values = lists[i].within(span)
            if len(own):
                at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                total = total + np.where(own[at] == docs, values[at], 0)
        more = total >= floor
        if more.any():
            found, scores = np.concatenate((found, docs[more])), np.concatenate((scores, total[more]))
            if len(found) > k:
                order = np.lexsort((found, -scores))[:k]
                found, scores = found[order], scores[order]
            if len(found) == k:
                floor = max(floor, int(scores.min()))
    order = np.lexsort((found, -scores))
    return found[order], scores[order]


def _searched(shared, k: int, n_docs: int, n_terms: int, b: int, kind: pa.DataType, id_kind: pa.DataType) -> Callable:
    """The k best documents of a task's shards for each query of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, first, vocabulary, term, weight = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                blobs = [np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in enumerate((np.int64, np.uint64, np.int64, np.uint32, np.uint32), 1)]
                shard = Shard(*blobs, n_docs, n_terms, b)
                at = np.minimum(np.searchsorted(shard.terms, vocabulary), len(shard.terms) - 1) if len(shard.terms) else np.zeros(len(vocabulary), np.int64)
                here = shard.terms[at] == vocabulary if len(shard.terms) else np.zeros(len(vocabulary), bool)
                for q in range(len(items)):
                    own = slice(first[q], first[q + 1])
                    there = here[term[own]]
                    full = len(best[q]) == k
                    docs, scores = best_of(shard, at[term[own][there]], weight[own][there], k, -best[q][-1][0] if full else 1)
                    if len(docs):
                        names = ids.take(pa.array(docs)).to_pylist()
                        best[q] = sorted(best[q] + [(-s, n is None, n) for s, n in zip(scores.tolist(), names, strict=True)], key=lambda x: x[:2] if x[1] else x)[:k]
        rows = [(items[q], -s, n) for q, found in enumerate(best) for s, _, n in found]
        yield pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], id_kind)], ["item", "score", "doc"])
    return run


def rank(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP, b: int = B) -> DataFrame:
    """Per query its `k` best documents with a score above 0: item_col, rank, id_col, score."""
    spark = docs.sparkSession
    kind, id_kind = queries.schema[item_col].dataType, docs.schema[id_col].dataType
    asked = queries.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("item IS NOT NULL")
    terms = stored(asked.mapInArrow(_query_terms("item", "text"), f"item {kind.simpleString()}, term long, n long").groupBy("item", "term").agg(F.sum("n").alias("n")))
    bitmap = hash_bitmap(terms.select("term").distinct(), "term")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shards = stored(texts.mapInArrow(_shards("id", "text", bitmap), f"ids array<{id_kind.simpleString()}>, {SHARD}"))
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counts = shards.select("terms", "counts").mapInArrow(_document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    weighed = terms.join(counts, "term").withColumn("w", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))))
    weighed = stored(weighed.select("item", "term", (F.col("w") * F.col("n")).alias("weight")).where("weight > 0"))
    n_blocks = max(1, -(-weighed.count() // BLOCK_TERMS))
    found = None
    for block in range(n_blocks):
        part = weighed.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).orderBy("item").toArrow()  # about BLOCK_TERMS rows
        name = part.column("item").combine_chunks().dictionary_encode()
        term, weight = part.column("term").to_numpy().view(np.uint64), part.column("weight").to_numpy()
        vocabulary, at = np.unique(term, return_inverse=True)
        first = np.concatenate(([0], np.cumsum(np.bincount(name.indices.to_numpy(zero_copy_only=False), minlength=len(name.dictionary)))))
        shared = spark.sparkContext.broadcast((name.dictionary.to_pylist(), first, vocabulary, at, weight))
        search = _searched(shared, k, n_docs, max(n_terms, 1), b, to_arrow_type(kind), to_arrow_type(id_kind))
        own = shards.select("ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(search, f"item {kind.simpleString()}, score long, doc {id_kind.simpleString()}")
        if n_blocks > 1:
            own = stored(own)
            shared.destroy()
        found = own if found is None else found.union(own)
    # at most k rows a task and query: the best of a salt first, then of the query
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    salted = found.withColumn("salt", F.spark_partition_id() % max(1, int(tasks_of(spark) ** 0.5)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
