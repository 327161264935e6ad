"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes. ROTATIONS orthogonal rotations are learned on at most SAMPLE vectors (those with the least hash of their id)
by iterative quantisation; the signs of a rotated vector are its bits, so a code has ROTATIONS times as many bits
as the vector has components. Vectors of unequal length get one more component that makes their lengths equal
(queries get 0 there), which turns the inner product into an angle.

Index. Every vector is indexed, in shards of about SHARD rows. A shard has one table per byte of the code. With
r = bytes * s + a, a code within Hamming distance r of the query differs from it in at most s bits in one of the
first a + 1 bytes, or in at most s - 1 in one of the others (pigeonhole), so probing each table with the byte
values that near retrieves every code within r. The lists of rows are bitmaps, and those of all values near a
given one are united when the shard is built, so a query reads one bitmap per table. What lies within r is
reranked by the inner product of the original vectors in double precision.

Radius. r is the least radius that covers TARGET of the true neighbours of queries among the sample; a larger
corpus has nearer neighbours, so the sample errs on the safe side. A query that finds fewer than k candidates in
a shard has the whole shard scanned, so that no result is short.

Queries go to the shards in blocks of QUERY_BLOCK rows; per (block, shard) only k results per query go on.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; nor
do vectors whose length differs from the most common one. Equal scores go to the smaller id. Repeated ids are
separate candidates; a query never finds a row of its own id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import dealt, stored

SAMPLE, ROTATIONS, TARGET, SHARD, QUERY_BLOCK = 4096, 4, 0.98, 4_096, 512
#: Differing bits of every pair of bytes.
DISTANCE = np.array([[(a ^ b).bit_count() for b in range(256)] for a in range(256)], np.uint8)


def quantisation(vectors: np.ndarray, seed: int, rounds: int = 20) -> np.ndarray:
    """A rotation that brings the vectors close to the corners of a cube."""
    d = vectors.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        corners = np.sign(vectors @ turn)
        left, _, right = np.linalg.svd(corners.T @ vectors)
        turn = right.T @ left.T
    return turn


class Coder:
    """Learned codes and the radius that goes with them."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        self.longest = float(np.sqrt(np.max(np.sum(sample * sample, axis=1)))) if len(sample) else 1.0
        self.dim = sample.shape[1] if len(sample) else 0
        data = self.lifted(sample)
        self.turns = [quantisation(data, seed) for seed in range(ROTATIONS)] if len(sample) else []
        self.radius = self._radius(sample, k) if len(sample) > k + 1 else 8 * self.bytes

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = self.longest ** 2 - np.sum(vectors * vectors, axis=1)
        return np.column_stack((vectors, np.sqrt(np.maximum(rest, 0.0))))

    @property
    def bytes(self) -> int:
        return len(self.turns) * -(-(self.dim + 1) // 8)

    def codes(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        data = np.column_stack((vectors, np.zeros(len(vectors)))) if queries else self.lifted(vectors)
        return np.concatenate([np.packbits(data @ turn > 0, axis=1) for turn in self.turns], axis=1) if self.turns else np.zeros((len(vectors), 0), np.uint8)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        queries = sample[:256]
        product = queries @ sample.T
        np.fill_diagonal(product, -np.inf)
        near = np.argpartition(-product, k - 1, axis=1)[:, :k]
        mine, theirs = self.codes(queries, True), self.codes(sample, False)
        away = np.array([DISTANCE[mine[i], theirs[near[i]]].sum(axis=1, dtype=np.int64) for i in range(len(queries))])
        return int(np.quantile(away, TARGET, method="higher"))


class Shard:
    """One table per code byte: for each value of the byte, a bitmap of the rows whose byte is near enough to it."""

    def __init__(self, coder: Coder, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.coder, self.ids, self.vectors = coder, ids, vectors
        codes = coder.codes(vectors, False)
        self.words = as_words(codes) if coder.bytes else codes
        least, more = divmod(coder.radius, max(1, coder.bytes))
        # all bytes further away than allowed would add up to more than the radius
        self.tables = [self._table(codes[:, j], least if j <= more else least - 1) for j in range(coder.bytes)]

    def _table(self, column: np.ndarray, radius: int) -> np.ndarray:
        lists = np.zeros((256, -(-len(column) // 8) * 8), bool)
        lists[column, np.arange(len(column))] = True
        lists = np.packbits(lists, axis=1)
        near = np.zeros_like(lists)
        for step in range(256):
            if step.bit_count() <= radius:
                near |= lists[np.arange(256) ^ step]
        return near

    def within(self, code: np.ndarray) -> np.ndarray:
        """Rows whose code is within the radius of the query's."""
        if not len(code) or not len(self.ids):
            return np.arange(len(self.ids))
        found = self.tables[0][code[0]].copy()
        for table, byte in zip(self.tables[1:], code[1:].tolist(), strict=True):
            found |= table[byte]
        rows = np.flatnonzero(np.unpackbits(found))
        away = np.bitwise_count(self.words[rows] ^ as_words(code[None, :])).sum(axis=1, dtype=np.int64)
        return rows[away <= self.coder.radius]

    def search(self, own: int, vector: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.within(code)
        rows = rows[self.ids[rows] != own]
        if len(rows) < k:
            rows = np.flatnonzero(self.ids != own)
        scores = (self.vectors[rows] * vector).sum(axis=1)
        if len(rows) > k:
            some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[some], scores[some]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def as_words(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


def _blob(parts: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def _groups(key: str) -> Callable:
    """Rows of one partition as (key, ids and vectors) in blobs of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
            column = batch.column(batch.schema.get_field_index("vector"))
            if not len(keys):
                continue
            vectors = column.flatten().to_numpy().reshape(len(keys), -1)
            rows = []
            for value in np.unique(keys):
                at = np.flatnonzero(keys == value)
                for a in range(0, len(at), QUERY_BLOCK):
                    some = at[a:a + QUERY_BLOCK]
                    rows.append((int(value), len(some), _blob([ids[some], vectors[some]])))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "n", "data"])
    return run


def _opened(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, offset=8 * n).reshape(n, -1)


def _searched(k: int, shared) -> Callable:
    """Rows of a shard (queries = 0) first, then query blocks; k results per query and shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: Coder = shared.value
        current, held, shard = None, [], None
        for batch in batches:
            for part, kind, block, n, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != current:
                    current, held, shard = part, [], None
                if kind == 0:
                    held.append(_opened(n, data))
                    continue
                if shard is None:
                    ids = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
                    vectors = np.concatenate([h[1] for h in held]) if held else np.zeros((0, coder.dim))
                    shard, held = Shard(coder, ids, vectors), []
                names, queries = _opened(n, data)
                codes = coder.codes(queries, True)
                out = [shard.search(int(q), queries[i], codes[i], k) for i, q in enumerate(names)]
                counts = np.array([len(o[0]) for o in out], np.int64)
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([n], pa.int32()), pa.array([_blob([names, counts, *(o[0] for o in out), *(o[1] for o in out)])], pa.binary())], ["part", "n", "data"])
    return run


def _merged(k: int) -> Callable:
    """The k best of a query block over all shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best = None, []

        def out() -> pa.RecordBatch:
            query, ids, scores = (np.concatenate(x) for x in zip(*best, strict=True))
            order = np.lexsort((ids, -scores, query))
            query, ids, scores = query[order], ids[order], scores[order]
            edge = np.concatenate(([True], query[1:] != query[:-1]))
            rank = np.arange(len(query)) - np.maximum.accumulate(np.where(edge, np.arange(len(query)), 0)) + 1
            keep = rank <= k
            return pa.record_batch([pa.array(query[keep]), pa.array(rank[keep].astype(np.int32)), pa.array(ids[keep]), pa.array(scores[keep])], ["query_id", "rank", "vec_id", "score"])
        for batch in batches:
            for part, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != current and best:
                    yield out()
                    best = []
                current = part
                names, counts = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n)
                m = int(counts.sum())
                best.append((np.repeat(names, counts), np.frombuffer(data, np.int64, m, 16 * n), np.frombuffer(data, np.float64, m, 16 * n + 8 * m)))
                if len(best) > 64:  # at most k of each query are worth keeping
                    merged = out()
                    best = [tuple(merged.column(i).to_numpy() for i in (0, 2, 3))]
        if best:
            yield out()
    return run


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): vectors in double precision that can take part."""
    vector = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query; `is_query` may use the column `id`."""
    spark = rows.sparkSession
    vectors = usable(rows, id_col, vector_col)
    sizes = vectors.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, total = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (0, 0)
    vectors = vectors.where(F.size("vector") == dim)
    sample = np.array([r["vector"] for r in vectors.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).collect()], float).reshape(-1, dim) if dim else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(Coder(sample, k))
    n_shards, n_queries = max(1, -(-total // SHARD)), vectors.where(is_query).count()
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    key = F.xxhash64("id", "vector")
    blobs = "part int, n int, data binary"
    shards = vectors.select(F.pmod(key, F.lit(n_shards)).cast("int").alias("key"), "id", "vector").mapInArrow(_groups("key"), blobs)
    queries = stored(vectors.where(is_query).select(F.pmod(F.shiftrightunsigned(key, 20), F.lit(n_blocks)).cast("int").alias("key"), "id", "vector").mapInArrow(_groups("key"), blobs))
    copies = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    work = (shards.select("part", F.lit(0).alias("kind"), F.lit(0).alias("block"), "n", "data")
            .union(copies.select(F.col("shard").alias("part"), F.lit(1), F.col("part"), "n", "data")))
    found = dealt(work).sortWithinPartitions("part", "kind").mapInArrow(_searched(k, shared), blobs)
    return dealt(found).sortWithinPartitions("part").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")
