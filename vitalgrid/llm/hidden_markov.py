"""A hidden Markov language model over words, trained by Baum-Welch counts that are summed across partitions.

Tokens are lower-cased words and one end token per text. A latent state emits the class of a token and the class
emits the word: P(text) = P(classes | states) * product of P(word | class). Classes follow from the word alone
(the end; words of up to four bytes by their hash; longer ones by their last three bytes), so emissions have a
fixed size. P(word | class) = (c + 0.5) / (N_class + 0.5 * (V_class + 1)) with counts over all training texts.

Counts of words. Every text's distinct tokens go, sorted and packed, to the slice of the hash space they fall in;
there the counts are complete and each text's share of sum(log10(c + 0.5)) is sent back, keyed by its chunk of
texts. No vocabulary is ever held whole.

Training. The states start from a grouping of frequent classes by how they occur together in training texts.
Each Baum-Welch round is one pass: texts are cut into runs of SEGMENT tokens (later runs start from the state
shares), scaled forward and backward recursions give expected counts per partition, and Spark sums them.

Scoring. The scaled forward recursion runs over the whole text, so the likelihood is exact.

Null texts are empty: their only token is the end. Without training texts all counts are 0. Repeated rows count as
often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard import _slices, part_bits
from .words import SPACED, Words, field, mixed, small_batches
from .work import dealt, fold, stored, tasks_of

CLASS_BITS = 10
CLASSES, STATES, ROUNDS, SEGMENT, SEEDS = 1 << CLASS_BITS, 8, 4, 128, 96
CHUNK, HELD = 2_000_000, 4_000_000
END = np.uint64(0xA5A5_1234_9876_5400)


class Tokens:
    """Token values (hash with the class in its low bits) of each text, the end included."""

    def __init__(self, column: pa.Array) -> None:
        words = Words(column, SPACED)
        hashes, n = words.hashes(), len(words.first) - 1
        last = np.zeros(len(words), np.uint64)
        for k in (1, 2, 3):
            at = np.maximum(words.ends - k, words.starts)
            last = last * np.uint64(257) + words.data[at].astype(np.uint64)
        half = CLASSES // 2
        short = words.ends - words.starts <= 4
        classes = np.where(short, mixed(hashes) % np.uint64(half - 1) + np.uint64(1), np.uint64(half) + mixed(last) % np.uint64(half))
        self.values = np.empty(len(words) + n, np.uint64)
        self.values[np.arange(len(words)) + words.text_index()] = hashes >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS) | classes
        self.first = words.first + np.arange(n + 1)
        self.values[self.first[1:] - 1] = END
        self.n = n

    def classes(self) -> np.ndarray:
        return (self.values & np.uint64(CLASSES - 1)).astype(np.int64)


# ---- counts of words

def _entries(text_col: str, bits: int) -> Callable:
    """Packed distinct tokens of chunks of texts, one row per slice; and the keys of each chunk's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 24
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        keys: list[np.ndarray] = []
        size = docs = 0

        def out() -> pa.RecordBatch:
            nonlocal size, docs, number
            value, ref, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(value, kind="stable")
            value, ref, tf = value[order], ref[order], tf[order]
            rows = [(p, 0, number, _blob(value[a:b], ref[a:b], tf[a:b])) for p, a, b in _slices((value >> np.uint64(64 - bits)).astype(np.int64))]
            rows.append((number % (1 << bits), 1, number, np.concatenate(keys).tobytes()))
            held.clear()
            keys.clear()
            size = docs = 0
            number += 1
            return _rows(rows)
        for batch in small_batches(batches, text_col, 2_000_000):
            tokens = Tokens(field(batch, text_col))
            learn = field(batch, "learn").to_numpy(zero_copy_only=False).astype(np.uint32)
            names = field(batch, "key").to_numpy()
            for i in range(tokens.n):
                value, tf = np.unique(tokens.values[tokens.first[i]:tokens.first[i + 1]], return_counts=True)
                held.append((value, np.full(len(value), docs, np.uint16), tf.astype(np.uint32) << np.uint32(1) | learn[i]))
                keys.append(names[i:i + 1])
                size += len(value)
                docs += 1
                if size >= CHUNK or docs == 65_536:
                    yield out()
        if held:
            yield out()
    return run


def _blob(*parts: np.ndarray) -> bytes:
    return b"".join([len(parts[0]).to_bytes(4, "little"), *(np.ascontiguousarray(p).tobytes() for p in parts)])


def _opened(data: bytes, *types: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(data[at:at + size], t))
        at += size
    return out


ROWS = "part int, kind int, chunk long, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "kind", "chunk", "data"])


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete counts of a slice; kind 0: sums per text of a chunk, 1: keys of a chunk, 2: totals per class."""
    total, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    n_held = 0

    def flush() -> pa.RecordBatch:
        nonlocal n_held
        rows = []
        for chunk, (logs, known) in sums.items():
            at = np.flatnonzero(logs != 0)
            rows.append((0, 0, chunk, _blob(at.astype(np.uint16), logs[at], known[at])))
        sums.clear()
        n_held = 0
        return _rows(rows)

    def slice_done(held: list[tuple[int, bytes]]) -> None:
        nonlocal n_held
        parts = [_opened(data, np.uint64, np.uint16, np.uint32) for _, data in held]
        value = np.concatenate([p[0] for p in parts])
        tf = np.concatenate([p[2] for p in parts])
        learn, tf = (tf & np.uint32(1)).astype(np.float64), (tf >> np.uint32(1)).astype(np.float64)
        distinct_values, which = np.unique(value, return_inverse=True)
        count = np.bincount(which, tf * learn, len(distinct_values))
        classes = (distinct_values & np.uint64(CLASSES - 1)).astype(np.int64)
        total[:] += np.bincount(classes, count, CLASSES)
        distinct[:] += np.bincount(classes, count > 0, CLASSES)
        logs, known = tf * np.log10(count + 0.5)[which], tf * (count > 0)[which]
        at = 0
        for (chunk, _), (_, ref, _) in zip(held, parts, strict=True):
            if chunk not in sums:
                sums[chunk] = np.zeros(65_536), np.zeros(65_536, np.uint32)
            high = int(ref.max()) + 1
            have = sums[chunk]
            n_held += high
            np.add.at(have[0], ref, logs[at:at + len(ref)])
            np.add.at(have[1], ref, known[at:at + len(ref)].astype(np.uint32))
            at += len(ref)
    current, held = None, []
    for batch in batches:
        for part, kind, chunk, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == 1:
                yield _rows([(0, 1, chunk, data)])
                continue
            if part != current and held:
                slice_done(held)
                held = []
                if len(sums) > 100:
                    yield flush()
            current = part
            held.append((chunk, data))
    if held:
        slice_done(held)
    if sums:
        yield flush()
    yield _rows([(0, 2, 0, _blob(total, distinct))])


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one chunk from all slices."""
    def done(keys: np.ndarray, logs: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys), pa.array(logs[:len(keys)]), pa.array(known[:len(keys)])], ["key", "logs", "n_known"])
    current, keys, logs, known = None, None, None, None
    for batch in batches:
        for chunk, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if chunk != current:
                if current is not None:
                    yield done(keys, logs, known)
                current, keys, logs, known = chunk, np.zeros(0, np.int64), np.zeros(65_536), np.zeros(65_536, np.int64)
            if kind == 1:
                keys = np.frombuffer(data, np.int64)
            else:
                ref, some, n = _opened(data, np.uint16, np.float64, np.uint32)
                logs[ref] += some
                known[ref] += n
    if current is not None:
        yield done(keys, logs, known)


# ---- the latent chain

def _together(text_col: str) -> Callable:
    """Class counts, and in how many texts two of the commonest short classes of the partition's texts meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, meet = np.zeros(CLASSES), {}
        for batch in small_batches(batches, text_col, 2_000_000):
            tokens = Tokens(field(batch, text_col))
            classes = tokens.classes()
            counts += np.bincount(classes, minlength=CLASSES)
            for i in range(tokens.n):
                own = np.bincount(classes[tokens.first[i]:tokens.first[i + 1]], minlength=CLASSES)
                # the words a text uses most stand for what kind of text it is
                top = np.sort(np.argsort(-own[1:], kind="stable")[:12] + 1)
                top = top[own[top] > 0]
                for pair in (top[:, None] * CLASSES + top).ravel().tolist():
                    meet[pair] = meet.get(pair, 0) + 1
        slots = [*range(CLASSES), *(CLASSES + p for p in meet)]
        yield pa.record_batch([pa.array(slots, pa.int64()), pa.array([*counts.tolist(), *map(float, meet.values())], pa.float64())], ["slot", "value"])
    return run


class Chain:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move = start / start.sum(), move / move.sum(axis=1, keepdims=True)
        self.emit = emit / emit.sum(axis=1, keepdims=True)
        self.by_class = np.ascontiguousarray(self.emit.T)
        self.shares = np.full(len(self.start), 1 / len(self.start))
        for _ in range(200):
            self.shares = self.shares @ self.move

    @classmethod
    def seeded(cls, counts: np.ndarray, meet: dict[tuple[int, int], float]) -> Chain:
        """States from groups of classes that occur in the same texts."""
        alone = np.array([meet.get((c, c), 0.0) for c in range(CLASSES)])
        seeds = np.argsort(-alone, kind="stable")[:SEEDS]
        seeds = seeds[alone[seeds] > 0]
        table = np.array([[meet.get((int(a), int(b)), 0.0) for b in seeds] for a in seeds]).reshape(len(seeds), len(seeds))
        group = _grouped(np.log1p(table), STATES)
        emit = np.tile((counts + 0.5) / STATES, (STATES, 1)) * np.random.default_rng(3).uniform(0.8, 1.2, (STATES, CLASSES))
        for c, g in zip(seeds, group, strict=True):
            emit[:, c] *= 0.2
            emit[g, c] += (counts[c] + 0.5) * 0.8
        return cls(np.ones(STATES), np.eye(STATES) * STATES + 1.0, emit)

    def expected(self, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over texts cut into segments."""
        lengths = np.diff(first)
        n_runs = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), n_runs)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        begin = first[text] + number * SEGMENT
        size = np.minimum(SEGMENT, first[text + 1] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, head = begin[order], size[order], (number == 0)[order]
        starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
        if not len(begin):
            return starts, moves, emits
        n_steps = int(size[0])
        active = np.searchsorted(-size, -np.arange(1, n_steps + 1), "right")  # runs that still have step t
        alphas, scales, emitted = [], [], []
        alpha = np.where(head[:, None], self.start, self.shares)
        for t in range(n_steps):
            m = active[t]
            e = self.by_class[classes[begin[:m] + t]]
            alpha = (alpha if t == 0 else alpha[:m] @ self.move) * e
            scale = alpha.sum(axis=1, keepdims=True)
            alpha = alpha / scale
            alphas.append(alpha)
            scales.append(scale)
            emitted.append(e)
        beta = np.ones((active[-1], STATES))
        for t in range(n_steps - 1, -1, -1):
            m = active[t]
            if m > len(beta):
                beta = np.concatenate((beta, np.ones((m - len(beta), STATES))))
            gamma = alphas[t] * beta
            seen = classes[begin[:m] + t]
            for s in range(STATES):
                emits[s] += np.bincount(seen, gamma[:, s], CLASSES)
            if t:
                back = emitted[t] * beta / scales[t]
                moves += alphas[t - 1][:m].T @ back
                beta = back @ self.move.T
            else:
                starts += gamma[head].sum(axis=0)
        return starts, moves * self.move, emits

    def log10(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of the exact likelihood of each class sequence, by the scaled forward recursion."""
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        begin, size = first[:-1][order], lengths[order]
        out = np.zeros(len(lengths))
        n_steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, n_steps + 1), "right")
        alpha = np.tile(self.start, (len(size), 1))
        for t in range(n_steps):
            m = active[t]
            alpha = (alpha[:m] if t == 0 else alpha[:m] @ self.move) * self.by_class[classes[begin[:m] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            out[:m] += np.log10(scale)
        result = np.empty(len(out))
        result[order] = out
        return result


def _grouped(rows: np.ndarray, k: int) -> np.ndarray:
    """k groups of rows by cosine: farthest-first starts, then a few rounds of means."""
    if not len(rows):
        return np.zeros(0, np.int64)
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    centres = [unit[0]]
    while len(centres) < k:
        centres.append(unit[int(np.argmin(np.max(unit @ np.array(centres).T, axis=1)))])
    centres = np.array(centres)
    for _ in range(20):
        group = np.argmax(unit @ centres.T, axis=1)
        for g in range(k):
            if (group == g).any():
                centres[g] = unit[group == g].mean(axis=0)
    return np.argmax(unit @ centres.T, axis=1)


def _expected(text_col: str, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        total = np.zeros(STATES + STATES * STATES + STATES * CLASSES)
        for batch in small_batches(batches, text_col, 2_000_000):
            tokens = Tokens(field(batch, text_col))
            total += np.concatenate([x.ravel() for x in chain.expected(tokens.classes(), tokens.first)])
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["slot", "value"])
    return run


def _summed(rows: DataFrame) -> dict[int, float]:
    """At most CLASSES**2 sums, whatever the corpus."""
    return {r["slot"]: r["value"] for r in rows.groupBy("slot").agg(F.sum("value").alias("value")).collect()}


def train_chain(texts: DataFrame, text_col: str, rounds: int) -> Chain:
    spark = texts.sparkSession
    first = _summed(texts.mapInArrow(_together(text_col), "slot long, value double"))
    counts = np.array([first.get(c, 0.0) for c in range(CLASSES)])
    chain = Chain.seeded(counts, {divmod(slot - CLASSES, CLASSES): v for slot, v in first.items() if slot >= CLASSES})
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chain)
        sums = _summed(texts.mapInArrow(_expected(text_col, shared), "slot long, value double"))
        flat = np.array([sums.get(i, 0.0) for i in range(STATES + STATES * STATES + STATES * CLASSES)])
        start, move, emit = np.split(flat, [STATES, STATES + STATES * STATES])
        background = (counts + 0.5) / (counts.sum() + 0.5 * CLASSES)
        chain = Chain(start + 0.1, move.reshape(STATES, STATES) + 0.1, emit.reshape(STATES, CLASSES) + background)
    return chain


def _scored(id_col: str, text_col: str, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, class_logs = shared.value
        for batch in small_batches(batches, text_col):
            tokens = Tokens(field(batch, text_col))
            classes = tokens.classes()
            total = np.concatenate(([0.0], np.cumsum(class_logs[classes])))
            logs = chain.log10(classes, tokens.first) - (total[tokens.first[1:]] - total[tokens.first[:-1]])
            yield pa.record_batch([field(batch, id_col), field(batch, "held_out"), field(batch, "key"), pa.array(np.diff(tokens.first)), pa.array(logs)], [id_col, "held_out", "key", "n_tokens", "chain"])
    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per document: the id, held_out, n_tokens, n_known, train_tokens, base_score, score. Held-out rows are not learned from."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col), held_out.alias("held_out"), (~held_out).alias("learn"), F.xxhash64(id_col, text_col).alias("key"))
    bits = part_bits(tasks_of(spark))
    entries = rows.select(text_col, "learn", "key").mapInArrow(_entries(text_col, bits), ROWS)
    shares = stored(dealt(entries).sortWithinPartitions("part").mapInArrow(_shares, ROWS))
    total, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in shares.where("kind = 2").select("data").collect():  # one row a task, of fixed size
        a, b = _opened(r["data"], np.float64, np.float64)
        total, distinct = total + a, distinct + b
    sums = dealt(shares.where("kind < 2").select("chunk", "kind", "data"), "chunk").sortWithinPartitions("chunk").mapInArrow(_collected, "key long, logs double, n_known long").dropDuplicates(["key"])
    chain = train_chain(rows.where("learn").select(text_col), text_col, rounds)
    shared = spark.sparkContext.broadcast((chain, np.log10(total + 0.5 * (distinct + 1))))
    scored = rows.select(id_col, text_col, "held_out", "key").mapInArrow(_scored(id_col, text_col, shared), f"`{id_col}` {kind}, held_out boolean, key long, n_tokens long, chain double")
    n, v = int(total.sum()), int(distinct.sum())
    return scored.join(sums, "key").select(id_col, "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                                           (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"), (F.col("logs") + F.col("chain")).alias("score"))


def fifth_one(id_col: str = "doc_id") -> Column:
    return fold(id_col, 5) == 1
