"""Phrases whose words stand together more often than apart, from a weighted de Bruijn graph of the corpus.

Pieces and words. Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words at spaces
and tabs. Everything is counted per language: a word's 64-bit hash takes its document's language in, so grams of two
languages never meet (null counts as `und`).

Graph. Nodes are grams of LONGEST - 1 = 3 words, edges are grams of 4 words that tie the two overlapping nodes. From
each place of a piece exactly one gram is gathered: the edge that starts there or, where the piece ends sooner, what is
left of it (a correction for that end). The number of occurrences of a shorter gram is its node's flow: the sum of the
weights of all gathered grams that begin with it. No shorter gram is counted by itself.

Rare pairs. A gram with at least `least` occurrences holds no pair of fewer. Pairs are therefore counted first, by 36
bits of their hash and up to `least` a chunk, and pieces are cut between two words of a pair below `least`; a cut is one more
piece end, so all flows stay exact. The pairs that stay are told by a bitmap of fixed size: when a corpus outgrows it,
more grams are gathered, and nothing is lost.

Unary paths. Where a node passes its whole flow from one edge on to one other edge, the two become one path: rows of
(path, weight, words), joined by doubling pointers over written tables. A path cannot be a circle, as its weight would
never reach a piece's end. Each gram of a path is expanded once when longer grams are held against shorter ones, and a path is
a repeated passage of any length (`passages`).

Traffic is packed, one row per (task's chunk, slice of the hash space): a gram in every document costs one entry a chunk,
so no key is hot. Empty tables, null and empty texts give no words. Repeated rows count as often as they stand there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jaccard import LOW_BITS, _cut, _slices, packed, part_bits, unpacked_values
from .words import Words, field, mixed, small_batches, word_class
from .work import dealt, hash_bitmap, in_bitmap, stored, tasks_of

LONGEST, LEAST, TOP, SHARE = 4, 30, 2000, 80
CHUNK = 1_000_000
SALTS = 64
STEP = np.uint64(0xD6E8FEB86659FD93)
ENDS = b".,;:!?\n\x0b\x0c\r"
PIECE_END = np.isin(np.arange(256), np.frombuffer(ENDS, np.uint8))
WORD = word_class([(0x20, 0x20), (0x09, 0x0D), *((c, c) for c in b".,;:!?")])


def language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Pieces:
    """Words of a batch: hashes with the language in them, and whether each is followed by another word of its piece."""

    def __init__(self, batch: pa.RecordBatch, text_col: str, lang_col: str) -> None:
        self.words = words = Words(field(batch, text_col), WORD)
        names = field(batch, lang_col).cast(pa.string()).fill_null("und").dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        self.lang = names.indices.to_numpy(zero_copy_only=False)[words.text_index()] if len(words) else np.zeros(0, np.int64)
        salt = np.array([language_hash(x) for x in self.langs], np.uint64)
        self.hashes = mixed(words.hashes() ^ salt[self.lang]) if len(words) else np.zeros(0, np.uint64)
        self.joined = np.zeros(len(words), bool)
        if len(words):
            ends = np.concatenate(([0], np.cumsum(PIECE_END[words.data])))
            self.joined[:-1] = ends[words.starts[1:]] == ends[words.ends[:-1]]
            last = words.first[1:] - 1
            self.joined[last[words.counts > 0]] = False

    def pairs(self) -> np.ndarray:
        """Hash of the pair from each word on; only those of joined words mean something."""
        out = np.zeros(len(self.hashes), np.uint64)
        out[:-1] = mixed(self.hashes[:-1] * STEP + self.hashes[1:])
        return out


# ---- pairs

def _pairs(text_col: str, lang_col: str, bits: int, least: int) -> Callable:
    """Packed (pair's leading bits, occurrences in the chunk up to `least`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            _, parts, low = _cut(np.concatenate(held), bits)
            short, n = np.unique((parts << LOW_BITS) | low, return_counts=True)
            n, low = np.minimum(n, least).astype(np.uint32), short & ((1 << LOW_BITS) - 1)
            rows = []
            for p, a, b in _slices(short >> LOW_BITS):
                steps = packed(low[a:b])
                rows.append((p, len(steps).to_bytes(4, "little") + steps + (n[a:b].astype(np.uint8) if least < 256 else n[a:b]).tobytes()))
            held.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "data"])
        for batch in small_batches(batches, text_col):
            pieces = Pieces(batch, text_col, lang_col)
            held.append(pieces.pairs()[pieces.joined])
            size += len(held[-1])
            if size >= CHUNK:
                yield out()
                size = 0
        if size:
            yield out()
    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes]]]:
    """Rows sorted by their leading columns; the last column of the rows of one key at a time."""
    current, held = None, []
    for batch in batches:
        *keys, data = (c.to_pylist() for c in batch.columns)
        for *key, value in zip(*keys, data, strict=True):
            if tuple(key) != current and held:
                yield current, held
                held = []
            current = tuple(key)
            held.append(value)
    if held:
        yield current, held


def _often(bits: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), data in _parts(batches):
            low, n = [], []
            for d in data:
                steps = int.from_bytes(d[:4], "little")
                low.append(unpacked_values(d[4:4 + steps]))
                n.append(np.frombuffer(d[4 + steps:], np.uint8 if least < 256 else np.uint32).astype(np.int64))
            low, n = np.concatenate(low), np.concatenate(n)
            order = np.argsort(low, kind="stable")
            low, n = low[order], n[order]
            edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            keep = np.add.reduceat(n, edge) >= least
            if keep.any():
                short = (np.int64(part) << LOW_BITS | low[edge][keep]).astype(np.uint64)
                yield pa.record_batch([pa.array((short << np.uint64(64 - bits - LOW_BITS)).view(np.int64))], ["hash"])
    return run


# ---- gathered grams

GATHERED = "kind int, part int, data binary, hash long, lang string, word string"
GRAMS, ENDED, NAMES, TOTALS = range(4)


def _gathered(text_col: str, lang_col: str, bits: int, bitmap) -> Callable:
    """Per chunk: packed grams of 2 to 4 words by their pair's slice, packed single words, names of words, words per language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bitmap.value
        held: list[tuple[np.ndarray, ...]] = []
        alone: list[np.ndarray] = []
        named = np.zeros(0, np.uint64)
        totals: dict[str, int] = {}
        size = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string())
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "part", "data", "hash", "lang", "word"])

        def out() -> pa.RecordBatch:
            rows = []
            if held:
                pair, *words = (np.concatenate(x) for x in zip(*held, strict=True))
                key = mixed(mixed(pair * STEP + words[2]) * STEP + words[3])  # tells grams of the chunk apart; the words go along
                order = np.lexsort((key, pair))
                pair, key, words = pair[order], key[order], [w[order] for w in words]
                edge = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (key[1:] != key[:-1]))))
                n = np.diff(np.append(edge, len(pair)))
                pair, words = pair[edge], [w[edge] for w in words]
                for p, a, b in _slices((pair >> np.uint64(64 - bits)).astype(np.int64)):
                    first = np.flatnonzero(np.concatenate(([True], pair[a + 1:b] != pair[a:b - 1])))
                    members = np.diff(np.append(first, b - a)).astype(np.uint32)
                    blob = b"".join(x.tobytes() for x in (words[0][a:b][first], words[1][a:b][first], members, words[2][a:b], words[3][a:b], n[a:b].astype(np.uint32)))
                    rows.append((GRAMS, p, len(first).to_bytes(4, "little") + blob, None, None, None))
            if alone:
                word, n = np.unique(np.concatenate(alone), return_counts=True)
                for p, a, b in _slices((word >> np.uint64(64 - bits)).astype(np.int64)):
                    rows.append((ENDED, p, word[a:b].tobytes() + n[a:b].astype(np.uint32).tobytes(), None, None, None))
            held.clear()
            alone.clear()
            return batch_of(rows)
        for batch in small_batches(batches, text_col):
            pieces = Pieces(batch, text_col, lang_col)
            h, pair = pieces.hashes, pieces.pairs()
            if not len(h):
                continue
            go = pieces.joined.copy()
            go[go] = in_bitmap(table, pair[go])
            ahead = np.append(h, np.zeros(LONGEST, np.uint64))
            goes = np.append(go, np.zeros(LONGEST, bool))
            at = np.flatnonzero(go)
            third = goes[at + 1]
            fourth = third & goes[at + 2]
            none = np.uint64(0)
            held.append((pair[at], h[at], ahead[at + 1], np.where(third, ahead[at + 2], none), np.where(fourth, ahead[at + 3], none)))
            alone.append(h[~go])
            size += len(h)
            inside = np.flatnonzero(go | np.append([False], go[:-1]))
            new, where = np.unique(h[inside], return_index=True)
            fresh = ~np.isin(new, named, assume_unique=True)
            if fresh.any():
                named = np.union1d(named, new[fresh])
                w = pieces.words
                yield batch_of([(NAMES, None, None, int(x), pieces.langs[pieces.lang[i]], w.word(i).decode()) for x, i in
                                zip(new[fresh].view(np.int64), inside[where[fresh]].tolist(), strict=True)])
            for i, n in enumerate(np.bincount(pieces.lang, minlength=len(pieces.langs)).tolist()):
                totals[pieces.langs[i]] = totals.get(pieces.langs[i], 0) + n
            if size >= CHUNK:
                yield out()
                size = 0
        if size:
            yield out()
        yield batch_of([(TOTALS, None, None, n, lang, None) for lang, n in totals.items() if n])
    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


FLOWS = "k int, w1 long, w2 long, w3 long, w4 long, a long, f2 long, f3 long"


def _flows(least: int) -> Callable:
    """Edges and nodes with at least `least` occurrences, with the flow of their beginnings; what flows to single words, k = 1."""
    def rows(k: int, w: list[np.ndarray], a: np.ndarray, f2: np.ndarray, f3: np.ndarray) -> pa.RecordBatch:
        w = [*w, *[np.zeros(len(a), np.uint64)] * (LONGEST - len(w))]
        columns = [np.full(len(a), k, np.int32), *(x.view(np.int64) for x in w), a, f2, f3]
        return pa.record_batch([pa.array(c) for c in columns], ["k", "w1", "w2", "w3", "w4", "a", "f2", "f3"])

    def single(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(word, kind="stable")
        word, n = word[order], n[order]
        edge = _runs(word)
        total = np.add.reduceat(n, edge)
        return rows(1, [word[edge]], total, total, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, _), data in _parts(batches):
            if kind == ENDED:
                sizes = [len(d) // 12 for d in data]
                yield single(np.concatenate([np.frombuffer(d, np.uint64, m) for d, m in zip(data, sizes, strict=True)]),
                             np.concatenate([np.frombuffer(d, np.uint32, m, 8 * m) for d, m in zip(data, sizes, strict=True)]).astype(np.int64))
                continue
            parts = []
            for d in data:
                m = int.from_bytes(d[:4], "little")
                heads = np.frombuffer(d, np.uint8)[4:4 + 16 * m].copy().view(np.uint64).reshape(2, m)
                members = np.frombuffer(d, np.uint8)[4 + 16 * m:4 + 20 * m].copy().view(np.uint32)
                rest, e = d[4 + 20 * m:], int(members.sum())
                tails = np.frombuffer(rest, np.uint8)[:16 * e].copy().view(np.uint64).reshape(2, e)
                parts.append((*(np.repeat(x, members) for x in heads), *tails, np.frombuffer(rest, np.uint8)[16 * e:].copy().view(np.uint32).astype(np.int64)))
            w1, w2, w3, w4, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((w4, w3, w2, w1))
            w, n = [x[order] for x in (w1, w2, w3, w4)], n[order]
            starts = [_runs(*w[:k]) for k in (2, 3, 4)]
            flow = [np.add.reduceat(n, s) for s in starts]
            f2, f3 = (np.repeat(f, np.diff(np.append(s, len(n)))) for f, s in zip(flow[:2], starts[:2], strict=True))
            yield single(w[0][starts[0]], flow[0])
            for k, s, f in zip((2, 3, 4), starts, flow, strict=True):
                keep = (f >= least) & (w[k - 1][s] != 0)  # a gram cut short is only a correction
                s, f = s[keep], f[keep]
                yield rows(k, [x[s] for x in w[:k]], f, f2[s], f3[s])
    return run


class Graph:
    """The frequent part of a corpus's de Bruijn graph: `grams` (k, w1..w4, a, f2, f3), `names`, `totals`."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> None:
        self.least = least
        texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
        bits = part_bits(tasks_of(docs.sparkSession))
        pairs = dealt(texts.mapInArrow(_pairs("text", "lang", bits, least), "part int, data binary")).sortWithinPartitions("part")
        bitmap = hash_bitmap(stored(pairs.mapInArrow(_often(bits, least), "hash long")), "hash")
        gathered = stored(texts.mapInArrow(_gathered("text", "lang", bits, bitmap), GATHERED))
        packs = dealt(gathered.where(F.col("kind") <= ENDED).select("kind", "part", "data"), "part").sortWithinPartitions("kind", "part")
        flows = stored(packs.mapInArrow(_flows(least), FLOWS))
        self.words = flows.where("k = 1").groupBy("w1").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
        self.grams = flows.where("k > 1")
        self.names = gathered.where(F.col("kind") == NAMES).groupBy("hash").agg(F.min("lang").alias("lang"), F.min("word").alias("word"))
        self.totals = gathered.where(F.col("kind") == TOTALS).groupBy("lang").agg(F.sum("hash").alias("n"))

    def paths(self) -> DataFrame:
        """(path, a, words): edges tied where a node passes all its flow from one edge to one other."""
        node = lambda *w: F.struct(*[F.col(c).alias(f"n{i}") for i, c in enumerate(w)])
        edges = self.grams.where("k = 4").select(F.struct("w1", "w2", "w3", "w4").alias("e"), node("w1", "w2", "w3").alias("s"), node("w2", "w3", "w4").alias("t"), "a", "f3")
        # an edge with all of its node's flow is the node's only one, on either side
        out = edges.where("a = f3").select(F.col("s").alias("v"), F.col("e").alias("next"), F.col("a").alias("flow"))
        links = edges.select(F.col("t").alias("v"), "e", "a").join(out, "v").where("a = flow").select(F.col("next").alias("e"), F.col("e").alias("up"))
        current = stored(edges.join(links, "e", "left").select("e", "a", F.coalesce("up", "e").alias("up"), F.col("up").isNotNull().cast("long").alias("d")))
        while True:
            above = current.where("d > 0").select(F.col("e").alias("up"), F.col("up").alias("top"), F.col("d").alias("more"))
            moving = current.where("d > 0").join(above, "up")
            if moving.isEmpty():
                break
            moved = current.where("d > 0").join(above, "up", "left").select("e", "a", F.coalesce("top", "up").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
            current = stored(current.where("d = 0").union(moved))
        # a path is no longer than the longest piece
        rows = current.groupBy("up", "a").agg(F.array_sort(F.collect_list(F.struct("d", F.col("e.w4").alias("w")))).alias("tail"))
        return rows.select(F.col("up").alias("path"), "a", F.concat(F.array("up.w1", "up.w2", "up.w3"), F.col("tail.w")).alias("words"))

    def phrase(self, rows: DataFrame, key: list[str], words: str = "words") -> DataFrame:
        """(key, lang, phrase) of rows with word hashes in an array."""
        each = rows.select(*key, F.posexplode(words).alias("at", "hash")).join(self.names, "hash")
        text = each.groupBy(*key).agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("all"))
        return text.select(*key, "lang", F.concat_ws(" ", F.col("all.word")).alias("phrase"))


def _grams_of(words: str, k: int) -> Column:
    """Array of the k-grams of an array of words, as (k, w1, w2, w3)."""
    part = lambda i, j: F.get(words, i + j) if j < k else F.lit(0).cast("long")
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.struct(F.lit(k).alias("k"), *[part(i, j).alias(f"w{j + 1}") for j in range(3)]))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """Per language the `top` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    Candidates have a >= `least` occurrences. A cut after k words gives l and r, the occurrences of the two sides, and
    floor(2000000 * a / (l + r)); the lowest counts, ties to the smallest k. A candidate inside a longer one with at least
    `share` % of its occurrences goes. Order: score and a descending, phrase ascending by bytes.
    """
    graph = Graph(docs, text_col, lang_col, least)
    key = ["k", "w1", "w2", "w3"]
    # longer grams held against shorter ones: every gram of a path once, and the pairs of nodes
    paths = graph.paths().select("a", "words")
    nodes = graph.grams.where("k = 3").select("a", F.array("w1", "w2", "w3").alias("words"))
    longer = paths.select("a", F.explode(F.concat(_grams_of("words", 3), _grams_of("words", 2))).alias("g")).union(nodes.select("a", F.explode(_grams_of("words", 2))))
    longer = longer.select("a", "g.*").groupBy(*key).agg(F.max("a").alias("over"))
    short = graph.grams.where("k < 4").join(longer, key, "left").where(f"over IS NULL OR 100 * over < {share} * a").drop("over")
    kept = stored(graph.grams.where("k = 4").unionByName(short.select(graph.grams.columns)))
    # the two sides of each cut
    first = graph.words.select("w1", F.col("a").alias("f1"))
    zero = F.lit(0).cast("long")
    cut = lambda at, left, *right: F.struct(F.lit(at).alias("at"), F.col(left).alias("l"), *[(F.col(right[j]) if j < len(right) else zero).alias(f"r{j + 1}") for j in range(3)])
    cuts = (F.when(F.col("k") == 2, F.array(cut(1, "f1", "w2")))
            .when(F.col("k") == 3, F.array(cut(1, "f1", "w2", "w3"), cut(2, "f2", "w3")))
            .otherwise(F.array(cut(1, "f1", "w2", "w3", "w4"), cut(2, "f2", "w3", "w4"), cut(3, "f3", "w4"))))
    gram = ["w1", "w2", "w3", "w4"]
    sides = kept.join(first, "w1").select(*gram, "a", F.explode(cuts).alias("c")).select(*gram, "a", "c.*")
    counts = graph.words.select(F.col("w1").alias("r1"), zero.alias("r2"), zero.alias("r3"), F.col("a").alias("r"))
    counts = counts.union(graph.grams.where("k < 4").select("w1", "w2", "w3", "a"))
    # 39 digits hold any product of two long numbers
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    sides = sides.join(counts, ["r1", "r2", "r3"]).withColumn("twice", F.lit(2000000).cast("decimal(7,0)") * wide("a")).withColumn("both", wide("l") + wide("r"))
    sides = sides.withColumn("score", F.expr("twice DIV both").cast("long"))
    scored = sides.groupBy(*gram).agg(F.min(F.struct("score", "at", "l", "r", "a")).alias("m")).select(*gram, "m.*")
    scored = stored(scored)
    words = F.filter(F.array(*gram), lambda w: w != 0)
    named = scored.join(graph.phrase(scored.select(*gram, words.alias("words")), gram), gram).select("lang", "phrase", "a", "l", "r", "score")
    # first within a salt of a language, then among at most SALTS * top rows of it
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(graph.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def passages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """Repeated passages: the graph's unary paths as (lang, n_words, a, phrase)."""
    graph = Graph(docs, text_col, lang_col, least)
    paths = stored(graph.paths())
    return paths.join(graph.phrase(paths, ["path"]), "path").select("lang", F.size("words").alias("n_words"), "a", "phrase")
