"""Language identification by rank-order profiles of character n-grams.

The n-grams are runs of 1 to 3 bytes of the lower-cased text in which every run of ASCII signs other than letters
is one blank (bytes above 0x7F count as letters). A profile is the PROFILE most frequent n-grams of a language,
ranked, over all training documents; a document is described by its own PROFILE most frequent n-grams. The
distance to a profile is the sum over the document's n-grams of the difference in rank, PROFILE for one that the
profile lacks. The nearest language wins; equal distances go to the smaller name. Equal counts rank by n-gram.

Texts that are null or have no letter get `und` and score 0, as does everything when no language was learned.
The score is the margin (second - best) / second, 1 with a single language. Rows without language or text teach
nothing. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import LOWER, field, small_batches, texts_of
from .work import fold

PROFILE = 300
UNKNOWN = "und"
SIGN = LOWER.copy()
SIGN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all n-grams of each text; a code is the bytes, most significant first."""
    signs = SIGN[data]
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] != 32) | (signs[:-1] != 32)
    first = bounds[:-1][np.diff(bounds) > 0]
    keep[first] = True  # a text does not go on where the one before it ended
    place = np.concatenate(([0], np.cumsum(keep)))[bounds]
    signs = signs[keep].astype(np.int32)
    for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        own = signs[a:b]
        own = own[own[:1].sum() == 32 and len(own) == 1 or 0:]
        if not len(own):
            yield own
            continue
        two = (own[:-1] << 8) | own[1:]
        three = (two[:-1] << 8) | own[2:]
        yield np.concatenate((own[own != 32], two, three))


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The `most` most frequent codes, by count and then by code."""
    if not len(codes):
        return codes
    codes = np.sort(codes)
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(np.append(edge, len(codes)))
    values = codes[edge]
    if len(values) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= floor
        counts, values = counts[some], values[some]
    return values[np.argsort(-counts, kind="stable")][:most]


def _counts(lang_col: str, text_col: str) -> Callable:
    """Counts of n-grams by language in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
        for batch in small_batches(batches, text_col, 2_000_000):
            data, bounds = texts_of(field(batch, text_col))
            langs = field(batch, lang_col).to_pylist()
            own: dict[str, list[np.ndarray]] = {}
            for name, codes in zip(langs, grams(data, bounds), strict=True):
                own.setdefault(name, []).append(codes)
            for name, parts in own.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                kept[name] = [merged([*kept.get(name, []), (codes, n)])]
        for name, [(codes, n)] in kept.items():
            yield pa.record_batch([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(n, pa.int64())], ["lang", "gram", "n"])
    return run


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Ranked n-grams of each language: `size` codes a language reach the driver."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = known.mapInArrow(_counts("lang", "text"), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # at most 256 + 256**2 + 256**3 n-grams a language, whatever the corpus
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {name: np.array([g for _, g in sorted(rows)], np.int64) for name, rows in sorted(out.items())}


class Profiles:
    """Ranks of the union of all profile n-grams."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int) -> None:
        self.names, self.size = list(profiles), size
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.codes), len(self.names)), -1, np.int64)
        for k, codes in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.codes, codes), k] = np.arange(len(codes))

    def nearest(self, codes: np.ndarray) -> tuple[str, float]:
        if not self.names or not len(codes):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, codes).clip(0, len(self.codes) - 1)
        rank = np.where((self.codes[at] == codes)[:, None], self.ranks[at], -1)
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(codes))[:, None])).sum(axis=0)
        order = np.argsort(away, kind="stable")
        best = int(order[0])
        if len(order) == 1:
            return self.names[best], 1.0
        second = int(away[order[1]])
        return self.names[best], (second - int(away[best])) / second if second else 0.0


def _predicted(id_col: str, text_col: str, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles: Profiles = shared.value
        for batch in small_batches(batches, text_col, 2_000_000):
            column = field(batch, text_col)
            data, bounds = texts_of(column)
            plain = np.concatenate(([0], np.cumsum((SIGN[data] != 32) & (data < 128))))
            plain = plain[bounds[1:]] > plain[bounds[:-1]]
            names, scores = [], []
            for i, codes in enumerate(grams(data, bounds)):
                letters = plain[i] or any(map(str.isalpha, column[i].as_py() or ""))
                name, score = profiles.nearest(ranked(codes, profiles.size)) if letters else (UNKNOWN, 0.0)
                names.append(name)
                scores.append(score)
            yield pa.record_batch([*(field(batch, c) for c in (id_col, "held_out")), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                  [id_col, "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Per document: the id, held_out, lang_pred, score. Held-out rows are not learned from."""
    profiles = learn_profiles(docs.where(~held_out), lang_col, text_col, size)
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col), held_out.alias("held_out")).mapInArrow(
        _predicted(id_col, text_col, shared), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def third(id_col: str = "doc_id") -> Column:
    return fold(id_col, 3) == 1
