"""License notices in documents by diagonal voting.

Templates are word sequences. Every run of K words of a document that some template holds too is a hit; hits are joined by
Spark with the places of their hash in the templates, and each pair votes for the offset (diagonal) at which the template
would lie in the document. Votes are summed per document, template and diagonal. Diagonals no further apart than the
errors a template may have are one group, since an inserted or missing word moves the rest by one. Each word edit costs at
most K votes, so a group below (n - K + 1) - K * errors votes cannot be a notice of n words; the others are verified
word by word: the longest common subsequence of the template and the span from the first diagonal to n words after the last.

A template of n words may have (100 - SHARE) % of them wrong, rounded down: none below ten words. Every place at most that
many word edits away from a template is found. The words around hits are carried beside them as 64-bit hashes, as
far as a template with so few votes could reach, so texts are read once.

Base phrases are places where given words stand consecutively; their labels stay and give a score of 1. Otherwise the score is the
greatest share of a template's words found in a verified span, 0 without one.

Null and empty texts have no words. Repeated rows and null ids are documents of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import ALPHANUMERIC, Words, field, small_batches, windows
from .work import stored

K, SHARE = 3, 90

#: Phrases that name a license.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# fixed values: published license notices
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
            "Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
             "Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
            "notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"),
)


def hashes_of(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts, pa.string()), ALPHANUMERIC)
    every = words.hashes()
    return [every[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


@dataclass
class Template:
    label: str
    words: np.ndarray
    errors: int
    least: int


class Templates:
    """Templates of at least k words, their grams, and how far a template with so many votes can reach."""

    def __init__(self, templates: tuple, k: int, share: int) -> None:
        self.k, self.all = k, []
        for (label, _), words in zip(templates, hashes_of([t for _, t in templates]), strict=True):
            n = len(words)
            if n >= k:
                errors = n * (100 - share) // 100
                self.all.append(Template(label, words, errors, max(1, n - k + 1 - k * errors)))
        self.grams = np.unique(np.concatenate([windows(t.words, k) for t in self.all])) if self.all else np.zeros(0, np.uint64)
        self.longest = max((len(t.words) + t.errors for t in self.all), default=0)

    def positions(self) -> list[tuple]:
        """(gram, template, place, n, errors, least) of every gram."""
        return [(int(g), i, place, len(t.words), t.errors, t.least) for i, t in enumerate(self.all) for place, g in enumerate(windows(t.words, self.k).view(np.int64))]

    def reach(self, hits: int) -> int:
        return max((len(t.words) + t.errors for t in self.all if t.least <= hits), default=0)


def places(hashes: np.ndarray, first: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Words at which the phrase starts, within one text."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0 or not len(phrase):
        return np.zeros(0, np.int64)
    same = np.ones(n, bool)
    for i, h in enumerate(phrase):
        same &= hashes[i:n + i] == h
    at = np.flatnonzero(same)
    return at[np.searchsorted(first, at, "right") == np.searchsorted(first, at + len(phrase) - 1, "right")]


SCANNED = ("n_words long, n_base long, first_word long, last_word long, base array<string>, hits array<struct<region:int,pos:bigint,gram:bigint>>, "
           "regions array<struct<start:bigint,words:array<bigint>>>")
HITS = pa.list_(pa.struct([("region", pa.int32()), ("pos", pa.int64()), ("gram", pa.int64())]))
REGIONS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.list_(pa.int64()))]))


def _scan(id_col: str, text_col: str, templates: Templates, phrases: list[tuple[np.ndarray, str]]) -> Callable:
    def regions(hashes: np.ndarray, hits: np.ndarray, grams: np.ndarray) -> tuple[list[dict], list[dict]]:
        """Hits of one text with the number of their region, and the words around each region."""
        cut = np.flatnonzero(np.diff(hits) > templates.longest) + 1
        found, around = [], []
        for r, at in enumerate(np.split(np.arange(len(hits)), cut)):
            slack = templates.reach(len(at))
            start, end = max(0, int(hits[at[0]]) - slack), int(hits[at[-1]]) + templates.k + slack
            around.append({"start": start, "words": hashes[start:end].view(np.int64)})
            found += [{"region": r, "pos": p, "gram": g} for p, g in zip(hits[at].tolist(), grams[at].tolist(), strict=True)]
        return found, around

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            words = Words(field(batch, text_col), ALPHANUMERIC)
            hashes, first, rows = words.hashes(), words.first, batch.num_rows
            n_base, low, high, base = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1), [set() for _ in range(rows)]
            for phrase, label in phrases:
                at = places(hashes, first, phrase)
                text = np.searchsorted(first, at, "right") - 1
                np.add.at(n_base, text, 1)
                np.minimum.at(low, text, at - first[text])
                np.maximum.at(high, text, at - first[text])
                for t in np.unique(text).tolist():
                    base[t].add(label)
            gram = windows(hashes, templates.k)
            hits = np.zeros(0, np.int64)
            if len(gram) and len(templates.grams):
                near = np.minimum(np.searchsorted(templates.grams, gram), len(templates.grams) - 1)
                hits = np.flatnonzero(templates.grams[near] == gram)
                hits = hits[np.searchsorted(first, hits, "right") == np.searchsorted(first, hits + templates.k - 1, "right")]
            found, around = [[] for _ in range(rows)], [[] for _ in range(rows)]
            text = np.searchsorted(first, hits, "right") - 1
            for t in np.unique(text).tolist():
                own = hits[text == t]
                found[t], around[t] = regions(hashes[first[t]:first[t + 1]], own - first[t], gram[own].view(np.int64))
            none = n_base == 0
            yield pa.record_batch([field(batch, "row_number"), field(batch, id_col), pa.array(words.counts), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                                   pa.array([sorted(b) for b in base], pa.list_(pa.string())), pa.array(found, HITS), pa.array(around, REGIONS)],
                                  ["row_number", "id", "n_words", "n_base", "first_word", "last_word", "base", "hits", "regions"])
    return run


def common_words(span: np.ndarray, template: np.ndarray) -> int:
    """Length of the longest common subsequence, by one wide integer a word of the span."""
    masks: dict[int, int] = {}
    for i, w in enumerate(template.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    open_ends = full
    for w in span.tolist():
        both = open_ends & masks.get(w, 0)
        open_ends = ((open_ends + both) | (open_ends - both)) & full
    return len(template) - open_ends.bit_count()


def _verified(templates: Templates) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                t = templates.all[row["template"]]
                a, b = max(row["low"], 0), row["high"] + len(t.words)
                words = np.array(row["words"], np.int64).view(np.uint64)
                span = words[max(0, a - row["start"]):b - row["start"]]
                same = common_words(span, t.words)
                if same >= len(t.words) - t.errors:
                    end = max(a, row["start"]) + len(span)
                    out.append((row["row_number"], t.label, max(a, row["start"]), end, same / len(t.words)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["row_number", "label", "start", "end", "share"])
    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES, k: int = K, share: int = SHARE) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, end, share; words from 0).

    `templates` and `phrases` are (label, text) and (text, label) pairs, a list that people keep by hand.
    """
    spark = docs.sparkSession
    known = Templates(templates, k, share)
    named = list(zip(hashes_of([p for p, _ in phrases]), [label for _, label in phrases], strict=True))
    texts = docs.select(F.monotonically_increasing_id().alias("row_number"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scanned = stored(texts.mapInArrow(_scan("id", "text", known, named), f"row_number long, id {docs.schema[id_col].dataType.simpleString()}, {SCANNED}"))
    positions = spark.createDataFrame(known.positions(), "gram long, template int, place int, n int, errors int, least int")
    votes = (scanned.select("row_number", F.explode("hits").alias("h")).select("row_number", "h.*").join(positions, "gram")
             .groupBy("row_number", "region", "template", (F.col("pos") - F.col("place")).alias("diagonal"), "errors", "least").agg(F.count("*").alias("votes")))
    # neighbouring diagonals of one document and template, in one region
    order = Window.partitionBy("row_number", "region", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.greatest(F.lit(1), "errors"), F.lit(True))
    groups = votes.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(order))
    groups = groups.groupBy("row_number", "region", "template", "cluster").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.first("least").alias("least"))
    around = scanned.select("row_number", F.posexplode("regions").alias("region", "r")).select("row_number", "region", "r.*")
    checked = groups.where("votes >= least").join(around, ["row_number", "region"]).select("row_number", "template", "low", "high", "start", "words")
    spans = checked.mapInArrow(_verified(known), "row_number long, label string, start long, end long, share double")
    found = spans.groupBy("row_number").agg(F.array_sort(F.collect_set(F.struct("start", "end", "label", "share"))).alias("spans"))
    rows = scanned.drop("hits", "regions").join(found, "row_number", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,label:string,share:double>>"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s["label"]))))
    return rows.withColumn("spans", spans).select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))).alias("score"), "spans")
