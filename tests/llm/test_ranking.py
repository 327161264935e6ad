"""Ranked search against a plain evaluation of every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vitalgrid.llm import ranking
from vitalgrid.llm.ranking import List, Shard, best_of, rank

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    texts = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, w in texts:
            tf, m = Counter(w), 25 + (75 * len(w) * n_docs) // max(1, total)
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, n in words.items() if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


def got(spark, docs, items, parts=3, **more):
    df = rank(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), **more)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=lambda x: x[:2])


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice((1, 5, 30, 200))))) for i in range(n)]


def test_equals_plain_ranking_with_copies_and_ties(sent):
    docs = corpus(1, 400) + [(1000 + i, "Same words w1 w2, twice w1") for i in range(300)] + [(2000, None), (2001, ""), (2002, "... !"), (None, "w1 w2 w50"), (7, "w1 w2 w50"), (7, "w1 w2 w50")]
    items = [(1, "w1 w2"), (2, "w40 w41 W40, w59"), (3, "unknown"), (4, None), (5, ""), (None, "w1"), (6, " ".join(f"w{i}" for i in range(60))), (7, "same twice"), (8, "w3"), (8, "w4 w3")]
    assert got(sent, docs, items) == plain(docs, items)


def test_blocks_of_queries_and_few_documents(sent, monkeypatch):
    docs, items = corpus(2, 6), [(i, f"w{i} w{i + 1} w0") for i in range(8)]
    whole = got(sent, docs, items)
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 5)
    assert got(sent, docs, items) == whole == plain(docs, items)


def test_one_very_long_document_and_text_ids(sent):
    docs = corpus(3, 40) + [(500, "w0 " * 300_000 + "w59")]
    items = [(1, "w0 w59"), (2, "w59 " * 500)]
    assert got(sent, docs, items) == plain(docs, items)
    named = rank(sent.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string"), sent.createDataFrame([(f"q{i}", t) for i, t in items], "item_id string, text string"))
    assert {(r[0], r[3]) for r in named.collect()} == {(f"q{i}", s) for i, _, _, s in plain(docs, items)}


def test_empty_tables_and_columns_of_the_same_name(sent):
    docs, items = corpus(4, 10), [(1, "w0 w1")]
    assert got(sent, [], items) == got(sent, docs, []) == []
    more = sent.createDataFrame([(*d, 1, "x", 2) for d in docs], f"{DOCS}, score int, rank string, item int")
    clash = sent.createDataFrame([(*i, 5) for i in items], f"{ITEMS}, doc_id int")
    assert sorted(map(tuple, rank(more, clash).collect())) == plain(docs, items)


@pytest.mark.parametrize("seed", range(6))
def test_skipping_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    n, m = 3000, 12
    sizes = rng.integers(1, n, m) // rng.integers(1, 30, m) + 1
    lists = [np.sort(rng.choice(n, s, replace=False)) for s in sizes]
    shard = Shard(rng.integers(1, 500, n), np.arange(m, dtype=np.uint64), sizes, np.concatenate(lists), rng.integers(1, 5, sizes.sum()), n, 250 * n, 75)
    weights = rng.integers(1, 9000, m)
    full = np.zeros(n, np.int64)
    for t in range(m):
        full[lists[t]] += shard.impact[shard.first[t]:shard.first[t + 1]] * weights[t]
    want = np.lexsort((np.arange(n), -full))[:10]
    docs, scores = best_of(shard, np.arange(m), weights, 10, 0)
    assert docs.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    floor = int(full[want[4]])
    docs, _ = best_of(shard, np.arange(m), weights, 10, floor)
    assert docs.tolist() == [d for d in want.tolist() if full[d] >= floor]


def test_accumulators_are_one_sorted_list():
    parts = [List(np.array(d), np.array(s), None, None, None, 0) for d, s in (([1, 600], [5, 7]), ([1, 2, 1500], [1, 1, 1]))]
    one = List.summed(parts)
    assert one.docs.tolist() == [1, 2, 600, 1500] and one.scores.tolist() == [6, 1, 7, 1]
    assert one.spans.tolist() == [0, 1, 2] and one.peak.tolist() == [6, 7, 1] and one.most == 7
    assert one.within(1)[0].tolist() == [600] and not len(one.within(5)[0])
