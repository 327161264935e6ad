import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm.components import components
from vitalgrid.llm.jaccard import errors, near_duplicates, one_of_each, packed, signatures, unpacked_values


def brute(rows):
    """doc_id -> (n_shingles, component); rows: (id, text)."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    inverted = {}
    for i, own in enumerate(sets):
        for j, common in Counter(j for s in own for j in inverted.get(s, ())).items():
            if 100 * common >= 75 * (len(own) + len(sets[j]) - common):
                root[find(i)] = find(j)
        for s in own:
            inverted.setdefault(s, []).append(i)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return sorted(((name, len(sets[i]), least.get(find(i))) for i, (name, _) in enumerate(rows)), key=str)


def test_similar_sets_share_a_signature_in_the_smaller_ones_index_prefix():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 5, 7, 8, 11, 13, 15, 16, 17, 20, 22, 30, 31, 32, 40, 60, 64, 100, 130, 257]:
        for weights in ((0, 1, 0, 0), (0.1, 0.1, 0.4, 0.4), (0, 0, 0, 1), (0, 0, 1, 0), (0.6, 0.2, 0.1, 0.1)):
            for _ in range(6):
                universe = rng.integers(1, 1 << 63, 3 * n + 8).astype(np.uint64)
                classes = rng.choice([0, 1, 2, 3], len(universe), p=weights)
                by = dict(zip(universe.tolist(), classes.tolist(), strict=True))
                x = set(universe[:n].tolist())
                y = set(x)
                for token in universe[n:].tolist():  # add and remove while the sets stay similar
                    new = y | {token} if rng.random() < 0.5 else y - {rng.choice(sorted(y))}
                    if not new or 100 * len(x & new) < 75 * len(x | new):
                        break
                    y = new
                out = []
                for s in (x, y):
                    values = np.array(sorted(s), np.uint64)
                    sig, flag = signatures(values, np.array([by[v] for v in values.tolist()], np.int8), 75)
                    out.append((len(s), dict(zip(sig.tolist(), flag.tolist(), strict=True))))
                (_, small), (_, large) = sorted(out, key=lambda o: o[0])
                assert any(flag and s in large for s, flag in small.items())


def test_errors_are_the_largest_allowed():
    for n in range(1, 300):
        probe, index = errors(n, 75)
        assert 100 * (n - probe) >= 75 * n > 100 * (n - probe - 1)
        assert 175 * (n - index) >= 150 * n > 175 * (n - index - 1)


def test_packed_values_come_back():
    for values in ([], [0], [0, 0, 5], [65534, 65535, 65536, 300000], [65535 * 3, 65535 * 3], [7, 16777215]):
        assert unpacked_values(packed(np.array(values, np.int64))).tolist() == values


def test_classes_match_brute_force_with_hot_groups(sent, prose, near):
    rows = []
    base, passage = prose(1, 120), prose(2, 60)
    rows += [(1000 + i, near(base, i, 1 + i % 7)) for i in range(120)]  # some pairs below the threshold
    rows += [(2000 + i, base) for i in range(40)]
    rows += [(3000 + i, passage + " " + prose(100 + i, 4 + i % 30)) for i in range(120)]  # one passage in many texts
    rows += [(4000 + i, near(prose(500 + i // 3, 30 + i), i, i % 4)) for i in range(90)]
    rows += [(5000 + i, prose(900 + i, 1 + i % 6)) for i in range(20)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three four"), (7, "one two three four five"), (7, "one two three four five"), (8, prose(7, 9000)), (9, near(prose(7, 9000), 3, 90)),
             (None, "one two"), (None, prose(77, 50))]
    docs = sent.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("node", F.lit(1)).repartition(5)
    got = near_duplicates(docs)
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_one_row_of_each_class_stays(sent, prose, near):
    base = prose(1, 80)
    rows = [(5, base, "a"), (3, near(base, 1, 1), "b"), (9, base, "c"), (3, near(base, 1, 1), "b"), (None, base, "d"), (7, "", "e"), (8, None, "f"), (7, "", "e"), (4, prose(2, 40), "g"), (4, prose(2, 40), "g"), (6, prose(3, 40), None)]
    docs = sent.createDataFrame(rows, "doc_id long, text string, row string").withColumn("key", F.lit(1))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["row"]) for r in kept.where("row IS NOT NULL").collect()) == [(3, "b"), (4, "g"), (7, "e"), (7, "e"), (8, "f")]
    assert kept.where("doc_id = 6").count() == 1 and kept.count() == 6


def test_empty_table(sent):
    docs = sent.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0 and one_of_each(docs).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)] + [(200, 100), (100, 200)], [(3, 3), (5, 9), (9, 7), (1, 4), (4, 2)]])
def test_components(sent, links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r["node"]: r["root"] for r in components(sent.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_shingles_travel_as_three_bytes():
    from vitalgrid.llm.jaccard import short_slices, short_values
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    hashes = np.concatenate((hashes, hashes[:9], np.array([0, (1 << 64) - 1], np.uint64)))
    parts, data = short_slices(hashes, 12)
    got = sorted((p << 24) | v for p, d in zip(parts.tolist(), data.to_pylist(), strict=True) for v in short_values(d).tolist())
    assert got == sorted((hashes >> np.uint64(28)).tolist()) and sum(len(d) for d in data.to_pylist()) == 3 * len(hashes)
    assert short_slices(hashes[:0], 12)[0].tolist() == [] and len(short_slices(hashes[:0], 12)[1]) == 0


def test_rare_shingles_sign_nothing_however_many_are_shared(sent):
    """The bitmap of shared shingles grows before the floor rises."""
    from vitalgrid.llm import jaccard
    frequent = sent.range(100).selectExpr("id AS hash", "CASE WHEN id < 80 THEN 2 WHEN id < 95 THEN 40 ELSE 5000 END AS n")
    assert jaccard.frequency_floors(frequent, (1, 100), (32, 5)) == [(1, 100), (64, 5)]
    assert jaccard.frequency_floors(frequent, (1, 99)) == [(2, 20)]
    assert jaccard.bits_for(0) == jaccard.bits_for(1 << 24) == 26 and jaccard.bits_for((1 << 24) + 1) == 27 and jaccard.bits_for(jaccard.MOST_SHARED) == 28
    assert jaccard.MOST_SHARED > 140_000_000  # what 6 GB of documents share, carried on from 0.51 GB


def test_classes_with_another_size_of_bitmap_and_with_all_texts_told_by_the_bitmap(sent, prose, near, monkeypatch):
    from vitalgrid.llm import jaccard
    monkeypatch.setattr(jaccard, "bits_for", lambda n: 20)
    marked = jaccard.marked
    monkeypatch.setattr(jaccard, "marked", lambda rows, keys: marked(rows, keys, 15))
    rows = [(i, near(prose(i // 4, 20 + i % 50), i, i % 4)) for i in range(300)] + [(None, prose(3, 23)), (4, prose(1, 24)), (4, prose(1, 24))]
    got = near_duplicates(sent.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_distinct_pairs():
    from vitalgrid.llm.jaccard import distinct_pairs
    both = np.random.default_rng(1).integers(0, 6, (200, 2)).astype(np.uint64)
    assert (distinct_pairs(both) == np.unique(both, axis=0)).all() and len(distinct_pairs(both[:0])) == 0
