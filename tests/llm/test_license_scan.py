"""License notices against phrases counted plainly and templates compared with every span of a text."""
import random
import re

import numpy as np
import pytest

from vitalgrid.llm.license_scan import PHRASES, TEMPLATES, common_words, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_base(text):
    w, found = words(text), []
    for phrase, label in PHRASES:
        p = words(phrase)
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def distance(a, b):
    """Fewest inserted, missing and changed words between b and any span of a."""
    row = [0] * (len(a) + 1)
    for j, y in enumerate(b, 1):
        old, row[0] = row[0], j
        for i, x in enumerate(a, 1):
            old, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, old + (x != y))
    return min(row)


def plain_labels(text):
    """(labels that must be found, labels that may be): a span few edits away; a span with few of the words missing."""
    w, base = words(text), {*plain_base(text)[4].split(",")} - {""}
    must, may = set(base), set(base)
    for label, t in TEMPLATES:
        t = words(t)
        errors = len(t) // 10
        if len(set(w) & set(t)) >= len(set(t)) - errors:
            must |= {label} if distance(w, t) <= errors else set()
            may |= {label} if lcs(w, t) >= len(t) - errors else set()
    return must, may


def rows_of(spark, rows, parts=3, kind=KIND):
    df = scan_licenses(spark.createDataFrame(rows, kind).repartition(parts))
    assert df.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    return {r["doc_id"]: r for r in df.collect()}


def edited(text, seed, errors):
    rng, w = random.Random(seed), text.split()
    for _ in range(errors):
        i = rng.randrange(len(w))
        w[i:i + 1] = rng.choice(([], ["changed"], [w[i], "added"]))
    return " ".join(w)


def test_base_and_labels_equal_a_plain_scan(sent, prose):
    rows = [(i, prose(i, 60)) for i in range(20)]
    for j, (_, text) in enumerate(TEMPLATES):
        errors = len(words(text)) // 10
        rows += [(100 + j, f"{prose(j, 30)} {text.upper()}. {prose(j + 50, 30)}"), (200 + j, f"{text} {prose(j, 5)} {text}"), (300 + j, f"{prose(j, 10)}\n{edited(text, j, errors)}\n{prose(j + 9, 10)}"),
                 (400 + j, prose(j, 10) + " " + " ".join(text.split()[:len(text.split()) // 2])), (500 + j, " ".join(sorted(text.split())))]
    rows += [(900, None), (901, ""), (902, "?!"), (903, "MIT"), (904, "The MIT-License and the mit license, mit license"), (905, "general public"), (906, "mit license" * 2)]
    got = rows_of(sent, rows)
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(text)
        must, may = plain_labels(text)
        assert must <= {*r["labels"].split(",")} - {""} <= may and r["labels"] == ",".join(sorted({*r["labels"].split(",")})), (i, text)
        assert r["score"] == 1.0 if r["n_base"] else 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["spans"])
    for j, (label, _) in enumerate(TEMPLATES):
        assert label in got[300 + j]["labels"].split(",")
    assert all(not got[i]["labels"] and got[i]["score"] == 0 for i in range(20))
    at = next(s for s in got[101]["spans"] if s["label"] == "mit")
    assert at["start"] == 30 and at["end"] - at["start"] == len(words(TEMPLATES[1][1])) and at["share"] == 1


def test_repeated_rows_null_ids_clashing_columns_and_long_texts(sent, prose):
    notice = TEMPLATES[1][1]
    long = (prose(1, 200) + " " + notice + " ") * 300
    rows = [(1, notice, 5, "a", "b"), (1, notice, 6, "a", "b"), (None, notice, 5, None, None), (2, long, 1, "", "")]
    df = scan_licenses(sent.createDataFrame(rows, f"{KIND}, row_number int, labels string, spans string")).collect()
    assert len(df) == 4 and all(r["labels"] == "mit" for r in df)
    assert len(next(r for r in df if r["doc_id"] == 2)["spans"]) == 300
    assert scan_licenses(sent.createDataFrame([], KIND)).collect() == []


def test_hot_notice_in_a_third_of_all_rows(sent, prose):
    notice = TEMPLATES[7][1]
    rows = [(i, prose(i, 20) + (" " + notice if i % 3 == 0 else "")) for i in range(900)]
    got = rows_of(sent, rows, parts=7)
    assert all(got[i]["labels"] == ("bsd" if i % 3 == 0 else "") for i in range(900))


@pytest.mark.parametrize("seed", range(20))
def test_common_words(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 9, rng.integers(0, 90)).astype(np.uint64) for _ in range(2))
    assert common_words(a, b) == lcs(a.tolist(), b.tolist())
