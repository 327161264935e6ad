import re

import numpy as np
import pyarrow as pa

from vitalgrid.llm.words import ALPHANUMERIC, SPACED, Words, ranges, small_batches, windows

TEXTS = ["Hello wörld  foo\tBar", "", None, " x ", "abc", "abc abd acb Abc", "a" * 5, "\n", " é z", "tab\x0bvt\x1cfs", "x" * 300_000 + " y"]


def plain(text, pattern):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(pattern, low)


def test_words_follow_the_patterns():
    for inside, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for texts in (TEXTS, TEXTS[::-1], [], [None], [""]):
            words = Words(pa.array(texts, pa.string()), inside)
            got = [[words.word(k).decode() for k in range(words.first[i], words.first[i + 1])] for i in range(len(texts))]
            assert got == [plain(t, pattern) for t in texts]


def test_equal_words_have_equal_hashes_anywhere():
    words = Words(pa.array(["one two three", "three one", "x" * 500_000 + " two"]))
    by = {}
    for i, h in enumerate(words.hashes().tolist()):
        by.setdefault(words.word(i), set()).add(h)
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def test_sliced_columns_and_small_batches():
    column = pa.array(TEXTS, pa.string())
    assert len(Words(column.slice(3, 3))) == len(Words(pa.array(TEXTS[3:6], pa.string())))
    batch = pa.record_batch([column], ["text"])
    parts = list(small_batches(iter([batch]), "text", 50))
    assert [t for p in parts for t in p.column(0).to_pylist()] == TEXTS and len(parts) > 1


def test_windows_and_ranges():
    values = np.arange(6, dtype=np.uint64)
    assert len(windows(values, 5)) == 2 and len(windows(values, 7)) == 0
    assert windows(values, 5)[1] == windows(values[1:], 5)[0]
    assert ranges(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
