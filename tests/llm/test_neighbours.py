import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm.neighbours import Coder, Shard, search


def exact(ids, vectors, k):
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (vectors * vectors[i]).sum(axis=1)
        other = np.flatnonzero(ids != ids[i])
        best = other[np.lexsort((ids[other], -scores[other]))][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(scores[j])) for r, j in enumerate(best)]
    return sorted(out)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 20))
    coder = Coder(vectors, 10)
    shard = Shard(coder, np.arange(700), vectors)
    codes, queries = coder.codes(vectors, False), coder.codes(vectors[:40], True)
    for radius in (0, 3, 17, coder.radius, 8 * coder.bytes):
        coder.radius = radius
        shard = Shard(coder, np.arange(700), vectors)
        for code in queries:
            away = np.unpackbits(codes ^ code, axis=1).sum(axis=1)
            assert shard.within(code).tolist() == np.flatnonzero(away <= radius).tolist()


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(sent, scaled):
    rng = np.random.default_rng(2)
    n = 6000
    vectors = rng.normal(size=(n, 24)) + 2 * rng.normal(size=(12, 24))[rng.integers(0, 12, n)]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if scaled:
        vectors *= rng.uniform(0.5, 2, (n, 1))
    vectors = vectors.astype(np.float32).astype(float)
    vectors[100:400] = vectors[40]  # many equal vectors: ties go to the smaller id
    ids = np.arange(n)
    rows = sent.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(6)
    got = sorted(tuple(r) for r in search(rows, F.col("id") % 20 == 0).collect())
    want = exact(ids, vectors, 20)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.95 * len(want)
    by = {(r[0], r[2]): r[3] for r in want}
    assert all(abs(by[r[0], r[2]] - r[3]) < 1e-12 for r in got if (r[0], r[2]) in by)
    assert [r for r in got if r[0] == 200] == [r for r in want if r[0] == 200]


def test_small_odd_and_empty_tables(sent):
    kind = "vec_id long, embedding array<double>"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (1, [0.5, 0.5])]
    got = sorted(tuple(r) for r in search(sent.createDataFrame(rows, kind), F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 1, 0.5), (20, 3, 0, 0.0)]
    assert search(sent.createDataFrame([], kind), F.col("id") % 20 == 0).count() == 0
    assert search(sent.createDataFrame([(3, [1.0])], kind), F.col("id") % 20 == 0).count() == 0
