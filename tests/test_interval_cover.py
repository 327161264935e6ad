"""Dyadic cover and first-match join against plain joins."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.functions.scalars import DAY, HOUR
from vitalgrid.operators import joins as J
from vitalgrid.operators.windows import Order

T0 = dt.datetime(2024, 1, 1)
POINTS, IVALS = "key int, id int, ts timestamp_ntz", "key int, n int, a timestamp_ntz, z timestamp_ntz"


@pytest.fixture(scope="module")
def data():
    """Half of all points have key 1; intervals last from nothing to two thousand years."""
    rng = random.Random(2)
    key = lambda: 1 if rng.random() < 0.5 else rng.choice((2, 3, 4, None))
    at = lambda: T0 + dt.timedelta(hours=rng.choice((0, 24, 25, rng.randrange(-9000, 9000))))
    points = [(key(), i, at() if rng.random() < 0.97 else None) for i in range(400)]
    points += points[:40]
    ivals = []
    for n in range(70):
        a = at() - dt.timedelta(days=rng.choice((0, 0, 3, 400, 300_000)))
        ivals.append((rng.choice((1, 1, 2, 5, None)), n, a, a + dt.timedelta(hours=rng.choice((-1, 0, 1, 24, 100, 5000, 7_000_000)))))
    return points, ivals


def plain(points, ivals, bounds, how):
    out = []
    for p in points:
        hit = [i for i in ivals if None not in (p[0], i[0], p[2]) and p[0] == i[0] and i[2] <= i[3] and (p[2] >= i[2] if bounds[0] == "[" else p[2] > i[2]) and (p[2] <= i[3] if bounds[1] == "]" else p[2] < i[3])]
        if how in ("inner", "left"):
            out += [(*p, *i[1:]) for i in hit] or ([(*p, None, None, None)] if how == "left" else [])
        elif bool(hit) == (how == "left_semi"):
            out.append(p)
    return sorted(out, key=str)


@pytest.mark.parametrize("bounds", ["[]", "(]", "[)", "()"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dyadic_join(spark, data, bounds, how):
    points, ivals = data
    got = J.dyadic_join(spark.createDataFrame(points, POINTS), spark.createDataFrame(ivals, IVALS), ["key"], "ts", "a", "z", bounds, how, span=DAY if bounds != "[)" else 5 * HOUR)
    assert sorted(map(tuple, got.collect()), key=str) == plain(points, ivals, bounds, how)


def test_cells_cover_exactly_and_are_few(spark):
    rng = random.Random(1)
    rows = [(0, 0), (-1, 0), (-5, 7), (3, 2), (1, 365_250), (-1_000_000, 1_000_000)] + [(a, a + rng.randrange(3000)) for a in (rng.randrange(-5000, 5000) for _ in range(60))]
    df = spark.createDataFrame(rows, "a long, z long").withColumn("c", J._dyadic_cells(F.col("a"), F.col("z"), 28))
    for r in df.collect():
        cells = [(c["number"] << c["level"], (c["number"] + 1) << c["level"]) for c in r["c"]]
        assert len(cells) <= 60 and sum(e - s for s, e in cells) == max(0, r["z"] - r["a"] + 1)
        assert not cells or (min(s for s, _ in cells), max(e for _, e in cells)) == (r["a"], r["z"] + 1)


def test_empty_sides_and_unknown_join(spark, data):
    points, ivals = data
    none, some = spark.createDataFrame([], IVALS), spark.createDataFrame(points, POINTS)
    assert J.dyadic_join(some, none, ["key"], "ts", "a", "z", how="left").count() == J.dyadic_join(some, none, ["key"], "ts", "a", "z", how="left_anti").count() == len(points)
    assert J.dyadic_join(spark.createDataFrame([], POINTS), spark.createDataFrame(ivals, IVALS), ["key"], "ts", "a", "z", how="left").count() == 0
    with pytest.raises(ValueError):
        J.dyadic_join(some, none, ["key"], "ts", "a", "z", how="full")


def test_match_first(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    left = spark.createDataFrame([(1, 10, h(0), h(0)), (1, 11, h(30), h(24)), (1, 12, None, None), (2, 13, h(5), h(0)), (None, 14, h(0), h(0))], "key int, id int, ts timestamp_ntz, day timestamp_ntz")
    right = spark.createDataFrame([(1, 1, h(-2)), (1, 2, h(0)), (1, 3, h(29)), (2, 4, h(5)), (None, 5, h(0))], "key int, n int, at timestamp_ntz")
    soon = lambda n: F.col("at") + F.make_dt_interval(F.lit(0), F.lit(n))
    before = J.Alternative(right.filter("n <> 1"), "ts", F.col("at"), soon(3), "(]", "before")
    after = J.Alternative(right, "ts", soon(-3), F.col("at"), "[)", "after")
    dated = J.Alternative(right.filter("n = 1"), "day", soon(0), soon(48), "[]", "before")
    got = {r["id"]: r for r in J.match_first(left, ["id"], ["key"], [before, dated, after], [Order("at", desc=True), Order("n")], {"n": "n", "when": "at"}).collect()}
    assert {i: (r["before_n"], r["after_n"]) for i, r in got.items()} == {10: (1, None), 11: (3, None), 12: (None, None), 13: (None, None), 14: (None, None)}
    one = J.match_first(left, ["id"], ["key"], [J.Alternative(right, "ts", soon(-9), soon(99))], [Order("n")], {"first": "n"})
    assert {r["id"]: r["first"] for r in one.collect()} == {10: 1, 11: 1, 12: None, 13: 4, 14: None} and one.columns == ["key", "id", "ts", "day", "first"]
    with pytest.raises(ValueError):
        J.match_first(left, ["id"], ["key"], [before], [Order("id")], {"n": "n"})
