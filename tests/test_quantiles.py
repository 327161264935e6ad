"""Radix refinement against sorted values, and tail probabilities against known ones."""
import math
import random
import statistics
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import analytics as A
from vitalgrid.operators.quantiles import Levels, exact_quantiles, inner_cell, ranked_values


def values(seed, n):
    rng = random.Random(seed)
    kinds = (lambda: rng.gauss(80, 15), lambda: -rng.random(), lambda: float(rng.randrange(-5, 5)), lambda: 2.0 ** rng.randrange(-1074, 1023), lambda: -(2.0 ** rng.randrange(-1000, 1000)),
             lambda: math.nextafter(8.0, rng.choice((0, 9))), lambda: 1e15 + rng.randrange(3), lambda: 0.0, lambda: -0.0, lambda: math.inf, lambda: -math.inf)
    return [rng.choice(kinds)() for _ in range(n)]


def plain(v, p):
    v, r = sorted(v), p * (len(v) - 1)
    low, high = v[math.floor(r)], v[math.ceil(r)]
    return low if low == high else low + (high - low) * (r - math.floor(r))


@pytest.mark.parametrize("seed", range(3))
def test_any_doubles(spark, seed):
    groups = {g: values(100 * seed + g, n) for g, n in ((1, 2000), (2, 7), (3, 1), (4, 2))}
    rows = [(g, x) for g, all_ in groups.items() for x in all_] + [(1, None)] * 9 + [(5, None)] * 3 + [(None, 4.0)]
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    df = spark.createDataFrame(rows, "g int, v double")
    stats = {"n": "count", "rows": "rows", "low": "min", "high": "max"}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, stats=stats, keep_empty=True).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and got[5]["c"] is None and (got[5]["n"], got[5]["rows"]) == (0, 3) and got[None]["c"] == 4.0
    for g, all_ in groups.items():
        for name, p in probs.items():
            want = plain(all_, p)
            assert got[g][name] == want or math.isnan(want) and math.isnan(got[g][name]), (g, name)
        assert (got[g]["n"], got[g]["low"], got[g]["high"]) == (len(all_), min(all_), max(all_)) and got[g]["rows"] == len(all_) + (9 if g == 1 else 0)
    assert 5 not in {r["g"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}


def test_moments_of_narrow_and_wide_groups(spark):
    rng = random.Random(1)
    groups = {"narrow": [1e9 + rng.random() for _ in range(500)], "wide": [rng.gauss(0, 1e6) for _ in range(500)], "one": [3.5], "same": [7.25] * 40}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}, stats={"mean": "mean", "sd": "sd", "sum": "sum"}).collect()}
    for g, v in groups.items():
        assert math.isclose(got[g]["mean"], statistics.fmean(v), rel_tol=1e-12) and math.isclose(got[g]["sum"], math.fsum(v), rel_tol=1e-12)
        assert got[g]["sd"] is None if len(v) == 1 else math.isclose(got[g]["sd"], statistics.stdev(v), rel_tol=1e-3 if g == "narrow" else 1e-9, abs_tol=1e-6)


def test_cells_keep_the_order(spark):
    v = sorted({x + 0.0 for x in values(9, 3000)} | {math.nextafter(2.0 ** e, d) for e in range(-60, 60) for d in (-math.inf, math.inf)} | {2.0 ** e for e in range(-60, 60)})
    df = spark.createDataFrame([(x,) for x in v] + [(math.nan,)], "v double")
    cells = [r["c"] for r in df.orderBy("v").select(inner_cell(F.col("v")).alias("c")).collect()]
    assert cells == sorted(cells) and spark.range(1).select(inner_cell(F.lit(None).cast("double"))).first()[0] is None


def test_one_group_with_many_values_spreads(spark):
    df = spark.range(0, 400_000, 1, 8).select(F.lit(1).alias("g"), (F.rand(3) * 100 + 50).alias("v"))
    n = [r["count"] for r in Levels(df, ["g"], "v").values.repartition(8, "__g", "__p2").groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) == 8 and max(n) < 2 * sum(n) / 8
    plan = exact_quantiles(df, ["g"], "v", {"m": 0.5}, count="n")
    assert plan.first()["n"] == 400_000


def test_ranks(spark):
    rows = [(g, x) for g, all_ in {"a": values(4, 800), "b": [1.0, 1.0, 2.0]}.items() for x in all_] + [("a", None)]
    got = {(r["g"], r["v"]): (r["below"], r["n"]) for r in ranked_values(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in "ab":
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert {x: t for (h, x), t in got.items() if h == g} == {x: (bisect_left(v, x), bisect_right(v, x) - bisect_left(v, x)) for x in v}


def test_groups_without_values_stay_in_bins(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 2, 6.0), ("b", 1, None)], "interval string, stay_id int, value double")
    assert sorted(map(tuple, A.aggregate_bins(df, ["interval", "stay_id"], "median").collect())) == [("a", 1, None), ("a", 2, 5.5), ("b", 1, None)]
    assert sorted(map(tuple, A.box_stats(df, ["interval"], "value").collect())) == [("a", 2, 5.0, 5.25, 5.5, 5.75, 6.0), ("b", 0, None, None, None, None, None)]


#: (statistic, degrees of freedom, upper tail), from printed tables and closed forms.
TAILS = [(3.841458820694124, 1, 0.05), (6.634896601021213, 1, 0.01), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (24.995790139728616, 15, 0.05),
         (124.34211340400407, 100, 0.05), (0.0, 4, 1.0), (-0.5, 3, 1.0), (2.0, 2, math.exp(-1)), (1600.0, 2, math.exp(-800)), (0.1, 1, math.erfc(math.sqrt(0.05))), (60.0, 1, math.erfc(math.sqrt(30.0))),
         (3.9, 1, math.erfc(math.sqrt(1.95))), (4.1, 1, math.erfc(math.sqrt(2.05)))]


def test_chi_square_tail(spark):
    df = spark.createDataFrame([(i, float(s), d) for i, (s, d, _) in enumerate(TAILS)] + [(99, None, 3), (98, 5.0, 0), (97, 2000.0, 2000), (96, 2001.0, 2001)], "i int, s double, d int")
    got = {r["i"]: r["p"] for r in df.select("i", A.chi_square_tails(F.col("s"), F.col("d")).alias("p")).collect()}
    for i, (_, _, p) in enumerate(TAILS):
        assert math.isclose(got[i], p, rel_tol=1e-9, abs_tol=1e-300), TAILS[i]
        assert math.isclose(A.chi_square_tail(*TAILS[i][:2]), p, rel_tol=1e-9, abs_tol=1e-300)
    assert got[99] is None and got[98] is None and 0.49 < got[97] < 0.5 and 0.49 < got[96] < 0.5
