import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.concepts import definitions as D
from vitalgrid.concepts import firstday, measurements, scores
from vitalgrid.operators.predicates import Condition, match_events
from vitalgrid.operators.shared_scan import SharedScan
from vitalgrid.operators.sums import BINADE, binade, exact_count, exact_sum, partial_sums
from vitalgrid.sources.catalog import Catalog

T0 = dt.datetime(2024, 1, 1)
at = lambda **k: T0 + dt.timedelta(**k)
CHART = "subject_id long, hadm_id long, stay_id long, itemid long, charttime timestamp_ntz, storetime timestamp_ntz, value string, valuenum double, valueuom string"
STAYS = "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz"


def catalog(spark, builders, **tables):
    return Catalog(spark, tables.__getitem__, builders)


def test_sums_are_those_of_fsum(spark):
    chance = random.Random(5)
    groups = [[chance.uniform(-1, 1) * 10.0 ** chance.randint(-20, 20) for _ in range(200)] for _ in range(5)] + [[0.0, 0.0], [1e16, 1.0, -1e16], [0.1] * 10, [5e-324, 1.0]]
    rows = [(g, x) for g, xs in enumerate(groups) for x in xs] + [(99, None), (98, math.inf), (98, 1.0)]
    d = spark.createDataFrame(rows, "g int, v double").repartition(7).withColumn(BINADE, binade("v"))
    got = {r["g"]: (r["s"], r["n"]) for r in d.groupBy("g", BINADE).agg(*partial_sums("v")).groupBy("g").agg(exact_sum().alias("s"), exact_count().alias("n")).collect()}
    assert {g: got[g] for g in range(len(groups))} == {g: (math.fsum(xs), len(xs)) for g, xs in enumerate(groups)}
    assert got[99] == (None, None) and got[98] == (math.inf, 2)


@pytest.mark.parametrize("agg,limit", [("sum", 0.5), ("mean", 0.2)])
def test_aggregates_do_not_depend_on_row_order(spark, agg, limit):
    rows = [(1, 1, stay, 7, T0, T0, None, v, None) for stay, vs in enumerate(([1.0, 1e16, -1e16], [1e16, 1.0, -1e16], [1e16, -1e16, 1.0])) for v in vs]
    chart = spark.createDataFrame(rows, CHART).coalesce(1)
    stays = spark.createDataFrame([(1, 1, s, T0, T0) for s in range(3)], STAYS)
    cond = Condition("chartevents", 7, "valuenum", ">", limit, agg)
    assert {r["stay_id"] for r in match_events(chart, stays, None, cond).collect()} == {0, 1, 2}
    assert {r["stay_id"] for r in SharedScan({"chartevents": chart}.__getitem__, stays)(cond).collect()} == {0, 1, 2}


def test_weight_means_do_not_depend_on_row_order(spark):
    weights = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
    stays = spark.createDataFrame([(1, 1, s, T0, at(days=2)) for s in range(12)], STAYS)
    chance, rows = random.Random(1), []
    for s in range(12):
        chance.shuffle(weights)
        rows += [(s, T0, w, "daily") for w in weights]
    w = spark.createDataFrame(rows, "stay_id long, starttime timestamp_ntz, weight double, weight_type string").coalesce(1)
    got = firstday.first_day_weight(catalog(spark, {"weight_durations": lambda cat: w}, icustays=stays)).collect()
    assert {(r["weight_admit"], r["weight"], r["weight_min"], r["weight_max"]) for r in got} == {(None, math.fsum(weights) / 7, 0.1, 0.7)}


def uneven(total: int) -> list[int]:
    """Gaps in seconds of exactly `total`, whose lengths in minutes and in hours (after one hour), added as doubles, fall short of it."""
    chance = random.Random(3)
    while True:
        cuts = sorted(chance.sample(range(3601, total), 9))
        gaps = [b - a for a, b in zip([0, *cuts], [*cuts, total])]
        minutes, hours = 0.0, 1.0
        for g in gaps:
            minutes, hours = minutes + g / 60, hours + g / 3600
        if minutes < total / 60 and hours < total / 3600 + 1:
            return gaps


def test_documented_time_that_just_suffices(spark):
    gaps = uneven(24 * 3600)
    ends = [at(seconds=sum(gaps[:i + 1])) for i in range(len(gaps))]
    stays = spark.createDataFrame([(1, 1, 1, T0, at(days=3))], STAYS)
    hr = spark.createDataFrame([(1, 1, 1, D.HEART_RATE, T0, T0, None, 80.0, None)], CHART)
    weight = spark.createDataFrame([(1, at(days=-1), at(days=9), 50.0)], "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, weight double")
    outputs = lambda times: spark.createDataFrame([(1, t, 100.0) for t in times], "stay_id long, charttime timestamp_ntz, urineoutput double")
    built = lambda times: catalog(spark, {"urine_output": lambda c: outputs(times), "weight_durations": lambda c: weight}, icustays=stays, chartevents=hr)
    # the first gap starts at the first heart rate, the 23 h before the last output hold all ten outputs
    last = measurements.urine_output_rate(built(ends)).orderBy(F.desc("charttime")).first()
    assert (last["uo_tm_24hr"], last["uo_mlkghr_24hr"]) == (24.0, round(1000 / 50 / 24, 4))
    # the first output counts for one hour
    last = scores.kdigo_uo(built([T0, *ends])).orderBy(F.desc("charttime")).first()
    assert last["uo_tm_24hr"] == 25.0


def test_flows_stored_at_one_time(spark):
    rows = [(1, 1, stay, D.O2_FLOW, T0, T0, str(v), v, None) for stay, v in ((4, 2.0), (5, 3.0), (5, 1.0))]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        chart = spark.createDataFrame(order, CHART).coalesce(1)
        got = measurements.oxygen_delivery(catalog(spark, {}, chartevents=chart)).collect()
        assert [(r["stay_id"], r["o2_flow"]) for r in got] == [(5, 3.0)]
