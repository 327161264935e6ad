"""Many conditions in one pass against each condition by itself."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import cohort as C
from vitalgrid.operators.cohort import Leaf
from vitalgrid.operators.predicates import KEYS, Condition, match_events
from vitalgrid.operators.shared_scan import SharedScan

T0 = dt.datetime(2024, 1, 1)
CHART = "subject_id long, hadm_id long, stay_id long, itemid int, charttime timestamp_ntz, value string, valuenum double, valueuom string"
LAB = "subject_id long, hadm_id long, itemid int, charttime timestamp_ntz, value string, valuenum double, valueuom string"
DATES = "subject_id long, hadm_id long, stay_id long, itemid int, charttime timestamp_ntz, value timestamp_ntz"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Events of 20 stays; stay 1 holds a third of all rows."""
    folder, rng = str(tmp_path_factory.mktemp("events")), random.Random(5)
    at = lambda: T0 + dt.timedelta(minutes=30 * rng.randrange(0, 120))
    who = lambda: 1 if rng.random() < 0.34 else rng.randrange(2, 21)
    chart, lab, dates = [], [], []
    for _ in range(1500):
        s, v = who(), rng.choice((None, 0.0, 1.0, 5.5, 20.0, 80.0))
        chart.append((s, s, s, rng.randrange(1, 6), at(), rng.choice((None, "1", "0", " yes ", "no", "1e5", "12", "a_b", "50%")), v, None))
        s = who()
        lab.append((s, s if rng.random() < 0.9 else None, rng.randrange(1, 6), at(), rng.choice(("3", "x", None)), rng.choice((None, 1.0, 7.0, 9.0)), None))
        s = who()
        dates.append((s, s, s, rng.randrange(1, 3), at(), at() if rng.random() < 0.9 else None))
    for name, rows, kind in (("chartevents", chart, CHART), ("labevents", lab, LAB), ("datetimeevents", dates, DATES)):
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}")
    return lambda name: spark.read.parquet(f"{folder}/{name}")


@pytest.fixture(scope="module")
def stays(spark):
    return spark.createDataFrame([(s, s, s, T0, T0 + dt.timedelta(hours=8 + s)) for s in range(1, 21)], "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz")


@pytest.fixture(scope="module")
def times(spark):
    return spark.createDataFrame([(s, T0, T0 + dt.timedelta(hours=8 + s)) for s in range(1, 20)], "stay_id long, intime_hr timestamp_ntz, outtime_hr timestamp_ntz")


CONDITIONS = [
    Condition("chartevents", 1, "valuenum", "Exist"), Condition("chartevents", 9, "valuenum", "Exist"), Condition("chartevents", 2, "value", "Contains", "a%b"),
    Condition("chartevents", 2, "value", "Not Contains", "e"), Condition("chartevents", 3, "value", "Is", "YES"), Condition("chartevents", 3, "value", "Is Not", " no ", "max"),
    Condition("chartevents", 4, "value", "Is True"), Condition("chartevents", 4, "valuenum", "Is False", None, "min"), Condition("chartevents", 5, "value", ">=", 12),
    Condition("chartevents", 1, "valuenum", ">", 20, "mean"), Condition("chartevents", 1, "valuenum", "<>", 20, "max", (0, 6)), Condition("chartevents", 1, "valuenum", ">", 60, "sum", (-30, 10)),
    Condition("chartevents", 2, "valuenum", "<=", 5.5, "median"), Condition("chartevents", 2, "valuenum", ">", 5, "median", (2, 9)), Condition("chartevents", 2, "value", "=", 12, "mean"),
    Condition("labevents", 1, "valuenum", ">", 7), Condition("labevents", 2, "valuenum", ">", 6, "mean", (0, 12)), Condition("labevents", 3, "value", "Is", "x"),
    Condition("datetimeevents", 1, "value", "<", "2024-01-02 06:00:00"), Condition("datetimeevents", 2, "value", ">", dt.date(2024, 1, 3), "max"), Condition("datetimeevents", 2, "value", "<>", T0, None, (1, 5)),
]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limited", [False, True])
def test_equals_every_condition_by_itself(spark, tables, stays, times, limited):
    cohort = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (4, 4, 4), (7, 7, 7), (99, 9, 9)], "subject_id long, hadm_id long, stay_id long") if limited else None
    got = SharedScan(tables, stays, times, cohort).many(CONDITIONS).select("__leaf", *KEYS)
    assert got.count() == got.distinct().count()
    want = None
    for i, c in enumerate(CONDITIONS):
        one = match_events(tables(c.table), stays, times, c, cohort).select(F.lit(i).alias("__leaf"), *KEYS)
        want = one if want is None else want.union(one)
    assert found(got) == found(want) and len({r[0] for r in found(got)}) > 12


def test_fifty_leaves_read_two_tables_once_each(tables, stays, times):
    leaves = [Leaf(Condition("chartevents", i % 5 + 1, "valuenum", ">", i, ("mean", "max", None)[i % 3], (0, 24) if i % 2 else None)) for i in range(30)]
    leaves += [Leaf(Condition("labevents", i % 5 + 1, "valuenum", "<", i)) for i in range(20)]
    expr = leaves[0]
    for leaf in leaves[1:]:
        expr = expr | leaf
    df = C.evaluate_expr(expr, SharedScan(tables, stays, times))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("charttime") and df.count() > 0


def test_unmatched_rows_and_refusals(spark, tables, stays, times):
    far = spark.createDataFrame([(1, 1, 9, T0 + dt.timedelta(days=90), "x", 8.0, None)], LAB)
    scan = SharedScan(lambda _: far, stays, None, keep_unmatched=True)
    assert [tuple(r) for r in scan(Condition("labevents", 9, "valuenum", "=", 8)).collect()] == [(None, None, None)]
    with pytest.raises(ValueError):
        scan.many([Condition("labevents", 9, "valuenum", "=", 8, None, (0, 1))])
    with pytest.raises(ValueError):
        scan.many([Condition("labevents", 9, "valuenum", "Contains", "8")])
    with pytest.raises(ValueError):
        scan.many([])


def test_code_list_is_one_join(spark):
    dx = spark.createDataFrame([(1, 1, "A12", 9), (1, 1, "A12", 9), (2, 2, "A1", 9), (3, 3, None, 9), (4, 4, "", 9), (5, 5, "É1", 10), (6, 6, "A12", 10)], "subject_id long, hadm_id long, icd_code string, icd_version int")
    ids = lambda df: sorted(r.hadm_id for r in df.collect())
    codes = [("A", 9), ("A12", 9), ("A1", 9), ("A", 9), ("É", 10)]
    assert ids(C.code_matches(dx, codes, distinct=False)) == sorted([1] * 8 + [2] * 3 + [5]) and ids(C.code_matches(dx, codes)) == [1, 2, 5]
    assert ids(C.code_matches(dx, [("", 9)])) == [1, 2, 4] and ids(C.code_matches(dx, [("A", 9), ("A12", 9)], "AND", strict=True)) == [1]
    many = [(f"{a}{b}{c}", 9) for a in "ABCDEFGHIJ" for b in range(25) for c in range(20)]
    df = C.code_matches(dx, many)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(many) == 5000 and ids(df) == [1] and "StartsWith" not in plan and plan.count(" OR ") == 0
