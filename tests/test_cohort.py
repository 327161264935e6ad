import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import cohort as C
from vitalgrid.operators.analytics import assign_strata
from vitalgrid.operators.cohort import Both, Either, Leaf, fold_right
from vitalgrid.operators.predicates import Condition, match_events

T0 = dt.datetime(2024, 1, 1)
h = lambda n: T0 + dt.timedelta(hours=n)
CHART = "subject_id long, hadm_id long, stay_id long, itemid long, charttime timestamp_ntz, value string, valuenum double, valueuom string"


@pytest.fixture(scope="module")
def stays(spark):
    return spark.createDataFrame([(1, 1, 1, h(0), h(48)), (1, 1, 2, h(72), h(90)), (2, 2, 3, h(0), h(10))],
                                 "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz")


@pytest.fixture(scope="module")
def times(spark):
    return spark.createDataFrame([(1, h(0), h(48)), (2, h(72), h(90)), (3, h(0), h(10))], "stay_id long, intime_hr timestamp_ntz, outtime_hr timestamp_ntz")


@pytest.fixture(scope="module")
def chart(spark):
    rows = [(1, 1, 1, 7, h(1), "12", 12.0, None), (1, 1, 1, 7, h(2), "1e5", 20.0, None), (2, 2, 3, 7, h(3), None, None, None), (2, 2, 3, 8, h(3), " yes ", None, None)]
    return spark.createDataFrame(rows, CHART)


def stay_ids(df):
    return sorted(r.stay_id for r in df.collect())


def test_exist_counts_null_values(chart, stays):
    assert stay_ids(match_events(chart, stays, None, Condition("chartevents", 7, "valuenum", "Exist"))) == [1, 3]


def test_text_number_rejects_exponents(chart, stays):
    assert stay_ids(match_events(chart, stays, None, Condition("chartevents", 7, "value", ">", 50))) == []


def test_text_constraint_ignores_aggregate(chart, stays):
    assert stay_ids(match_events(chart, stays, None, Condition("chartevents", 8, "value", "Is", "YES", agg="max"))) == [3]


def test_event_on_the_hour_counts_twice_in_a_sum(chart, stays, times):
    cond = lambda v: Condition("chartevents", 7, "valuenum", ">=", v, "sum", (0, 10))
    assert stay_ids(match_events(chart, stays, times, cond(64))) == [1]
    assert stay_ids(match_events(chart, stays, times, cond(65))) == []


def test_hour_window_is_closed_at_both_ends(chart, stays, times):
    hit = lambda a, b: stay_ids(match_events(chart, stays, times, Condition("chartevents", 7, "valuenum", "=", 20, hours=(a, b))))
    assert hit(2, 2) == [1] and hit(3, 3) == [1] and hit(4, 9) == [] and hit(-30, 1) == []


def test_hospital_event_takes_the_stay_that_holds_it(spark, stays):
    lab = spark.createDataFrame([(1, 1, h(-24), 5.0), (1, 1, h(49), 6.0), (1, 1, h(47), 7.0), (1, None, h(5), 8.0)], "subject_id long, hadm_id long, charttime timestamp_ntz, valuenum double")
    lab = lab.withColumn("itemid", F.lit(9)).withColumn("value", F.lit("x"))
    hit = lambda v, **kw: stay_ids(match_events(lab, stays, None, Condition("labevents", 9, "valuenum", "=", v), **kw))
    assert hit(5) == [1] and hit(6) == [1, 2] and hit(7) == [1] and hit(8) == []
    kept = match_events(lab, stays, None, Condition("labevents", 9, "valuenum", "=", 8), keep_unmatched=True).collect()
    assert [tuple(r) for r in kept] == [(None, None, None)]


@pytest.mark.parametrize("bad", [Condition("nothing", 1, "value", "Exist"), Condition("chartevents", "1 OR 1=1", "value", "Exist"), Condition("chartevents", 1, "stay_id", "Exist"),
                                 Condition("chartevents", 1, "value", "Near"), Condition("chartevents", 1, "value", "=", 1, "mode")])
def test_bad_conditions_are_refused(bad):
    with pytest.raises(ValueError):
        bad.check()


def test_text_test_on_a_number_is_refused(chart, stays):
    with pytest.raises(ValueError):
        match_events(chart, stays, None, Condition("chartevents", 7, "valuenum", "Contains", "1"))


def test_fold_right_has_no_precedence():
    a, b, c = (Leaf(Condition("chartevents", i, "value", "Exist")) for i in (1, 2, 3))
    assert fold_right([a, "&", b, "|", c]) == Both(a, Either(b, c))
    assert fold_right([a, b]) == Either(a, b)
    with pytest.raises(ValueError):
        fold_right(["&", a])


def keys(spark, *rows):
    return spark.createDataFrame(list(rows), "subject_id long, hadm_id long, stay_id long")


def test_and_or(spark):
    a, b = keys(spark, (1, 1, 1), (1, 1, None), (2, 2, 2)), keys(spark, (1, 1, 1), (1, 1, None), (3, 3, 3))
    both, either = C.and_(a, b), C.or_(a, b)
    assert both.count() == 2 and either.count() == 4
    assert both.exceptAll(either).count() == 0
    hosp = b.select("subject_id", "hadm_id").distinct()
    assert sorted(str(r.stay_id) for r in C.and_(a, hosp).collect()) == ["1", "None"]
    assert C.or_(a, hosp).count() == 4


def test_expression_matches_pairwise_algebra(spark):
    sets = {i: keys(spark, *rows) for i, rows in {1: [(1, 1, 1), (2, 2, 2)], 2: [(1, 1, 1)], 3: [(2, 2, 2), (3, 3, 3)]}.items()}
    a, b, c = (Leaf(Condition("chartevents", i, "value", "Exist")) for i in (1, 2, 3))
    got = C.evaluate_expr(a & (b | c), lambda cond: sets[cond.itemid])
    assert stay_ids(got) == stay_ids(C.and_(sets[1], C.or_(sets[2], sets[3]))) == [1, 2]
    assert stay_ids(C.evaluate_expr((a & b) | c, lambda cond: sets[cond.itemid])) == [1, 2, 3]


def test_code_and_counts_rows_unless_strict(spark):
    dx = spark.createDataFrame([(1, 1, "A1", 9), (1, 1, "A2", 9), (2, 2, "A1", 9), (2, 2, "B", 10), (3, 3, "A1", 10)], "subject_id long, hadm_id long, icd_code string, icd_version int")
    codes = [("A", 9), ("B", 10)]
    ids = lambda df: sorted(r.hadm_id for r in df.collect())
    assert ids(C.code_matches(dx, codes)) == [1, 2]
    assert ids(C.code_matches(dx, codes, "AND")) == [1, 2]
    assert ids(C.code_matches(dx, codes, "AND", strict=True)) == [2]
    assert ids(C.icd_filter(dx.select("subject_id", "hadm_id").distinct(), dx, deny=codes, deny_mode="AND", strict=True)) == [1, 3]


def test_strata_are_disjoint_and_first_wins(spark):
    cohort = keys(spark, (1, 1, 1), (2, 2, 2), (3, 3, 3))
    out = assign_strata(cohort, [("x", cohort.filter("stay_id <= 2")), ("", cohort.filter("stay_id = 2 or stay_id = 3"))])
    assert {r.stay_id: r.strat for r in out.collect()} == {1: "x", 2: "x", 3: "Stratification 2"}
