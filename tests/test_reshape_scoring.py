import datetime as dt

from pyspark.sql import functions as F

from vitalgrid.concepts import definitions as D
from vitalgrid.functions.scalars import HOUR
from vitalgrid.operators import reshape as R
from vitalgrid.operators.scoring import CodeRule, RuleScore, add_scores, code_flags, worst_of

T0 = dt.datetime(2024, 1, 1)
h = lambda n: T0 + dt.timedelta(hours=n)


def test_grid_starts_a_day_early_and_ends_at_the_last_started_hour(spark):
    d = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=10), h(2)), (2, T0, None)], "stay_id int, a timestamp_ntz, z timestamp_ntz")
    rows = R.hourly_grid(d, ["stay_id"], "a", "z").orderBy("hr").collect()
    assert [r.hr for r in rows] == list(range(-24, 3)) and {r.stay_id for r in rows} == {1}
    assert {r.hr: r.endtime for r in rows}[0] == h(1)


def test_hours_of_a_point(spark):
    d = spark.createDataFrame([(h(3),), (h(3) + dt.timedelta(seconds=1),)], "t timestamp_ntz").withColumn("a", F.lit(T0).cast("timestamp_ntz"))
    rows = d.select(R.hour_index("t", "a").alias("i"), R.hours_touching("t", "a").alias("both")).collect()
    assert [(r.i, r.both) for r in rows] == [(3, [3, 4]), (4, [4])]


def test_episode_breaks_at_fourteen_hours(spark):
    d = spark.createDataFrame([(1, h(0), "x"), (1, h(2), "x"), (1, h(16), "x"), (1, h(17), "x"), (1, h(18), "y")], "k int, t timestamp_ntz, s string")
    got = sorted((r.starttime, r.endtime, r.s) for r in R.gap_episodes(d, ["k"], "t", "s", 14 * HOUR).collect())
    assert got == [(h(0), h(2), "x"), (h(16), h(18), "x")]
    whole = sorted((r.starttime, r.endtime, r.s) for r in R.gap_episodes(d, ["k"], "t", "s", 14 * HOUR, drop_points=False).collect())
    assert whole[-1] == (h(18), h(18), "y") and len(whole) == 3


def test_episode_continues_just_below_the_gap(spark):
    d = spark.createDataFrame([(1, h(0), "x"), (1, h(14) - dt.timedelta(seconds=1), "x")], "k int, t timestamp_ntz, s string")
    assert R.gap_episodes(d, ["k"], "t", "s", 14 * HOUR).count() == 1


def test_segments_cover_without_overlap(spark):
    d = spark.createDataFrame([(1, h(0), h(4)), (1, h(2), h(6)), (1, h(9), h(10))], "stay_id int, starttime timestamp_ntz, endtime timestamp_ntz")
    got = [(r.starttime.hour, r.endtime.hour) for r in R.segment_intervals({"d": d}).orderBy("starttime").collect()]
    assert got == [(0, 2), (2, 4), (4, 6), (6, 9), (9, 10)]


def test_pivot_limits_and_scale(spark):
    d = spark.createDataFrame([(1, 10, 5.0), (1, 10, 7.0), (1, 11, 2000.0), (2, 10, None)], "k int, itemid int, valuenum double")
    cols = [R.ItemCol("a", (10,), lt=7.0), R.ItemCol("b", (10, 11), scale={11: 1000.0})]
    got = {r.k: (r.a, r.b) for r in R.pivot_events(d, ["k"], cols).collect()}
    assert got == {1: (5.0, 7.0), 2: (None, None)}


def score(spark, rules, **values):
    d = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in values.items()])
    return add_scores(d, [rules]).first()[rules.name]


def test_sofa_thresholds(spark):
    coag, liver, cns = D.SOFA[1], D.SOFA[2], D.SOFA[4]
    assert [score(spark, coag, platelet_min=v) for v in (19.9, 20, 50, 100, 150, None)] == [4, 3, 2, 1, 0, None]
    assert [score(spark, liver, bilirubin_max=v) for v in (12, 11.9, 2, 1.2, 1.1, None)] == [4, 3, 2, 1, 0, None]
    assert [score(spark, cns, gcs_min=v) for v in (15, 14, 10, 9, 5, None)] == [0, 1, 2, 3, 4, None]


def test_sofa_respiration_prefers_ventilated_values(spark):
    r = D.SOFA[0]
    assert score(spark, r, pao2fio2ratio_vent=99, pao2fio2ratio_novent=None) == 4
    assert score(spark, r, pao2fio2ratio_vent=None, pao2fio2ratio_novent=99) == 2
    assert score(spark, r, pao2fio2ratio_vent=None, pao2fio2ratio_novent=None) is None


def test_oasis_age_gap_between_89_and_90(spark):
    age = next(s for s in D.OASIS if s.name == "age_score")
    assert [score(spark, age, age=v) for v in (23.9, 53, 77, 89, 89.5, 90)] == [0, 3, 6, 9, 0, 7]


def test_coma_table_has_impossible_cells(spark):
    assert score(spark, D.APS_GCS, gcs_unable=0, gcs_eyes=1, gcs_verbal=2, gcs_motor=6) is None
    assert score(spark, D.APS_GCS, gcs_unable=0, gcs_eyes=4, gcs_verbal=5, gcs_motor=6) == 0
    assert score(spark, D.APS_GCS, gcs_unable=1, gcs_eyes=1, gcs_verbal=1, gcs_motor=1) == 0


def test_acid_base_table(spark):
    s = lambda ph, c: score(spark, D.APS_ACID, ph=ph, pco2=c)
    assert [s(7.1, 49), s(7.1, 50), s(7.32, 44), s(7.32, 45), s(7.7, 24), s(7.7, 60), s(None, 40)] == [12, 4, 0, 1, 0, 12, None]


def test_worst_of_takes_further_value_and_higher_points_on_ties(spark):
    w = worst_of("lo", "hi", 75, "lp", "hp").column()
    d = spark.createDataFrame([(70.0, 90.0, 1, 2), (50.0, 90.0, 1, 2), (60.0, 90.0, 5, 2), (60.0, None, 1, 2)], "lo double, hi double, lp int, hp int")
    assert [r.p for r in d.select(w.alias("p")).collect()] == [2, 1, 5, None]


def test_rule_score_first_match_wins_and_sql_agrees(spark):
    rule = RuleScore("p", (("x IS NULL", None), ("x < 1", 3), ("x < 2", 2)), 0)
    d = spark.createDataFrame([(None,), (0.5,), (1.5,), (9.0,)], "x double")
    assert [r.p for r in d.select(rule.column().alias("p")).collect()] == [r.p for r in d.select(F.expr(rule.sql()).alias("p")).collect()] == [None, 3, 2, 0]


def test_code_flags_need_equal_version_and_whole_range(spark):
    dx = spark.createDataFrame([(1, "4254", 9), (2, "42599", 9), (3, "4253", 9), (4, "428", 10), (5, "I509", 10)], "hadm_id int, icd_code string, icd_version int")
    rule = CodeRule(("428",), ("I50",), (("4254", "4259"),))
    got = {r.hadm_id: r.f for r in code_flags(dx, ["hadm_id"], {"f": rule}).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
