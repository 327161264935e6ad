import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitalgrid.functions import scalars as S
from vitalgrid.operators.analytics import chi_square_tail


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("text,value", [("12", 12.0), ("-3.5", -3.5), ("+.5", 0.5), ("1e5", None), ("5.", None), ("", None), ("a1", None), ("1 ", None)])
def test_guarded_number(spark, text, value):
    assert one(spark, v=S.guarded_number(F.lit(text))).v == value


def test_calendar_steps_clamp(spark):
    r = one(spark, y=S.shift(stamp("2180-02-29 10:00:00"), 1, "year"), m=S.shift(stamp("2024-01-31 00:00:00"), 1, "month"), h=S.shift(stamp("2024-01-01 00:00:00"), -30, "hour"))
    assert r.y == dt.datetime(2181, 2, 28, 10) and r.m == dt.datetime(2024, 2, 29) and r.h == dt.datetime(2023, 12, 30, 18)


def test_ceil_hour_keeps_full_hours(spark):
    r = one(spark, a=S.ceil_hour(stamp("2024-01-01 05:00:00")), b=S.ceil_hour(stamp("2024-01-01 05:00:01")))
    assert r.a == dt.datetime(2024, 1, 1, 5) and r.b == dt.datetime(2024, 1, 1, 6)


def test_datetime_diff_is_fractional(spark):
    a, b = stamp("2024-01-02 12:00:00"), stamp("2024-01-01 00:00:00")
    r = one(spark, d=S.datetime_diff(a, b, "day"), h=S.datetime_diff(a, b, "hour"), y=S.datetime_diff(a, b, "year"))
    assert r.d == 1.5 and r.h == 36.0 and abs(r.y - 1.5 / 365.242) < 1e-12


def test_cut_closes_last_bin_only(spark):
    got = [r.b for r in spark.createDataFrame([(0,), (9,), (10,), (20,), (21,)], "v int").select(S.cut("v", [0, 10, 20]).alias("b")).collect()]
    assert got == ["[0,10)", "[0,10)", "[10,20]", "[10,20]", None]


@pytest.mark.parametrize("v,percent", [(0.2, None), (0.21, 21.0), (1.0, 100.0), (1.5, None), (20.0, 20.0), (19.9, None), (100.0, 100.0), (101.0, None)])
def test_fio2_percent(spark, v, percent):
    assert one(spark, v=S.fio2_percent(F.lit(v))).v == percent


def test_fio2_limits_can_move(spark):
    r = one(spark, low=S.fio2_percent(F.lit(0.2), low_inclusive=True), gap=S.fio2_percent(F.lit(20.0), gap_inclusive=False))
    assert r.low == 20.0 and r.gap is None


def test_like_contains_keeps_wildcards_and_case(spark):
    r = one(spark, a=S.like_contains(F.lit("abXcd"), "b_c"), b=S.like_contains(F.lit("ABC"), "b"), c=S.like_contains(F.lit("x1yz2"), "1%2"))
    assert r.a is True and r.b is False and r.c is True


def test_round_dec_is_half_up_on_decimals(spark):
    assert one(spark, v=S.round_dec(F.lit(1.005), 2)).v == 1.01


def test_keywords_are_literal(spark):
    r = one(spark, a=S.any_keyword(F.lit("Bicillin L-A inj"), ["bicillin l-a"]), b=S.any_keyword(F.lit("aXb"), ["a.b"]))
    assert r.a is True and r.b is False


def test_format_and_parse(spark):
    r = one(spark, t=S.format_ts(stamp("2024-03-05 07:08:09"), "%d/%m/%Y %H-%M-%S"), p=S.parse_ts(F.lit("05.03.2024"), "%d.%m.%Y"), n=S.parse_ts(F.lit("x"), "%Y"))
    assert r.t == "05/03/2024 07-08-09" and r.p == dt.datetime(2024, 3, 5) and r.n is None


def test_chi_square_tail_known_values():
    assert abs(chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi_square_tail(18.307038053275146, 10) - 0.05) < 1e-9
    assert chi_square_tail(0.0, 3) == 1.0 and chi_square_tail(None, 1) is None
