"""Span-wise windows and bucketed joins equal the plain ones, also when one key holds most rows."""
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalgrid.functions.scalars import DAY, HOUR
from vitalgrid.operators import joins as J
from vitalgrid.operators import windows as W
from vitalgrid.operators.quantiles import exact_quantiles
from vitalgrid.operators.windows import Agg, Order

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(7)
    rows, seen = [], set()
    for i in range(900):
        key = 1 if rnd.random() < 0.5 else rnd.randrange(2, 9)
        sec = rnd.randrange(0, 12 * 86400) if rnd.random() < 0.9 else rnd.randrange(0, 200) * 3600
        if (key, sec) in seen:
            continue
        seen.add((key, sec))
        rows.append((i, key, T0 + dt.timedelta(seconds=sec), None if rnd.random() < 0.1 else float(rnd.randrange(100)), rnd.choice("abc")))
    return spark.createDataFrame(rows, "id int, key int, ts timestamp_ntz, v double, s string").cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    left, right = (sorted((tuple(r) for r in df.select(*cols).collect()), key=key) for df in (a, b))
    assert left == right


def plain():
    return Window.partitionBy("key").orderBy("ts")


@pytest.mark.parametrize("span", [None, 7 * HOUR, 6 * HOUR])
def test_range_window(events, span):
    got = W.range_window(events, ["key"], "ts", {"a": Agg("sum", "v", -6 * HOUR), "b": Agg("min", "v", -5 * HOUR, -1), "n": Agg("count", "v", -HOUR)}, span)
    d = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("key").orderBy("us")
    want = d.select(*events.columns, F.sum("v").over(w.rangeBetween(-6 * HOUR, 0)).alias("a"), F.min("v").over(w.rangeBetween(-5 * HOUR, -1)).alias("b"),
                    F.count("v").over(w.rangeBetween(-HOUR, 0)).alias("n"))
    same(got, want)


@pytest.mark.parametrize("span", [None, HOUR, 400 * DAY])
def test_neighbours(events, span):
    got = W.neighbours(events, ["key"], "ts", lag={"pv": "v", "ps": "s"}, lead={"nt": "ts"}, span=span)
    same(got, events.select("*", F.lag("v").over(plain()).alias("pv"), F.lag("s").over(plain()).alias("ps"), F.lead("ts").over(plain()).alias("nt")))


@pytest.mark.parametrize("span", [None, 3 * HOUR])
def test_running_sum_and_row_numbers(events, span):
    d = events.withColumn("w", F.col("id") % 5)
    same(W.running_sum(d, ["key"], "ts", "w", "r", span), d.select("*", F.sum("w").over(plain()).alias("r")))
    same(W.row_numbers(d, ["key"], "ts", "n", span=span), d.select("*", F.row_number().over(plain()).cast("long").alias("n")))


def test_running_sum_shares_ties(spark):
    d = spark.createDataFrame([(1, T0, 1), (1, T0, 2), (1, T0 + dt.timedelta(days=3), 4)], "key int, ts timestamp_ntz, w int")
    assert sorted(r.r for r in W.running_sum(d, ["key"], "ts", "w", "r").collect()) == [3, 3, 7]


def test_rolling_rows(events):
    same(W.rolling_rows(events, ["key"], "ts", 5, {"m": ("max", "v")}), events.select("*", F.max("v").over(plain().rowsBetween(-4, 0)).alias("m")))


def test_carry_previous_needs_a_recent_row(spark):
    six = dt.timedelta(hours=6)
    d = spark.createDataFrame([(1, T0, 1.0), (1, T0 + six, 2.0), (1, T0 + 2 * six - dt.timedelta(seconds=1), 3.0)], "key int, ts timestamp_ntz, v double")
    got = [(r.v, r.p) for r in W.carry_previous(d, ["key"], "ts", {"p": "v"}, 6 * HOUR).orderBy("ts").collect()]
    assert got == [(1.0, None), (2.0, None), (3.0, 2.0)]


def test_top1_null_order(events):
    for order, col in (([Order("v"), Order("id")], F.col("v").asc_nulls_last()), ([Order("v", desc=True), Order("id")], F.col("v").desc_nulls_last()),
                       ([Order("v", nulls_first=True), Order("id")], F.col("v").asc_nulls_first())):
        want = events.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(col, "id"))).filter("rn = 1").drop("rn")
        same(W.top1(events, ["key"], order), want)


def test_top_k(events):
    w = Window.partitionBy("key").orderBy(F.col("v").desc_nulls_last(), "id")
    same(W.top_k(events, ["key"], 4, [Order("v", desc=True), Order("id")]), events.withColumn("rank", F.row_number().over(w)).filter("rank <= 4"))


def test_sequence_flags_with_nulls(spark):
    d = spark.createDataFrame([(1, T0), (1, T0), (1, None), (1, T0 + dt.timedelta(days=9)), (2, T0)], "key int, ts timestamp_ntz")
    w = Window.partitionBy("key").orderBy(F.col("ts").asc_nulls_first())
    want = d.withColumn("seq", F.dense_rank().over(w).cast("long")).withColumn("first", F.col("seq") == 1)
    same(W.sequence_flags(d, ["key"], "ts", "seq", "first"), want)


@pytest.mark.parametrize("bounds", ["[]", "(]", "[)", "()"])
@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_interval_join(spark, events, bounds, how):
    rnd = random.Random(3)
    runs = [(rnd.choice([1, 1, 2, 3, 12]), n, T0 + dt.timedelta(hours=rnd.randrange(280))) for n in range(60)]
    ivals = spark.createDataFrame([(k, n, a, a + dt.timedelta(hours=rnd.randrange(0, 90))) for k, n, a in runs], "key int, n int, a timestamp_ntz, z timestamp_ntz")
    lo = F.col("ts") >= F.col("a") if bounds[0] == "[" else F.col("ts") > F.col("a")
    hi = F.col("ts") <= F.col("z") if bounds[1] == "]" else F.col("ts") < F.col("z")
    right = ivals.withColumnRenamed("key", "k2")
    want = events.join(right, (F.col("key") == F.col("k2")) & lo & hi, how).drop("k2")
    same(J.interval_join(events, ivals, ["key"], "ts", "a", "z", bounds, how), want)
    same(J.interval_join(events, ivals, ["key"], "ts", "a", "z", bounds, how, span=5 * HOUR), want)


def test_interval_join_skips_reversed_intervals(spark):
    p = spark.createDataFrame([(1, T0)], "key int, ts timestamp_ntz")
    i = spark.createDataFrame([(1, T0 + dt.timedelta(days=9), T0)], "key int, a timestamp_ntz, z timestamp_ntz")
    assert J.interval_join(p, i, ["key"], "ts", "a", "z").count() == 0


def test_asof_join(events):
    left = events.filter("s = 'a'").select("id", "key", "ts")
    right = events.filter("s = 'b'").select("key", F.col("ts").alias("rt"), "v")
    got = J.asof_join(left, right, ["key"], "ts", 9 * HOUR, {"rv": "v", "at": "rt"}, right_ts="rt")
    r = right.withColumnRenamed("key", "k2")
    near = (F.col("rt") <= F.col("ts")) & (F.col("rt") >= F.col("ts") - F.expr("interval 9 hours")) & (F.col("key") == F.col("k2"))
    w = Window.partitionBy("id").orderBy(F.col("rt").desc_nulls_last())
    want = left.join(r, near, "left").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "key", "ts", F.col("v").alias("rv"), F.col("rt").alias("at"))
    same(got, want)


def test_contained_join(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    segs = spark.createDataFrame([(1, h(1), h(2)), (1, h(2), h(5)), (2, h(1), h(2))], "key int, a timestamp_ntz, z timestamp_ntz")
    runs = spark.createDataFrame([(1, h(0), h(2), "x"), (1, h(1), h(5), "y")], "key int, s timestamp_ntz, e timestamp_ntz, n string")
    got = sorted((r.key, r.a.hour, r.n or "") for r in J.contained_join(segs, runs, ["key"], ("a", "z"), ("s", "e")).collect())
    assert got == [(1, 1, "x"), (1, 1, "y"), (1, 2, "y"), (2, 1, "")]


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "x int, y int")
    assert J.null_safe_join(a, a, ["x", "y"]).count() == 2


@pytest.mark.parametrize("probs", [{"a": 0.0, "b": 0.5, "c": 1.0}, {"a": 0.25, "b": 0.75, "c": 0.9}])
def test_exact_quantiles(spark, events, probs):
    got = exact_quantiles(events, ["key"], "v", probs, count="n")
    want = events.filter("v is not null").groupBy("key").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()], F.count("v").alias("n"))
    rounded = lambda df: df.select("key", "n", *[F.round(c, 9).alias(c) for c in probs])
    same(rounded(got), rounded(want))


def test_exact_quantiles_null_group_and_heavy_value(spark):
    d = spark.createDataFrame([(None, 1.0)] * 50 + [(None, 2.0)] + [("g", float(i)) for i in range(2001)], "g string, v double")
    got = {r.g: r.m for r in exact_quantiles(d, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: 1.0, "g": 1000.0}


@pytest.fixture(scope="module")
def sparse(spark):
    """One key with a single row in most of its spans, over all of the number range, and some small ones."""
    rng = random.Random(8)
    rows = [(1, i, rng.choice((-1, 1)) * rng.randrange(2 ** rng.randrange(1, 62)), rng.choice((None, 1, 2, 7))) for i in range(1500)] + [(k, 5000 + k, 5 * k, 3) for k in (2, 3)]
    return spark.createDataFrame(rows + [(1, 9000, None, 1), (4, 9001, None, 1)], "key int, id int, pos long, v int")


def test_sparse_numbers_in_levels(sparse):
    assert W._levels(sparse, "pos", None) == 2 and W._levels(sparse.withColumn("t", F.current_timestamp()), "t", None) == 0
    w = Window.partitionBy("key").orderBy("pos", "id")
    want = sparse.withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w))
    same(W.neighbours(sparse, ["key"], "pos", lag={"before": "id"}, lead={"after": "id"}, tie=["id"]), want)
    same(W.row_numbers(sparse, ["key"], "pos", "n", tie=["id"]), sparse.withColumn("n", F.row_number().over(w).cast("long")))
    known = sparse.filter("pos is not null")
    running = Window.partitionBy("key").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    same(W.running_sum(known, ["key"], "pos", "v", "s"), known.withColumn("s", F.sum("v").over(running)))


@pytest.mark.parametrize("bits", [1, 3])
def test_times_in_many_levels(events, monkeypatch, bits):
    monkeypatch.setattr(W, "MOST_SPANS", 1 << 14)
    monkeypatch.setattr(W, "STEP_BITS", bits)
    assert W._levels(events, "ts", 3 * HOUR) > 3
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = events.withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w))
    same(W.neighbours(events, ["key"], "ts", lag={"before": "id"}, lead={"after": "id"}, tie=["id"], span=3 * HOUR), want)
    same(W.row_numbers(events, ["key"], "ts", "n", tie=["id"], span=3 * HOUR), events.withColumn("n", F.row_number().over(w).cast("long")))
