"""Queries for the generic joins, aggregates, windows, sorts, set operations and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import DAY, HOUR
from ..operators import joins as J
from ..operators import reshape as R
from ..operators import windows as W
from ..operators.analytics import item_preview
from ..operators.quantiles import exact_quantiles
from ..operators.scoring import CodeRule, RuleScore, add_scores, code_flags, worst_of
from ..operators.windows import Agg, Order
from .registry import admissions, catalog, query, read

# --- joins -----------------------------------------------------------------------------------------


@query("join_inner", "SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return read(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("join_star", """SELECT c_custkey, n_orders, revenue, last_ship FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, sum(l_extendedprice) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) b ON b.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, max(l_shipdate) AS last_ship FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1) c ON c.o_custkey = c_custkey""",
       {"revenue": 2})
def join_star(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_shipdate", "l_returnflag")
    lines = o.join(li, "o_orderkey")
    parts = [o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders")), lines.groupBy("c_custkey").agg(F.sum("l_extendedprice").alias("revenue")),
             lines.filter(F.col("l_returnflag") == "R").groupBy("c_custkey").agg(F.max("l_shipdate").alias("last_ship"))]
    return J.star_join(read(spark, d, "customer").select("c_custkey"), parts, "c_custkey")


@query("join_full_coalesce", """SELECT coalesce(o.day, s.day) AS day, n_orders, n_lines FROM
    (SELECT o_orderdate AS day, count(*) AS n_orders FROM orders GROUP BY 1) o FULL JOIN (SELECT l_shipdate AS day, count(*) AS n_lines FROM lineitem GROUP BY 1) s ON o.day = s.day""")
def join_full(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n_orders"))
    s = read(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n_lines"))
    return J.full_coalesce(o, s, ["day"])


@query("join_dictionary", "SELECT c.itemid, label, category, count(*) AS n FROM v_chartevents c JOIN v_d_items d ON d.itemid = c.itemid GROUP BY ALL")
def join_dictionary(spark, d):
    cat = catalog(spark, d)
    j = J.with_dictionary(cat.table("chartevents").select("itemid"), cat.table("d_items").select("itemid", "label", "category"))
    return j.groupBy("itemid", "label", "category").agg(F.count(F.lit(1)).alias("n"))


def _user_events(spark, d, kind, *cols):
    return read(spark, d, "events").filter(F.col("event_type") == kind).select("user_id", "ts", *cols)


_BOUNDS = {"[]": (">=", "<="), "(]": (">", "<="), "[)": (">=", "<")}
for _name, _bounds in (("join_interval_closed", "[]"), ("join_interval_open_start", "(]"), ("join_interval_open_end", "[)")):
    def _make(name, bounds):
        lo, hi = _BOUNDS[bounds]

        @query(name, f"""SELECT p.user_id, p.event_id, q.event_id AS run_id FROM events p LEFT JOIN events q ON q.user_id = p.user_id AND q.event_type = 'purchase'
            AND p.ts {lo} q.ts AND p.ts {hi} q.ts + to_hours(CAST(1 + CAST(q.props->>'k' AS BIGINT) AS INTEGER)) WHERE p.event_type <> 'view'""")
        def build(spark, d):
            ev = read(spark, d, "events")
            points = ev.filter(F.col("event_type") != "view").select("user_id", "event_id", "ts")
            hours = (F.get_json_object("props", "$.k").cast("int") + 1)
            runs = ev.filter(F.col("event_type") == "purchase").select(
                "user_id", F.col("event_id").alias("run_id"), F.col("ts").alias("run_start"), (F.col("ts") + F.make_dt_interval(F.lit(0), hours)).alias("run_end"))
            return J.interval_join(points, runs, ["user_id"], "ts", "run_start", "run_end", bounds, "left").select("user_id", "event_id", "run_id")
    _make(_name, _bounds)


# intervals of a day to six hundred years
_LONG = """SELECT c.user_id, c.event_id AS run_id, c.ts + to_days(CAST(c.event_id % 5 AS INTEGER)) AS run_start,
    c.ts + to_days(CAST(c.event_id % 5 + CASE WHEN c.event_id % 11 = 0 THEN 300 * (c.event_id % 700) ELSE c.event_id % 3 END AS INTEGER)) AS run_end FROM events c WHERE c.event_type = 'purchase'"""
_LONG_ON = "q.user_id = p.user_id AND p.ts >= q.run_start AND p.ts < q.run_end"
for _name, _how, _sql in (
        ("join_dyadic_inner", "inner", f"SELECT p.user_id, p.event_id, q.run_id FROM events p JOIN ({_LONG}) q ON {_LONG_ON} WHERE p.event_type = 'error'"),
        ("join_dyadic_left", "left", f"SELECT p.user_id, p.event_id, q.run_id FROM events p LEFT JOIN ({_LONG}) q ON {_LONG_ON} WHERE p.event_type = 'error'"),
        ("join_dyadic_semi", "left_semi", f"SELECT p.user_id, p.event_id FROM events p WHERE p.event_type = 'error' AND EXISTS (FROM ({_LONG}) q WHERE {_LONG_ON})"),
        ("join_dyadic_anti", "left_anti", f"SELECT p.user_id, p.event_id FROM events p WHERE p.event_type = 'error' AND NOT EXISTS (FROM ({_LONG}) q WHERE {_LONG_ON})")):
    def _dyadic(name, how, sql):
        @query(name, sql)
        def build(spark, d):
            ev = read(spark, d, "events")
            points = ev.filter(F.col("event_type") == "error").select("user_id", "event_id", "ts")
            part = F.col("event_id").cast("int")
            runs = ev.filter(F.col("event_type") == "purchase").select(
                "user_id", F.col("event_id").alias("run_id"), (F.col("ts") + F.make_dt_interval(part % 5)).alias("run_start"),
                (F.col("ts") + F.make_dt_interval(part % 5 + F.when(part % 11 == 0, 300 * (part % 700)).otherwise(part % 3))).alias("run_end"))
            out = J.dyadic_join(points, runs, ["user_id"], "ts", "run_start", "run_end", "[)", how)
            return out.select("user_id", "event_id", *(["run_id"] if how in ("inner", "left") else []))
    _dyadic(_name, _how, _sql)


@query("join_anchored", """SELECT user_id, count(*) AS n, max(value) AS top FROM (SELECT e.*, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events e)
    WHERE ts BETWEEN first_ts - INTERVAL 6 HOUR AND first_ts + INTERVAL 7 DAY GROUP BY user_id""")
def join_anchored(spark, d):
    ev = read(spark, d, "events").select("user_id", "ts", "value")
    anchors = ev.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    near = J.anchored(ev, anchors, ["user_id"], "ts", "first_ts", S.shift("first_ts", -6, "hour"), S.shift("first_ts", 7, "day"))
    return near.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("join_asof", """SELECT l.user_id, l.event_id, r.value AS last_view, r.ts AS view_ts FROM (SELECT * FROM events WHERE event_type = 'error') l
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON r.user_id = l.user_id AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 72 HOUR
    QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC NULLS LAST) = 1""")
def join_asof(spark, d):
    left = _user_events(spark, d, "error", "event_id")
    right = _user_events(spark, d, "view", "value").withColumnRenamed("ts", "view_ts")
    j = J.asof_join(left, right, ["user_id"], "ts", 72 * HOUR, {"last_view": "value", "view_ts": "view_ts"}, right_ts="view_ts")
    return j.select("user_id", "event_id", "last_view", "view_ts")


_SOME_USER = "CASE WHEN user_id % 3 <> 0 THEN user_id END AS user_id"


@query("join_asof_null_keys", f"""SELECT l.user_id, l.event_id, r.value AS last_view FROM (SELECT * REPLACE ({_SOME_USER.split(' AS ')[0]} AS user_id) FROM events WHERE event_type = 'error') l
    LEFT JOIN (SELECT * REPLACE ({_SOME_USER.split(' AS ')[0]} AS user_id) FROM events WHERE event_type = 'view') r ON r.user_id = l.user_id AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 72 HOUR
    QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC NULLS LAST) = 1""")
def join_asof_null(spark, d):
    some = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    left = _user_events(spark, d, "error", "event_id").withColumn("user_id", some)
    # per user and time one right row, so that rows whose key is taken away stay ordinary rows
    right = _user_events(spark, d, "view", "value").withColumnRenamed("ts", "view_ts").withColumn("user_id", some)
    return J.asof_join(left, right, ["user_id"], "ts", 72 * HOUR, {"last_view": "value"}, right_ts="view_ts").select("user_id", "event_id", "last_view")


@query("join_self_range", """SELECT a.user_id, a.event_id, min(b.value) FILTER (WHERE b.ts >= a.ts - INTERVAL 48 HOUR) AS low_48h, min(b.value) AS low_7d
    FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 7 DAY GROUP BY 1, 2""")
def join_self_range(spark, d):
    ev = read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    out = W.range_window(ev, ["user_id"], "ts", {"low_48h": Agg("min", "value", -48 * HOUR, -1), "low_7d": Agg("min", "value", -7 * DAY, -1)})
    return out.select("user_id", "event_id", "low_48h", "low_7d")


@query("join_previous_row", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)
    SELECT a.user_id, a.event_id, b.event_type AS prev_type, b.value AS prev_value FROM o a LEFT JOIN o b ON b.user_id = a.user_id AND b.n = a.n - 1 AND b.ts > a.ts - INTERVAL 6 HOUR""")
def join_previous(spark, d):
    ev = read(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    out = W.carry_previous(ev, ["user_id"], "ts", {"prev_type": "event_type", "prev_value": "value"}, 6 * HOUR)
    return out.select("user_id", "event_id", "prev_type", "prev_value")


@query("join_contained", """SELECT a.stay_id, a.starttime, a.endtime, count(b.stay_id) AS covering FROM v_dobutamine a LEFT JOIN v_dopamine b ON b.stay_id = a.stay_id
    AND b.starttime <= a.starttime AND b.endtime >= a.endtime GROUP BY ALL""")
def join_contained(spark, d):
    cat = catalog(spark, d)
    segs = cat.concept("dobutamine").select("stay_id", "starttime", "endtime")
    runs = cat.concept("dopamine").select("stay_id", F.col("starttime").alias("i_start"), F.col("endtime").alias("i_end"))
    j = J.contained_join(segs, runs, ["stay_id"], ("starttime", "endtime"), ("i_start", "i_end"))
    return j.groupBy("stay_id", "starttime", "endtime").agg(F.count("i_start").alias("covering"))


@query("join_overlap", """SELECT DISTINCT s.stay_id FROM v_icustays s JOIN v_norepinephrine v ON v.stay_id = s.stay_id AND (
    v.starttime BETWEEN s.intime AND s.intime + INTERVAL 1 DAY OR v.endtime BETWEEN s.intime AND s.intime + INTERVAL 1 DAY
    OR (v.starttime <= s.intime AND v.endtime >= s.intime + INTERVAL 1 DAY))""")
def join_overlap(spark, d):
    cat = catalog(spark, d)
    return J.overlaps(cat.concept("norepinephrine"), cat.table("icustays"), "stay_id", "starttime", "endtime", F.col("intime"), S.shift("intime", 1, "day"))


@query("join_first_of_two_windows", """SELECT l.user_id, l.event_id, r.event_id AS first_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    LEFT JOIN (SELECT *, CASE WHEN event_id % 2 = 0 THEN ts END AS at, date_trunc('day', ts)::TIMESTAMP AS day FROM events WHERE event_type = 'click') r ON r.user_id = l.user_id AND (
        (r.at IS NOT NULL AND l.ts > r.at AND l.ts <= r.at + INTERVAL 72 HOUR)
        OR (r.at IS NULL AND date_trunc('day', l.ts)::TIMESTAMP >= r.day AND date_trunc('day', l.ts)::TIMESTAMP <= r.day + INTERVAL 3 DAY))
    QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY r.day NULLS FIRST, r.at NULLS LAST, r.event_id) = 1""")
def join_two_windows(spark, d):
    left = _user_events(spark, d, "purchase", "event_id").withColumn("l_day", S.trunc_to("ts", "DAY"))
    right = _user_events(spark, d, "click", F.col("event_id").alias("r_id"))
    right = right.select("user_id", "r_id", S.trunc_to("ts", "DAY").alias("day"), F.when(F.col("r_id") % 2 == 0, F.col("ts")).alias("at"))
    timed, dated = right.filter(F.col("at").isNotNull()), right.filter(F.col("at").isNull())
    windows = [J.Alternative(timed, "ts", F.col("at"), S.shift("at", 72, "hour"), "(]"), J.Alternative(dated, "l_day", F.col("day"), S.shift("day", 3, "day"))]
    order = [Order("day", nulls_first=True), Order("at"), Order("r_id")]
    return J.match_first(left, ["event_id"], ["user_id"], windows, order, {"first_id": "r_id"}).select("user_id", "event_id", "first_id")


@query("join_outside_interval", """SELECT p.user_id, p.event_id FROM events p WHERE event_type = 'error' AND NOT EXISTS (FROM events q WHERE q.user_id = p.user_id
    AND q.event_type = 'purchase' AND p.ts BETWEEN q.ts AND q.ts + INTERVAL 24 HOUR)""")
def join_outside(spark, d):
    points = _user_events(spark, d, "error", "event_id")
    runs = _user_events(spark, d, "purchase").select("user_id", F.col("ts").alias("a"), S.shift("ts", 24, "hour").alias("z"))
    return J.outside_interval(points, runs, ["user_id"], "ts", "a", "z").select("user_id", "event_id")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi(spark, d):
    o = read(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("join_keyed_range", """SELECT a.hadm_id, l.labevent_id FROM v_admissions a CROSS JOIN v_labevents l WHERE l.subject_id = a.subject_id
    AND l.charttime > a.admittime - INTERVAL 2 DAY AND l.charttime < a.dischtime + INTERVAL 2 DAY""")
def join_keyed_range(spark, d):
    from ..operators.events import around_admission
    cat = catalog(spark, d)
    return around_admission(cat.table("labevents").select("subject_id", "hadm_id", "labevent_id", "charttime"), cat.table("admissions")).select("hadm_id", "labevent_id")


@query("join_explode_hours", "SELECT stay_id, unnest(range(0, CAST(ceil(los * 24) AS BIGINT) + 1)) AS hr FROM v_icustays")
def join_explode(spark, d):
    s = catalog(spark, d).table("icustays")
    return J.explode_hours(s, S.hour_span(0, F.ceil(F.col("los") * 24))).select("stay_id", "hr")


@query("join_scalar_subquery", """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
    (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first_priority FROM customer""")
def join_scalar(spark, d):
    o = read(spark, d, "orders")
    agg = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"))
    return J.with_aggregate(read(spark, d, "customer").select("c_custkey"), agg, ["c_custkey"], {"n_orders": 0})


@query("join_attach_stay", """SELECT l.labevent_id, s.stay_id FROM v_labevents l JOIN v_icustays s ON s.subject_id = l.subject_id AND s.hadm_id = l.hadm_id
    AND l.charttime >= s.intime - INTERVAL 24 HOUR AND l.charttime < s.outtime + INTERVAL 24 HOUR""")
def join_attach(spark, d):
    cat = catalog(spark, d)
    day = F.make_dt_interval(F.lit(1))
    lab = cat.table("labevents").select("labevent_id", "subject_id", "hadm_id", "charttime")
    return J.attach_stay(lab, cat.table("icustays"), ["subject_id", "hadm_id"], "charttime", day, day).select("labevent_id", "stay_id")


# --- aggregates and pivots -----------------------------------------------------------------------------
@query("pivot_max", f"SELECT hadm_id, {', '.join(f'max(valuenum) FILTER (WHERE itemid = {i} AND valuenum <= {40 + i}) AS item_{i}' for i in range(8))} FROM v_hosp_labevents GROUP BY hadm_id")
def pivot_max(spark, d):
    return R.pivot_events(admissions(spark, d).labevents(), ["hadm_id"], [R.ItemCol(f"item_{i}", (i,), le=40.0 + i) for i in range(8)])


@query("pivot_avg", """SELECT hadm_id, avg(valuenum) FILTER (WHERE itemid IN (0, 1) AND valuenum > 5 AND valuenum < 45) AS a,
    avg(CASE WHEN itemid = 3 THEN valuenum / CAST(10 AS DOUBLE) ELSE valuenum END) FILTER (WHERE itemid IN (2, 3)) AS b FROM v_hosp_labevents WHERE itemid IN (0, 1, 2, 3) GROUP BY hadm_id""",
       {"a": 6, "b": 6})
def pivot_avg(spark, d):
    cols = [R.ItemCol("a", (0, 1), gt=5.0, lt=45.0), R.ItemCol("b", (2, 3), scale={3: 10.0})]
    return R.pivot_events(admissions(spark, d).labevents(), ["hadm_id"], cols, "avg")


@query("summarise_min_max_mean", """SELECT l_suppkey, min(l_quantity) AS qty_min, max(l_quantity) AS qty_max, avg(l_quantity) AS qty_mean, min(l_extendedprice) AS price_min,
    max(l_extendedprice) AS price_max, avg(l_extendedprice) AS price_mean FROM lineitem GROUP BY 1""", {"qty_mean": 6, "price_mean": 4})
def summarise(spark, d):
    return R.summarise(read(spark, d, "lineitem"), ["l_suppkey"], {"qty": "l_quantity", "price": "l_extendedprice"}, ["min", "max", "avg"])


@query("count_distinct_keys", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def count_distinct(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("sum_distinct", "SELECT l_orderkey, sum(DISTINCT l_quantity) AS distinct_qty FROM lineitem GROUP BY 1")
def sum_distinct(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum_distinct("l_quantity").alias("distinct_qty"))


_NUM = r"CASE WHEN regexp_full_match(value, '[+-]?([0-9]*[.])?[0-9]+') THEN CAST(value AS DOUBLE) END"


@query("item_preview_numbers", """SELECT itemid, min(valuenum) AS min, quantile_cont(valuenum, 0.25) AS q25, quantile_cont(valuenum, 0.5) AS median, avg(valuenum) AS mean,
    quantile_cont(valuenum, 0.75) AS q75, max(valuenum) AS max FROM v_chartevents GROUP BY itemid""", {c: 6 for c in ("q25", "median", "mean", "q75")})
def preview(spark, d):
    return item_preview(catalog(spark, d).table("chartevents"), None, "valuenum")


@query("item_preview_texts", f"""SELECT itemid, min(v) AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, avg(v) AS mean, quantile_cont(v, 0.75) AS q75, max(v) AS max
    FROM (SELECT itemid, {_NUM} AS v FROM v_chartevents) GROUP BY itemid""", {c: 6 for c in ("q25", "median", "mean", "q75")})
def preview_text(spark, d):
    return item_preview(catalog(spark, d).table("chartevents"), None, "value")


@query("value_preview_texts", "SELECT DISTINCT value FROM v_chartevents WHERE itemid = 220048")
def value_texts(spark, d):
    from ..operators.analytics import value_preview
    return value_preview(catalog(spark, d).table("chartevents"), 220048, "value")[1]


@query("join_distinct_texts", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY 1")
def join_texts(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(S.join_distinct("l_returnflag").alias("kinds"))


@query("having_on_group", "SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1 HAVING min(o_orderdate) <> max(o_orderdate)")
def having(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return g.filter(F.col("a") != F.col("z"))


_RULES = {"low": CodeRule(("Brand#1",), ("Brand#2",)), "mid": CodeRule((), (), (("Brand#3", "Brand#5"),), (("Brand#10", "Brand#15"),))}


@query("code_flags", f"SELECT hadm_id, {', '.join(f'max(CASE WHEN {r.predicate()} THEN 1 ELSE 0 END) AS {n}' for n, r in _RULES.items())} FROM v_hosp_diagnoses GROUP BY hadm_id")
def flags(spark, d):
    return code_flags(admissions(spark, d).diagnoses_icd(), ["hadm_id"], _RULES)


@query("widen_by_name", """SELECT user_id, min(value) FILTER (WHERE event_type = 'view') AS view, min(value) FILTER (WHERE event_type = 'click') AS click,
    min(value) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1""")
def widen(spark, d):
    return R.widen(read(spark, d, "events"), ["user_id"], "event_type", "value", ["view", "click", "error"])


@query("exact_quantiles", """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.9) AS p90
    FROM lineitem GROUP BY 1""", {"q1": 4, "q2": 4, "p90": 4})
def quantiles(spark, d):
    return exact_quantiles(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "q2": 0.5, "p90": 0.9})


# --- windows ---------------------------------------------------------------------------------------
@query("window_top1", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1""")
def top1(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return W.top1(o, ["o_custkey"], [Order("o_orderdate", desc=True), Order("o_orderkey")]).drop("o_orderdate")


@query("window_dense_rank", """SELECT o_orderkey, dense_rank() OVER w AS seq, dense_rank() OVER w = 1 AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST)""")
def dense_rank(spark, d):
    return W.sequence_flags(read(spark, d, "orders"), ["o_custkey"], "o_orderdate", "seq", "first").select("o_orderkey", "seq", "first")


@query("window_lag_lead", """SELECT event_id, lag(value) OVER w AS prev_value, lag(event_type) OVER w AS prev_type, lead(ts) OVER w AS next_ts FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def lag_lead(spark, d):
    n = W.neighbours(read(spark, d, "events"), ["user_id"], "ts", lag={"prev_value": "value", "prev_type": "event_type"}, lead={"next_ts": "ts"})
    return n.select("event_id", "prev_value", "prev_type", "next_ts")


@query("window_running_sum", """SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS running FROM lineitem""", {"running": 4})
def running_sum(spark, d):
    return W.running_sum(read(spark, d, "lineitem"), ["l_suppkey"], "l_shipdate", "l_quantity", "running", span=90 * DAY).select("l_orderkey", "l_linenumber", "running")


@query("window_row_number", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events")
def row_number(spark, d):
    return W.row_numbers(read(spark, d, "events"), ["event_type"], "ts", "n", tie=["event_id"]).select("event_id", "n")


@query("window_range_sums", """SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS sum_24h,
    sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 72 HOUR PRECEDING AND CURRENT ROW) AS sum_72h FROM events""", {"sum_24h": 4, "sum_72h": 4})
def range_sums(spark, d):
    ev = read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return W.range_window(ev, ["user_id"], "ts", {"sum_24h": Agg("sum", "value", -24 * HOUR), "sum_72h": Agg("sum", "value", -72 * HOUR)}).select("event_id", "sum_24h", "sum_72h")


@query("window_range_max", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS top FROM events")
def range_max(spark, d):
    ev = read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return W.rolling_range(ev, ["user_id"], "ts", "value", 48 * HOUR, "max", "top").select("event_id", "top")


@query("window_rows_max", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS top FROM events")
def rows_max(spark, d):
    ev = read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return W.rolling_rows(ev, ["user_id"], "ts", 24, {"top": ("max", "value")}).select("event_id", "top")


@query("window_null_order", """SELECT micro_specimen_id FROM v_microbiologyevents QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY charttime NULLS FIRST, micro_specimen_id) = 1
    UNION ALL SELECT micro_specimen_id FROM v_microbiologyevents QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY charttime DESC NULLS LAST, micro_specimen_id) = 1""")
def null_order(spark, d):
    me = catalog(spark, d).table("microbiologyevents").select("subject_id", "charttime", "micro_specimen_id")
    a = W.top1(me, ["subject_id"], [Order("charttime", nulls_first=True), Order("micro_specimen_id")])
    z = W.top1(me, ["subject_id"], [Order("charttime", desc=True), Order("micro_specimen_id")])
    return a.unionByName(z).select("micro_specimen_id")


@query("window_over_groups", """SELECT user_id, day, total, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM
    (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS total FROM events GROUP BY ALL)""", {"total": 4})
def over_groups(spark, d):
    g = read(spark, d, "events").groupBy("user_id", S.trunc_to("ts", "DAY").alias("day")).agg(F.sum("value").alias("total"))
    return W.row_numbers(g, ["user_id"], "day", "n", span=30 * DAY)


@query("window_shared_spec", """SELECT event_id, lag(ts) OVER w AS prev_ts, sum(value) OVER w AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""", {"running": 4})
def shared_spec(spark, d):
    ev = W.neighbours(read(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", lag={"prev_ts": "ts"})
    return W.running_sum(ev, ["user_id"], "ts", "value", "running").select("event_id", "prev_ts", "running")


# --- sorts, limits, sets -----------------------------------------------------------------------------
@query("sort_null_placement", "SELECT subject_id, hadm_id, micro_specimen_id, charttime FROM v_microbiologyevents ORDER BY charttime NULLS FIRST, hadm_id NULLS LAST, micro_specimen_id")
def sort_nulls(spark, d):
    me = catalog(spark, d).table("microbiologyevents").select("subject_id", "hadm_id", "micro_specimen_id", "charttime")
    return me.orderBy(F.col("charttime").asc_nulls_first(), F.col("hadm_id").asc_nulls_last(), "micro_specimen_id")


@query("limit_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_rows(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("top_k_per_group", """SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer QUALIFY rank <= 5""")
def top_k(spark, d):
    return W.top_k(read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 5, [Order("c_acctbal", desc=True), Order("c_custkey")])


@query("set_union_all", "SELECT c_custkey AS id, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def union_all(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind"))
    return a.unionByName(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query("set_union_distinct", "SELECT o_orderdate AS day FROM orders UNION SELECT l_shipdate FROM lineitem")
def union_distinct(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderdate").alias("day")).union(read(spark, d, "lineitem").select("l_shipdate")).distinct()


@query("set_intersect_keys", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def intersect(spark, d):
    return J.intersect_keys(read(spark, d, "customer"), read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), ["c_custkey"])


# --- reshaping --------------------------------------------------------------------------------------
@query("hourly_grid", """SELECT user_id, hr, date_trunc('hour', a) + to_hours(CAST(hr + CASE WHEN date_trunc('hour', a) = a THEN 0 ELSE 1 END AS INTEGER)) AS endtime FROM (
    SELECT user_id, a, unnest(range(-24, CAST(ceil((epoch_us(z) - epoch_us(a)) / CAST(3600000000 AS DOUBLE)) AS BIGINT) + 1)) AS hr FROM (SELECT user_id, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1))""")
def grid(spark, d):
    g = read(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return R.hourly_grid(g, ["user_id"], "a", "z")


@query("to_intervals", """SELECT user_id, ts AS starttime, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), TIMESTAMP '2024-02-01') AS endtime FROM events""")
def intervals(spark, d):
    ev = read(spark, d, "events").select("user_id", F.col("ts").alias("starttime"))
    return R.to_intervals(ev, ["user_id"], "starttime", "endtime", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("segment_intervals", """WITH t AS (SELECT stay_id, starttime AS m FROM v_inputevents UNION SELECT stay_id, endtime FROM v_inputevents)
    SELECT * FROM (SELECT stay_id, m AS starttime, lead(m) OVER (PARTITION BY stay_id ORDER BY m) AS endtime FROM t) WHERE endtime IS NOT NULL""")
def segments(spark, d):
    return R.segment_intervals({"all": catalog(spark, d).table("inputevents")})


@query("gap_episodes", """WITH n AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS same, lag(event_type) OVER w AS before, lead(ts) OVER w AS after FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    e AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - same >= INTERVAL 14 HOUR OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS ep FROM n)
    SELECT user_id, min(ts) AS starttime, max(CASE WHEN after IS NULL OR after - ts >= INTERVAL 14 HOUR THEN ts ELSE after END) AS endtime, max(event_type) AS event_type
    FROM e GROUP BY user_id, ep""")
def episodes(spark, d):
    return R.gap_episodes(read(spark, d, "events"), ["user_id"], "ts", "event_type", 14 * HOUR, drop_points=False)


# --- scores ----------------------------------------------------------------------------------------
_SCORES = (RuleScore("size", (("l_quantity IS NULL", None), ("l_quantity < 10", 0), ("l_quantity < 25", 1), ("l_quantity >= 40", 3)), 2),
           RuleScore("rebate", (("l_discount >= 0.08", 4), ("l_discount > 0.02 AND l_tax < 0.03", 2)), 0))


@query("rule_score", f"SELECT l_orderkey, l_linenumber, {', '.join(f'{s.sql()} AS {s.name}' for s in _SCORES)} FROM lineitem")
def rule_score(spark, d):
    return add_scores(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), _SCORES).drop("l_quantity", "l_discount", "l_tax")


_WORST = worst_of("lo", "hi", 25.5, "lo_pts", "hi_pts")


@query("worst_of", f"""SELECT l_orderkey, {_WORST.sql()} AS points FROM (SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi, CASE WHEN min(l_quantity) < 10 THEN 3 ELSE 1 END AS lo_pts,
    CASE WHEN max(l_quantity) > 40 THEN 4 ELSE 0 END AS hi_pts FROM lineitem GROUP BY 1)""")
def worst(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    g = g.withColumn("lo_pts", F.when(F.col("lo") < 10, 3).otherwise(1)).withColumn("hi_pts", F.when(F.col("hi") > 40, 4).otherwise(0))
    return g.select("l_orderkey", _WORST.column().alias("points"))


# --- scalar helpers ------------------------------------------------------------------------------------
@query("scalar_text", """SELECT c_custkey, upper(trim(c_name)) AS u, lower(c_mktsegment) AS l, substr(c_name, 1, 10) AS s, c_mktsegment LIKE '%BUILD%' AS b FROM customer""")
def scalar_text(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.upper_trim("c_name").alias("u"), F.lower("c_mktsegment").alias("l"),
                                             F.substring("c_name", 1, 10).alias("s"), S.like_contains("c_mktsegment", "BUILD").alias("b"))


@query("scalar_regex", "SELECT p_partkey, regexp_matches(p_name, '(red|blue) b') AS hit, regexp_extract(p_brand, '#([0-9]+)', 1) AS num FROM part")
def scalar_regex(spark, d):
    return read(spark, d, "part").select("p_partkey", S.matches("p_name", "(red|blue) b").alias("hit"), S.regexp_extract("p_brand", "#([0-9]+)", 1).alias("num"))


@query("scalar_drug_class", """SELECT hadm_id, drug, starttime FROM v_hosp_prescriptions WHERE contains(lower(drug), 'bolt') OR contains(lower(drug), 'red ') OR contains(lower(drug), 'ring')""")
def scalar_drugs(spark, d):
    from ..concepts.treatments import drug_class
    return drug_class(admissions(spark, d).prescriptions(), ("bolt", "red ", "ring")).select("hadm_id", "drug", "starttime")


@query("scalar_case_greatest", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS s,
    coalesce(nullif(l_tax, 0), -1) AS c FROM lineitem""")
def scalar_case(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("size"),
                                             F.greatest("l_discount", "l_tax").alias("g"), F.least("l_discount", "l_tax").alias("s"),
                                             F.coalesce(F.nullif(F.col("l_tax"), F.lit(0.0)), F.lit(-1.0)).alias("c"))


_SINCE = "epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')"


@query("scalar_datetime_diff", f"""SELECT event_id, ({_SINCE}) / CAST(1000000 AS DOUBLE) AS sec, ({_SINCE}) / CAST(60000000 AS DOUBLE) AS min, ({_SINCE}) / CAST(3600000000 AS DOUBLE) AS hour,
    ({_SINCE}) / CAST(86400000000 AS DOUBLE) AS day, ({_SINCE}) / (CAST(365.242 AS DOUBLE) * 86400000000) AS year FROM events""")
def scalar_diff(spark, d):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    parts = {"sec": "second", "min": "minute", "hour": "hour", "day": "day", "year": "year"}
    return read(spark, d, "events").select("event_id", *[S.datetime_diff("ts", base, p).alias(n) for n, p in parts.items()])


@query("scalar_hours", """SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS up,
    date_trunc('day', ts)::TIMESTAMP AS d FROM events""")
def scalar_hours(spark, d):
    return read(spark, d, "events").select("event_id", S.trunc_to("ts", "HOUR").alias("h"), S.ceil_hour("ts").alias("up"), S.trunc_to("ts", "DAY").alias("d"))


@query("scalar_shift", """SELECT o_orderkey, o_orderdate + INTERVAL 5 HOUR AS h, o_orderdate - INTERVAL 3 DAY AS d, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate + INTERVAL 1 YEAR AS y FROM orders""")
def scalar_shift(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.shift("o_orderdate", 5, "hour").alias("h"), S.shift("o_orderdate", -3, "day").alias("d"),
                                           S.shift("o_orderdate", 1, "month").alias("m"), S.shift("o_orderdate", 1, "year").alias("y"))


@query("scalar_age", """SELECT hadm_id, anchor_age + (epoch_us(admittime) - epoch_us(make_timestamp(CAST(anchor_year AS BIGINT), 1, 1, 0, 0, 0))) / CAST(1000000 AS DOUBLE) / CAST(31556908.8 AS DOUBLE) AS exact_age,
    anchor_age + year(admittime) - anchor_year AS year_age, (epoch_us(dischtime) - epoch_us(admittime)) / CAST(86400000000 AS DOUBLE) AS days
    FROM v_admissions JOIN v_patients USING (subject_id)""", {"exact_age": 6, "days": 6})
def scalar_age(spark, d):
    cat = catalog(spark, d)
    j = cat.table("admissions").join(cat.table("patients"), "subject_id")
    return j.select("hadm_id", S.age_years("admittime", "anchor_age", "anchor_year").alias("exact_age"), S.age_by_year("admittime", "anchor_age", "anchor_year").alias("year_age"),
                    S.span_days("dischtime", "admittime").alias("days"))


@query("scalar_round", """SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice / l_quantity AS DECIMAL(38, 10)), 2) AS DOUBLE) AS unit_price, CAST(ceil(l_quantity / 7) AS BIGINT) AS boxes FROM lineitem""")
def scalar_round(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.round_dec(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unit_price"),
                                             F.ceil(F.col("l_quantity") / 7).alias("boxes"))


@query("scalar_math", """SELECT c_custkey, ln(abs(c_acctbal) + 1) AS l, exp(c_acctbal / 100000) AS e, pow(abs(c_acctbal), CAST(0.5 AS DOUBLE)) AS p, 1 / (1 + exp(-c_acctbal / 10000)) AS s FROM customer""",
       {c: 6 for c in ("l", "e", "p", "s")})
def scalar_math(spark, d):
    b = F.col("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.log(F.abs(b) + 1).alias("l"), F.exp(b / 100000).alias("e"), F.pow(F.abs(b), F.lit(0.5)).alias("p"), S.logistic(b / 10000).alias("s"))


@query("scalar_rate_units", """SELECT orderid, CASE itemid WHEN 221906 THEN CASE WHEN rateuom = 'mg/kg/min' AND patientweight <> 1 THEN rate * 1000 ELSE rate END
    WHEN 221749 THEN CASE WHEN rateuom = 'mcg/min' THEN rate / patientweight ELSE rate END WHEN 222315 THEN CASE WHEN rateuom = 'units/min' THEN rate * 60 ELSE rate END ELSE rate END AS vaso_rate
    FROM v_inputevents""", {"vaso_rate": 6})
def scalar_rates(spark, d):
    from ..concepts import definitions as D
    from ..concepts.treatments import normalise_rate
    out = F.col("rate")
    for item in D.INFUSIONS.values():
        out = F.when(F.col("itemid") == item, normalise_rate(item)).otherwise(out)
    return catalog(spark, d).table("inputevents").select("orderid", out.alias("vaso_rate"))


@query("scalar_fio2", """SELECT stay_id, charttime, valuenum, CASE WHEN valuenum > 0.2 AND valuenum <= 1 THEN valuenum * 100 WHEN valuenum > 20 AND valuenum <= 100 THEN valuenum END AS strict,
    CASE WHEN valuenum >= 0.2 AND valuenum <= 1 THEN valuenum * 100 WHEN valuenum >= 20 AND valuenum <= 100 THEN valuenum END AS wide FROM v_chartevents WHERE itemid = 223835""")
def scalar_fio2(spark, d):
    ce = catalog(spark, d).table("chartevents").filter(F.col("itemid") == 223835)
    return ce.select("stay_id", "charttime", "valuenum", S.fio2_percent("valuenum", gap_inclusive=False).alias("strict"), S.fio2_percent("valuenum", low_inclusive=True).alias("wide"))


@query("scalar_canonical", """SELECT starttime, stay_id, CASE WHEN location IN ('Left Antecub', 'Left Antecube') THEN 'Left Antecube' WHEN location IN ('Left Axilla', 'Left Axilla.') THEN 'Left Axilla'
    ELSE location END AS site FROM v_procedureevents""")
def scalar_canonical(spark, d):
    m = {"Left Antecube": ("Left Antecub", "Left Antecube"), "Left Axilla": ("Left Axilla", "Left Axilla.")}
    return catalog(spark, d).table("procedureevents").select("starttime", "stay_id", S.canonical("location", m).alias("site"))


@query("scalar_series", "SELECT o_orderkey, unnest(range(0, o_orderkey % 5 + 1)) AS i FROM orders")
def scalar_series(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.explode(S.hour_span(0, F.col("o_orderkey") % 5)).alias("i"))


@query("scalar_cut", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN '[0,10)' WHEN l_quantity >= 10 AND l_quantity < 30 THEN '[10,30)'
    WHEN l_quantity >= 30 AND l_quantity <= 45 THEN '[30,45]' END AS bin FROM lineitem""")
def scalar_cut(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.cut("l_quantity", [0, 10, 30, 45]).alias("bin"))


@query("scalar_format_parse", """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS text, strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y') AS back FROM orders""")
def scalar_format(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", S.format_ts("o_orderdate", "%Y/%m/%d %H:%M:%S").alias("text"), S.format_ts("o_orderdate", "%d-%m-%Y").alias("t"))
    return o.select("o_orderkey", "text", S.parse_ts("t", "%d-%m-%Y").alias("back"))
