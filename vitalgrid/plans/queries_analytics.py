"""Queries for item series, bins, strata, comparisons and descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators.cohort import mortality_flags
from .queries_cohort import HIGH_HR, LOW_SAT, match
from .queries_cohort import _COHORT_SQL as HIGH_SQL
from .queries_cohort import _LOW_SAT_SQL as LOW_SQL
from .registry import catalog, query, read, views

HR = 220045


def _base(cat):
    return cat.table("icustays"), cat.table("admissions"), cat.table("patients")


_HOURS = "v_icustay_hourly h ON h.stay_id = {0}.stay_id AND {1}.charttime BETWEEN h.endtime - INTERVAL 1 HOUR AND h.endtime"
views().update({
    "v_an_cohort": "SELECT subject_id, hadm_id, stay_id FROM v_icustays",
    "v_an_series": f"SELECT c.valuenum AS value, c.stay_id, CAST(hr AS INTEGER) AS hr, c.valueuom AS unitname FROM v_chartevents c JOIN {_HOURS.format('c', 'c')} "
                   f"WHERE itemid = {HR} AND c.stay_id IN (SELECT stay_id FROM v_an_cohort)",
    "v_an_bins": "SELECT CASE WHEN hr >= 0 AND hr < 24 THEN '[0,24)' WHEN hr >= 24 AND hr < 48 THEN '[24,48)' WHEN hr >= 48 AND hr <= 72 THEN '[48,72]' END AS interval, stay_id, avg(value) AS aggr "
                 "FROM v_an_series WHERE hr BETWEEN 0 AND 72 GROUP BY ALL",
    "v_an_strat": f"SELECT b.*, CASE WHEN stay_id IN (SELECT stay_id FROM ({HIGH_SQL})) THEN 'Event condition' ELSE 'Others' END AS strat FROM v_an_bins b",
    "v_an_strata": f"SELECT s.subject_id, s.hadm_id, s.stay_id, CASE WHEN stay_id IN (SELECT stay_id FROM ({HIGH_SQL})) THEN 'fast' WHEN stay_id IN (SELECT stay_id FROM ({LOW_SQL})) THEN 'low oxygen' "
                   "ELSE 'rest' END AS strat FROM v_icustays s",
    "v_an_long": "SELECT d.stay_id, strat, label AS variable, valuenum AS number, value AS text FROM v_demographics d JOIN (SELECT stay_id, strat FROM v_an_strata) USING (stay_id)",
})


def series(spark, d):
    cat = catalog(spark, d)
    cohort = cat.table("icustays")
    return A.cohort_item_series(cat.table("chartevents"), "chartevents", HR, "valuenum", cohort, cat.table("icustays"), cat.concept("icustay_times"))


def bins(spark, d):
    return A.bin_aggregate(series(spark, d), 0, 72, 24, "mean")


def stratified(spark, d):
    return A.stratify_by_stays(bins(spark, d), match(catalog(spark, d), HIGH_HR))


def strata(spark, d):
    cat = catalog(spark, d)
    return A.assign_strata(cat.table("icustays").select("subject_id", "hadm_id", "stay_id"), [("fast", match(cat, HIGH_HR)), ("low oxygen", match(cat, LOW_SAT))], "rest")


def long_table(spark, d):
    cat = catalog(spark, d)
    return A.long_variables(cat.concept("demographics"), strata(spark, d))


@query("item_series", "SELECT * FROM v_an_series")
def item_series(spark, d):
    return series(spark, d)


_GUARD = "CASE WHEN regexp_full_match(value, '[+-]?([0-9]*[.])?[0-9]+') THEN CAST(value AS DOUBLE) END"


@query("item_series_hospital", f"""SELECT {_GUARD} AS value, s.stay_id, CAST(hr AS INTEGER) AS hr, l.valueuom AS unitname FROM v_labevents l JOIN v_icustays s ON s.subject_id = l.subject_id AND s.hadm_id = l.hadm_id
    AND l.charttime >= s.intime - INTERVAL 24 HOUR AND l.charttime < s.outtime + INTERVAL 24 HOUR JOIN {_HOURS.format('s', 'l')} WHERE itemid = 50912 AND s.stay_id IN (SELECT stay_id FROM v_an_cohort)""")
def item_series_hosp(spark, d):
    cat = catalog(spark, d)
    cohort = cat.table("icustays")
    return A.cohort_item_series(cat.table("labevents"), "labevents", 50912, "value", cohort, cat.table("icustays"), cat.concept("icustay_times"), force_number=True)


@query("bin_aggregate", "SELECT * FROM v_an_bins", {"aggr": 6})
def bin_aggregate(spark, d):
    return bins(spark, d)


@query("bin_aggregate_median", "SELECT CAST(hr AS VARCHAR) AS interval, stay_id, quantile_cont(value, 0.5) AS aggr FROM v_an_series WHERE hr BETWEEN 0 AND 48 GROUP BY ALL", {"aggr": 6})
def bin_median(spark, d):
    return A.bin_aggregate(series(spark, d), 0, 48, 1, "median", per_hour=True)


@query("stratify_by_condition", "SELECT * FROM v_an_strat", {"aggr": 6})
def strat_expr(spark, d):
    return stratified(spark, d)


_WHO = "v_an_bins b JOIN v_icustays s ON s.stay_id = b.stay_id JOIN v_patients p ON p.subject_id = s.subject_id JOIN v_admissions a ON a.hadm_id = s.hadm_id"
_AGE = "anchor_age + year(admittime) - anchor_year"
for _name, _kind, _op, _value, _sql in (
        ("stratify_by_gender", "Gender", None, None, "gender"),
        ("stratify_by_age", "Age", ">", 60, f"CASE WHEN {_AGE} > 60 THEN 'Age>60' ELSE 'others' END"),
        ("stratify_by_length", "HADM Length", "<=", 5.5, "CASE WHEN (epoch_us(dischtime) - epoch_us(admittime)) / CAST(86400000000 AS DOUBLE) <= 5.5 THEN 'HADM Length<=5.5' ELSE 'others' END"),
        ("stratify_by_hospital_death", "In hospital death", None, None, "CASE WHEN dischtime + INTERVAL 1 DAY >= dod THEN 'In hospital death' ELSE 'Others' END"),
        ("stratify_by_late_death", "< 1 year after HADM death", None, None, "CASE WHEN dischtime + INTERVAL 1 YEAR >= dod THEN '< 1 year after HADM death' ELSE 'Others' END")):
    def _make(name, kind, op, value, sql):
        @query(name, f"SELECT interval, b.stay_id, aggr, {sql} AS strat FROM {_WHO}", {"aggr": 6})
        def build(spark, d):
            return A.stratify_by_demographic(bins(spark, d), kind, *_base(catalog(spark, d)), op=op, value=value)
    _make(_name, _kind, _op, _value, _sql)


@query("assign_strata", "SELECT * FROM v_an_strata")
def assign(spark, d):
    return strata(spark, d)


@query("trajectory", "SELECT interval, strat, count(*) AS n, quantile_cont(aggr, 0.25) AS ymin, quantile_cont(aggr, 0.5) AS median_aggr, quantile_cont(aggr, 0.75) AS ymax FROM v_an_strat GROUP BY ALL",
       {"ymin": 6, "median_aggr": 6, "ymax": 6})
def trajectory(spark, d):
    return A.trajectory(stratified(spark, d))


@query("box_stats", """SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
    quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM lineitem GROUP BY 1, 2""", {"q1": 6, "median": 6, "q3": 6})
def box(spark, d):
    return A.box_stats(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("histogram", "SELECT l_returnflag, CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE CAST(floor(l_quantity / 5) AS BIGINT) + 1 END AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def hist(spark, d):
    return A.histogram(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 0, 50, 10)


@query("category_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def counts(spark, d):
    return A.category_counts(read(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority")


@query("top_categories", """SELECT l_returnflag, CASE WHEN r <= 10 THEN brand ELSE 'Others' END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, brand) AS r
    FROM (SELECT l_returnflag, p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) GROUP BY 1, 2""")
def top_cats(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return A.top_categories(read(spark, d, "lineitem").select("l_partkey", "l_returnflag").join(p, "l_partkey"), ["l_returnflag"], "p_brand")


@query("top_codes", """SELECT icd_code, icd_version, long_title, strat, n, row_number() OVER (PARTITION BY strat ORDER BY n DESC, icd_code, icd_version) AS rank FROM (
    SELECT icd_code, icd_version, long_title, strat, count(*) AS n FROM v_diagnoses_icd JOIN (SELECT DISTINCT hadm_id, strat FROM v_an_strata) USING (hadm_id)
    JOIN v_d_icd_diagnoses USING (icd_code, icd_version) WHERE seq_num <= 5 GROUP BY ALL) QUALIFY rank <= 5""")
def top_codes(spark, d):
    cat = catalog(spark, d)
    return A.top_codes(strata(spark, d), cat.table("diagnoses_icd"), cat.table("d_icd_diagnoses"), max_seq=5)


@query("strata_comparison", """SELECT strat, count(DISTINCT s.stay_id) AS stay_count, count(DISTINCT CASE WHEN gender = 'M' THEN s.subject_id END) AS males, count(DISTINCT CASE WHEN gender = 'F' THEN s.subject_id END) AS females,
    round(avg(anchor_age + year(intime) - anchor_year), 2) AS mean_age, round(avg((epoch_us(outtime) - epoch_us(intime)) / CAST(86400000000 AS DOUBLE)), 2) AS mean_stay_days,
    round(sum(CASE WHEN dod <= dischtime + INTERVAL 1 DAY THEN 1 ELSE 0 END) / count(*) * 100, 2) AS hospital_death_pct, round(sum(CASE WHEN dod <= intime + INTERVAL 30 DAY THEN 1 ELSE 0 END) / count(*) * 100, 2) AS death_30d_pct
    FROM v_an_strata x JOIN v_icustays s ON s.stay_id = x.stay_id JOIN v_patients p ON p.subject_id = s.subject_id JOIN v_admissions a ON a.hadm_id = s.hadm_id GROUP BY strat""")
def comparison(spark, d):
    return A.strata_comparison(strata(spark, d), *_base(catalog(spark, d)))


@query("mortality_flags", "SELECT * FROM v_mortality")
def mortality(spark, d):
    return mortality_flags(*_base(catalog(spark, d)))


@query("table_one", """SELECT variable, strat, CAST(NULL AS VARCHAR) AS level, count(*) AS n, quantile_cont(number, 0.5) AS median, quantile_cont(number, 0.25) AS q1, quantile_cont(number, 0.75) AS q3, CAST(NULL AS DOUBLE) AS pct
    FROM v_an_long WHERE number IS NOT NULL GROUP BY variable, strat
    UNION ALL SELECT variable, strat, text, count(*), NULL, NULL, NULL, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY variable, strat) FROM v_an_long WHERE number IS NULL AND text IS NOT NULL GROUP BY variable, strat, text""",
       {"median": 6, "q1": 6, "q3": 6, "pct": 6})
def table_one(spark, d):
    return A.table_one(long_table(spark, d))


@query("variable_summary", """SELECT variable, strat, count(*) AS n, avg(number) AS mean, stddev_samp(number) AS sd, min(number) AS min, quantile_cont(number, 0.25) AS q1, quantile_cont(number, 0.5) AS median,
    quantile_cont(number, 0.75) AS q3, max(number) AS max FROM v_an_long WHERE number IS NOT NULL GROUP BY 1, 2""", {c: 6 for c in ("mean", "sd", "q1", "median", "q3")})
def var_summary(spark, d):
    return A.variable_summary(long_table(spark, d))


_RANK_SQL = """WITH r AS (SELECT variable, strat, rank() OVER w + (count(*) OVER (PARTITION BY variable, number) - 1) / 2 AS rk, number FROM v_an_long WHERE number IS NOT NULL
        WINDOW w AS (PARTITION BY variable ORDER BY number)),
    g AS (SELECT variable, strat, count(*) AS n, sum(rk) AS r FROM r GROUP BY 1, 2), t AS (SELECT variable, sum(c * c * c - c) AS ties FROM (SELECT variable, number, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
    h AS (SELECT variable, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS q, count(*) AS k FROM g GROUP BY 1)
    SELECT h.variable, 'rank' AS test, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS statistic, CAST(k - 1 AS INTEGER) AS df FROM h JOIN t ON t.variable = h.variable"""
_CHI_SQL = """WITH c AS (SELECT variable, text, strat, CAST(count(*) AS DOUBLE) AS n FROM v_an_long WHERE number IS NULL AND text IS NOT NULL GROUP BY ALL),
    a AS (SELECT v.variable, v.text, x.strat FROM (SELECT DISTINCT variable, text FROM c) v JOIN (SELECT DISTINCT variable, strat FROM c) x ON x.variable = v.variable),
    f AS (SELECT a.*, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (variable, text, strat)),
    e AS (SELECT *, sum(n) OVER (PARTITION BY variable, text) * sum(n) OVER (PARTITION BY variable, strat) / sum(n) OVER (PARTITION BY variable) AS exp FROM f)
    SELECT variable, 'chi-square' AS test, sum((n - exp) * (n - exp) / exp) AS statistic, CAST((count(DISTINCT text) - 1) * (count(DISTINCT strat) - 1) AS INTEGER) AS df FROM e GROUP BY variable"""


@query("rank_test_statistic", _RANK_SQL, {"statistic": 6})
def rank_test(spark, d):
    return A.rank_sums(long_table(spark, d))


@query("chi_square_statistic", _CHI_SQL, {"statistic": 6})
def chi_square(spark, d):
    return A.contingency(long_table(spark, d))


# the lower tail as a series, with the gamma function of the engine
_TESTS_SQL = f"""WITH s AS (SELECT * FROM ({_RANK_SQL}) UNION ALL SELECT * FROM ({_CHI_SQL})),
    p AS (SELECT *, CASE WHEN df < 1 OR statistic IS NULL THEN NULL WHEN statistic <= 0 THEN 1.0 ELSE greatest(0.0, 1 - (SELECT sum(exp((df / 2.0 + i) * ln(statistic / 2) - statistic / 2 - lgamma(df / 2.0 + i + 1))) FROM range(3000) t(i))) END AS p_value FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY p_value NULLS LAST, variable) AS k, count(p_value) OVER () AS m FROM p)
    SELECT variable, test, statistic, df, p_value, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END AS q_value FROM r"""


@query("group_tests", _TESTS_SQL, {"statistic": 6, "p_value": 9, "q_value": 9})
def group_tests(spark, d):
    return A.group_tests(long_table(spark, d))


@query("unit_check", """SELECT itemid, string_agg(DISTINCT rateuom, ',' ORDER BY rateuom) AS units, count(DISTINCT rateuom) AS n_units, count(DISTINCT rateuom) > 1 AS inconsistent FROM v_inputevents
    WHERE rateuom IS NOT NULL AND rateuom <> 'None' GROUP BY itemid""")
def units(spark, d):
    return A.unit_check(catalog(spark, d).table("inputevents"), ["itemid"], "rateuom")


@query("numeric_items", "SELECT itemid, bool_and(value IS NULL OR regexp_full_match(value, '[+-]?([0-9]*[.])?[0-9]+')) AS is_numeric, count(value) AS n FROM v_chartevents GROUP BY itemid")
def numeric(spark, d):
    return A.numeric_items(catalog(spark, d).table("chartevents"))
