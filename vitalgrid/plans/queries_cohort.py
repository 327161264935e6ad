"""Queries for cohort conditions, the algebra on them and cohort summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import predicates as P
from ..operators.cohort import Leaf
from ..operators.predicates import Condition
from ..operators.shared_scan import SharedScan
from .registry import admissions, catalog, query, read

KEYS = "subject_id, hadm_id, stay_id"
RHYTHM, HR, MODE, SYSTEM = 220048, 220045, 223849, 224146


def match(cat, cond: Condition, cohort=None, table=None):
    events = table if table is not None else cat.table(cond.table)
    return P.match_events(events, cat.table("icustays"), cat.concept("icustay_times"), cond, cohort)


def scan(cat, cohort=None) -> SharedScan:
    """Conditions of one cohort expression, with one reading of each event table."""
    return SharedScan(cat.table, cat.table("icustays"), cat.concept("icustay_times"), cohort)


def _leaf(name: str, cond: Condition, sql: str) -> None:
    @query(name, sql)
    def build(spark, d):
        return match(catalog(spark, d), cond)


def _chart(where: str, having: str = "") -> str:
    tail = f"GROUP BY {KEYS} HAVING {having}" if having else ""
    return f"SELECT DISTINCT {KEYS} FROM v_chartevents WHERE {where} {tail}"


_NUM = "CASE WHEN regexp_full_match(value, '[+-]?([0-9]*[.])?[0-9]+') THEN CAST(value AS DOUBLE) END"
_leaf("filter_contains", Condition("chartevents", RHYTHM, "value", "Contains", "Sinus T"), _chart(f"itemid = {RHYTHM} AND value LIKE '%Sinus T%'"))
_leaf("filter_not_contains", Condition("chartevents", MODE, "value", "Not Contains", "CPAP"), _chart(f"itemid = {MODE} AND value NOT LIKE '%CPAP%'"))
_leaf("filter_is", Condition("chartevents", SYSTEM, "value", "Is", " clotted "), _chart(f"itemid = {SYSTEM} AND upper(trim(value)) = 'CLOTTED'"))
_leaf("filter_is_not", Condition("chartevents", RHYTHM, "value", "Is Not", "af (atrial fibrillation)"), _chart(f"itemid = {RHYTHM} AND upper(trim(value)) <> 'AF (ATRIAL FIBRILLATION)'"))
_leaf("filter_exist", Condition("chartevents", 226499, "valuenum", "Exist"), _chart("itemid = 226499"))
_leaf("filter_is_true", Condition("chartevents", 220739, "valuenum", "Is True"), _chart("itemid = 220739 AND valuenum = 1"))
_leaf("filter_is_false", Condition("chartevents", 223900, "valuenum", "Is False", None, "min"), _chart("itemid = 223900", "min(valuenum) = 0"))
_leaf("filter_number", Condition("chartevents", HR, "valuenum", ">=", 150), _chart(f"itemid = {HR} AND valuenum >= 150"))
_leaf("filter_number_not_equal", Condition("chartevents", 220739, "valuenum", "<>", 2), _chart("itemid = 220739 AND valuenum <> 2"))
_leaf("filter_text_as_number", Condition("chartevents", HR, "value", "<", 12), _chart(f"itemid = {HR} AND {_NUM} < 12"))
for _agg, _op, _v, _sql in (("min", "<", 35, "min(valuenum)"), ("mean", ">", 100, "avg(valuenum)"), ("max", "<=", 160, "max(valuenum)"), ("sum", ">", 2000, "sum(valuenum)"),
                            ("median", ">", 102.5, "quantile_cont(valuenum, 0.5)")):
    _leaf(f"filter_aggregate_{_agg}", Condition("chartevents", HR, "valuenum", _op, _v, _agg), _chart(f"itemid = {HR}", f"{_sql} {_op} {_v}"))
_GRID = "v_icustay_hourly h ON h.stay_id = {}.stay_id AND {}.charttime BETWEEN h.endtime - INTERVAL 1 HOUR AND h.endtime"
_leaf("filter_hour_window", Condition("chartevents", HR, "valuenum", ">", 140, None, (0, 24)),
      f"SELECT DISTINCT {', '.join('c.' + k for k in KEYS.split(', '))} FROM v_chartevents c JOIN {_GRID.format('c', 'c')} WHERE itemid = {HR} AND hr BETWEEN 0 AND 24 AND valuenum > 140")
_leaf("filter_hour_window_sum", Condition("chartevents", HR, "valuenum", ">", 405.05, "sum", (-5, 20)),
      f"SELECT c.subject_id, c.hadm_id, c.stay_id FROM v_chartevents c JOIN {_GRID.format('c', 'c')} WHERE itemid = {HR} AND hr BETWEEN -5 AND 20 GROUP BY ALL HAVING sum(valuenum) > 405.05")
_STAY = "v_icustays i ON i.subject_id = t.subject_id AND i.hadm_id = t.hadm_id AND t.{0} BETWEEN i.intime - INTERVAL 24 HOUR AND i.outtime + INTERVAL 1 HOUR"
_leaf("filter_hospital_scope", Condition("labevents", 50912, "valuenum", ">", 5),
      f"SELECT DISTINCT i.subject_id, i.hadm_id, i.stay_id FROM v_labevents t JOIN {_STAY.format('charttime')} WHERE itemid = 50912 AND valuenum > 5")
_leaf("filter_hospital_hours", Condition("labevents", 50813, "valuenum", ">", 9, "mean", (0, 48)),
      f"SELECT i.subject_id, i.hadm_id, i.stay_id FROM v_labevents t JOIN {_STAY.format('charttime')} JOIN {_GRID.format('i', 't')} WHERE itemid = 50813 AND hr BETWEEN 0 AND 48 "
      "GROUP BY ALL HAVING avg(valuenum) > 9")
_leaf("filter_icu_scope", Condition("inputevents", 221906, "rate", ">", 0.3), f"SELECT DISTINCT {KEYS} FROM v_inputevents WHERE itemid = 221906 AND rate > 0.3")

_AT = "2024-01-05 06:00:00"
_DATES = f"SELECT DISTINCT {KEYS} FROM v_datetimeevents WHERE itemid = 224280 AND value {{}} TIMESTAMP '{_AT}'"
for _name, _op in (("equal", "="), ("not_equal", "<>"), ("before", "<"), ("after", ">"), ("until", "<="), ("from", ">=")):
    _leaf(f"filter_datetime_{_name}", Condition("datetimeevents", 224280, "value", _op, _AT), _DATES.format(_op))
_leaf("filter_datetime_last", Condition("datetimeevents", 224280, "value", "<", _AT, "max"),
      f"SELECT {KEYS} FROM v_datetimeevents WHERE itemid = 224280 GROUP BY ALL HAVING max(value) < TIMESTAMP '{_AT}'")

_COHORT_SQL = f"SELECT DISTINCT {KEYS} FROM v_chartevents WHERE itemid = {HR} AND valuenum >= 150"
HIGH_HR = Condition("chartevents", HR, "valuenum", ">=", 150)
LOW_SAT = Condition("chartevents", 220277, "valuenum", "<", 72)
LACTATE = Condition("labevents", 50813, "valuenum", ">", 15)
_LOW_SAT_SQL = f"SELECT DISTINCT {KEYS} FROM v_chartevents WHERE itemid = 220277 AND valuenum < 72"
_LACTATE_SQL = f"SELECT DISTINCT i.subject_id, i.hadm_id, i.stay_id FROM v_labevents t JOIN {_STAY.format('charttime')} WHERE itemid = 50813 AND valuenum > 15"


@query("filter_cohort_scope", f"SELECT c.subject_id, c.hadm_id, c.stay_id FROM v_chartevents c JOIN ({_COHORT_SQL}) k USING ({KEYS}) WHERE itemid = 220277 GROUP BY ALL HAVING avg(valuenum) < 88")
def cohort_scope(spark, d):
    cat = catalog(spark, d)
    return match(cat, Condition("chartevents", 220277, "valuenum", "<", 88, "mean"), match(cat, HIGH_HR))


@query("filter_prescriptions", f"""SELECT DISTINCT i.subject_id, i.hadm_id, i.stay_id FROM v_prescriptions t JOIN {_STAY.format('starttime')} WHERE drug =
    (SELECT DISTINCT drug FROM v_prescriptions ORDER BY drug LIMIT 1 OFFSET 2) AND CAST(dose_val_rx AS DOUBLE) > 40""")
def filter_rx(spark, d):
    from ..operators.events import d_prescriptions
    cat = catalog(spark, d)
    rx = cat.table("prescriptions")
    return match(cat, Condition("prescriptions", 1000003, "dose_val_rx", ">", 40), table=rx.join(d_prescriptions(rx), "drug"))


@query("filter_custom_events", f"SELECT DISTINCT i.subject_id, i.hadm_id, i.stay_id FROM v_customevents t JOIN {_STAY.format('charttime')} WHERE itemid = 10001 AND CAST(value AS DOUBLE) >= 50")
def filter_custom(spark, d):
    return match(catalog(spark, d), Condition("customevents", 10001, "value", ">=", 50))


@query("admissions_with_stay", "SELECT hadm_id, admission_type FROM v_admissions WHERE hadm_id IN (SELECT hadm_id FROM v_icustays)")
def with_stay(spark, d):
    cat = catalog(spark, d)
    return P.admissions_with_stay(cat.table("admissions"), cat.table("icustays")).select("hadm_id", "admission_type")


@query("search_catalogue", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') ORDER BY p_name, p_partkey LIMIT 100")
def search(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name")
    return P.search_names(p, "p_name", "Bolt", 100)


@query("search_code_titles", """SELECT icd_code || 'v' || CAST(icd_version AS VARCHAR) || ' - ' || long_title AS name FROM v_d_icd_diagnoses WHERE contains(lower(icd_code || 'v' || CAST(icd_version AS VARCHAR) || ' - ' || long_title), '1v9')""")
def search_codes(spark, d):
    dx = catalog(spark, d).table("d_icd_diagnoses")
    named = dx.select(F.concat("icd_code", F.lit("v"), F.col("icd_version").cast("string"), F.lit(" - "), "long_title").alias("name"))
    return P.search_names(named, "name", "1V9")


@query("search_ids", "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '12%'")
def search_ids(spark, d):
    return P.search_ids(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", "12")


@query("clean_series", "SELECT stay_id, charttime, value FROM (SELECT stay_id, charttime, valuenum AS value FROM v_chartevents WHERE itemid = 220045) WHERE stay_id NOT IN (3, 7) AND value BETWEEN 50 AND 120")
def clean(spark, d):
    s = catalog(spark, d).table("chartevents").filter(F.col("itemid") == HR).select("stay_id", "charttime", F.col("valuenum").alias("value"))
    return P.clean(s, [3, 7], 50, 120)


# --- algebra ----------------------------------------------------------------------------------------
@query("cohort_and", f"{_COHORT_SQL} INTERSECT {_LACTATE_SQL}")
def cohort_and(spark, d):
    cat = catalog(spark, d)
    return C.and_(match(cat, HIGH_HR), match(cat, LACTATE))


@query("cohort_and_admission", f"SELECT DISTINCT a.* FROM ({_COHORT_SQL}) a WHERE hadm_id IN (SELECT hadm_id FROM ({_LACTATE_SQL}))")
def cohort_and_two(spark, d):
    cat = catalog(spark, d)
    return C.and_(match(cat, LACTATE).select("subject_id", "hadm_id").distinct(), match(cat, HIGH_HR))


@query("cohort_or", f"{_COHORT_SQL} UNION {_LACTATE_SQL}")
def cohort_or(spark, d):
    cat = catalog(spark, d)
    return C.or_(match(cat, HIGH_HR), match(cat, LACTATE))


@query("cohort_or_admission", f"""SELECT DISTINCT coalesce(a.subject_id, b.subject_id) AS subject_id, coalesce(a.hadm_id, b.hadm_id) AS hadm_id, stay_id FROM ({_COHORT_SQL}) a
    FULL JOIN (SELECT DISTINCT subject_id, hadm_id FROM ({_LACTATE_SQL})) b ON b.subject_id = a.subject_id AND b.hadm_id = a.hadm_id""")
def cohort_or_two(spark, d):
    cat = catalog(spark, d)
    return C.or_(match(cat, HIGH_HR), match(cat, LACTATE).select("subject_id", "hadm_id").distinct())


@query("cohort_expression", f"({_COHORT_SQL}) INTERSECT (SELECT * FROM ({_LOW_SAT_SQL}) UNION SELECT * FROM ({_LACTATE_SQL}))")
def cohort_expr(spark, d):
    cat = catalog(spark, d)
    expr = C.fold_right([Leaf(HIGH_HR), "&", Leaf(LOW_SAT), "|", Leaf(LACTATE)])
    return C.evaluate_expr(expr, scan(cat))


@query("cohort_expression_parentheses", f"(SELECT * FROM (({_COHORT_SQL}) INTERSECT ({_LOW_SAT_SQL}))) UNION ({_LACTATE_SQL})")
def cohort_expr_paren(spark, d):
    cat = catalog(spark, d)
    return C.evaluate_expr((Leaf(HIGH_HR) & Leaf(LOW_SAT)) | Leaf(LACTATE), scan(cat))


#: One condition of every sort, over four tables.
RULES = [
    (HIGH_HR, _COHORT_SQL),
    (LACTATE, _LACTATE_SQL),
    (Condition("chartevents", RHYTHM, "value", "Contains", "Sinus T"), _chart(f"itemid = {RHYTHM} AND value LIKE '%Sinus T%'")),
    (Condition("chartevents", RHYTHM, "value", "Is Not", "af (atrial fibrillation)"), _chart(f"itemid = {RHYTHM} AND upper(trim(value)) <> 'AF (ATRIAL FIBRILLATION)'")),
    (Condition("chartevents", 220739, "valuenum", "Is True"), _chart("itemid = 220739 AND valuenum = 1")),
    (Condition("chartevents", HR, "value", "<", 12), _chart(f"itemid = {HR} AND {_NUM} < 12")),
    (Condition("chartevents", HR, "valuenum", ">", 100, "mean"), _chart(f"itemid = {HR}", "avg(valuenum) > 100")),
    (Condition("chartevents", HR, "valuenum", ">", 102.5, "median"), _chart(f"itemid = {HR}", "quantile_cont(valuenum, 0.5) > 102.5")),
    (Condition("chartevents", HR, "valuenum", ">", 140, None, (0, 24)),
     f"SELECT DISTINCT {', '.join('c.' + k for k in KEYS.split(', '))} FROM v_chartevents c JOIN {_GRID.format('c', 'c')} WHERE itemid = {HR} AND hr BETWEEN 0 AND 24 AND valuenum > 140"),
    (Condition("chartevents", HR, "valuenum", ">", 405.05, "sum", (-5, 20)),
     f"SELECT c.subject_id, c.hadm_id, c.stay_id FROM v_chartevents c JOIN {_GRID.format('c', 'c')} WHERE itemid = {HR} AND hr BETWEEN -5 AND 20 GROUP BY ALL HAVING sum(valuenum) > 405.05"),
    (Condition("labevents", 50813, "valuenum", ">", 9, "mean", (0, 48)),
     f"SELECT i.subject_id, i.hadm_id, i.stay_id FROM v_labevents t JOIN {_STAY.format('charttime')} JOIN {_GRID.format('i', 't')} WHERE itemid = 50813 AND hr BETWEEN 0 AND 48 "
     "GROUP BY ALL HAVING avg(valuenum) > 9"),
    (Condition("inputevents", 221906, "rate", ">", 0.3), f"SELECT DISTINCT {KEYS} FROM v_inputevents WHERE itemid = 221906 AND rate > 0.3"),
    (Condition("datetimeevents", 224280, "value", "<", _AT, "max"), f"SELECT {KEYS} FROM v_datetimeevents WHERE itemid = 224280 GROUP BY ALL HAVING max(value) < TIMESTAMP '{_AT}'"),
    (Condition("datetimeevents", 224280, "value", ">=", _AT), _DATES.format(">=")),
]


@query("filter_many_conditions", " UNION ALL ".join(f"SELECT {i} AS leaf, {KEYS} FROM ({sql})" for i, (_, sql) in enumerate(RULES)))
def many_conditions(spark, d):
    return scan(catalog(spark, d)).many([c for c, _ in RULES]).withColumnRenamed("__leaf", "leaf")


@query("filter_many_conditions_cohort", f"""SELECT 0 AS leaf, c.subject_id, c.hadm_id, c.stay_id FROM v_chartevents c JOIN ({_COHORT_SQL}) k USING ({KEYS}) WHERE itemid = 220277 GROUP BY ALL HAVING avg(valuenum) < 88
    UNION ALL SELECT 1, {KEYS} FROM (({_LOW_SAT_SQL}) INTERSECT ({_COHORT_SQL}))""")
def many_conditions_cohort(spark, d):
    cat = catalog(spark, d)
    return scan(cat, match(cat, HIGH_HR)).many([Condition("chartevents", 220277, "valuenum", "<", 88, "mean"), LOW_SAT]).withColumnRenamed("__leaf", "leaf")


def _dx(codes) -> str:
    return " OR ".join(f"(starts_with(icd_code, '{c}') AND icd_version = {v})" for c, v in codes)


_ALLOW, _DENY = [("Brand#1", 9), ("Brand#2", 10)], [("Brand#7", 9), ("Brand#8", 10)]
_HOSP = "SELECT DISTINCT subject_id, hadm_id FROM v_hosp_diagnoses"


@query("code_filter_any", f"{_HOSP} WHERE hadm_id IN (SELECT hadm_id FROM v_hosp_diagnoses WHERE {_dx(_ALLOW)}) AND hadm_id NOT IN (SELECT hadm_id FROM v_hosp_diagnoses WHERE {_dx(_DENY)})")
def code_any(spark, d):
    dx = admissions(spark, d).diagnoses_icd()
    return C.icd_filter(dx.select("subject_id", "hadm_id").distinct(), dx, _ALLOW, _DENY)


@query("code_filter_any_repeated", f"SELECT subject_id, hadm_id FROM v_hosp_diagnoses WHERE {_dx(_ALLOW)}")
def code_repeated(spark, d):
    dx = admissions(spark, d).diagnoses_icd()
    return C.icd_filter(dx.select("subject_id", "hadm_id").distinct(), dx, _ALLOW, duplicates=True)


#: Every two-letter prefix of either version, most of which no diagnosis has.
_LIST = [(f"Brand#{a}{b}", v) for v in (9, 10) for a in range(10) for b in range(10)] + [(chr(97 + a) + chr(97 + b), 10) for a in range(26) for b in range(26)] + [("Brand", 9)]


@query("code_list_hits", f"SELECT subject_id, hadm_id, count(*) AS n FROM v_hosp_diagnoses JOIN (VALUES {', '.join(f'({c!r}, {v})' for c, v in _LIST)}) AS t(code, version) "
                         "ON starts_with(icd_code, code) AND icd_version = version GROUP BY ALL")
def code_list(spark, d):
    dx = admissions(spark, d).diagnoses_icd()
    return C.code_matches(dx, _LIST, distinct=False).groupBy("subject_id", "hadm_id").agg(F.count(F.lit(1)).alias("n"))


@query("code_filter_all", f"SELECT subject_id, hadm_id FROM v_hosp_diagnoses WHERE {_dx(_ALLOW)} GROUP BY ALL HAVING count(*) = 2")
def code_all(spark, d):
    dx = admissions(spark, d).diagnoses_icd()
    return C.icd_filter(dx.select("subject_id", "hadm_id").distinct(), dx, _ALLOW, allow_mode="AND")


@query("code_filter_deny_all", f"{_HOSP} EXCEPT SELECT subject_id, hadm_id FROM v_hosp_diagnoses WHERE {_dx(_DENY)} GROUP BY ALL HAVING count(*) = 2")
def code_deny_all(spark, d):
    dx = admissions(spark, d).diagnoses_icd()
    return C.icd_filter(dx.select("subject_id", "hadm_id").distinct(), dx, deny=_DENY, deny_mode="AND")


@query("code_filter_all_strict", f"""SELECT subject_id, hadm_id FROM v_hosp_diagnoses GROUP BY ALL HAVING bool_or({_dx(_ALLOW[:1])}) AND bool_or({_dx(_ALLOW[1:])})""")
def code_strict(spark, d):
    dx = admissions(spark, d).diagnoses_icd()
    return C.icd_filter(dx.select("subject_id", "hadm_id").distinct(), dx, _ALLOW, allow_mode="AND", strict=True)


_COH_DX = [("I", 10), ("4", 9)]
_COHORT_EVAL = (f"SELECT * FROM (({_COHORT_SQL}) UNION ({_LACTATE_SQL})) WHERE hadm_id IN (SELECT hadm_id FROM v_diagnoses_icd WHERE {_dx(_COH_DX)}) "
                f"AND hadm_id NOT IN (SELECT hadm_id FROM v_diagnoses_icd WHERE {_dx([('B20', 10)])})")


def _cohort(spark, d):
    cat = catalog(spark, d)
    return C.evaluate_cohort(Leaf(HIGH_HR) | Leaf(LACTATE), scan(cat), cat.table("icustays"), cat.table("diagnoses_icd"), cat.table("patients"),
                             cat.table("admissions"), allow=_COH_DX, deny=[("B20", 10)])


@query("evaluate_cohort", _COHORT_EVAL)
def evaluate(spark, d):
    return _cohort(spark, d)


@query("evaluate_cohort_codes_only", f"SELECT {KEYS} FROM v_icustays WHERE hadm_id IN (SELECT hadm_id FROM v_diagnoses_icd WHERE {_dx([('C', 10)])})")
def evaluate_codes(spark, d):
    cat = catalog(spark, d)
    return C.evaluate_cohort(None, scan(cat), cat.table("icustays"), cat.table("diagnoses_icd"), cat.table("patients"), cat.table("admissions"), allow=[("C", 10)])


@query("cohort_summary", f"""SELECT count(DISTINCT subject_id) AS subjects, count(DISTINCT hadm_id) AS admissions, count(DISTINCT stay_id) AS stays, CAST(100 AS DOUBLE) AS subjects_with_stay_pct,
    count(DISTINCT subject_id) FILTER (WHERE gender = 'M') AS males, count(DISTINCT subject_id) FILTER (WHERE gender = 'F') AS females,
    round(count(DISTINCT subject_id) FILTER (WHERE gender = 'M') / count(DISTINCT subject_id) FILTER (WHERE gender = 'F'), 3) AS sex_ratio, round(avg(age), 2) AS mean_age,
    quantile_cont(age, 0.5) AS median_age FROM (SELECT k.*, gender, anchor_age + year(admittime) - anchor_year AS age FROM ({_COHORT_EVAL}) k JOIN v_patients USING (subject_id)
    JOIN (SELECT hadm_id, admittime FROM v_admissions) USING (hadm_id))""")
def summary(spark, d):
    cat = catalog(spark, d)
    return C.cohort_summary(_cohort(spark, d), cat.table("patients"), cat.table("admissions"))


@query("event_catalogue", """SELECT itemid, label, count(*) AS events, count(DISTINCT stay_id) AS stays, count(DISTINCT hadm_id) AS admissions, count(DISTINCT subject_id) AS patients
    FROM v_unified GROUP BY ALL""")
def catalogue(spark, d):
    from .queries_events import unified
    return C.event_catalogue(unified(spark, d))


_LIT = """SELECT s.subject_id, i.hadm_id, s.stay_id FROM v_sepsis3 s JOIN v_icustays i ON i.stay_id = s.stay_id JOIN v_admissions a ON a.hadm_id = i.hadm_id WHERE sepsis3
    AND NOT regexp_matches(lower(admission_type), 'cardiac|vascular|trauma') AND edregtime IS NOT NULL
    AND (SELECT sum(amount) FROM v_inputevents x WHERE x.stay_id = s.stay_id AND ordercategoryname = '16-Pre Admission/Non-ICU' AND amount > 0) > 0"""


def _literature(cat):
    return C.literature_sepsis_cohort(cat.concept("sepsis3"), cat.table("icustays"), cat.table("admissions"), cat.table("inputevents"))


@query("literature_sepsis_cohort", _LIT)
def literature(spark, d):
    return _literature(catalog(spark, d))


@query("cohort_report", f"""SELECT 'before' AS step, count(DISTINCT subject_id) AS patients, count(DISTINCT stay_id) AS stays FROM v_sepsis3 WHERE sepsis3
    UNION ALL SELECT 'after', count(DISTINCT subject_id), count(DISTINCT stay_id) FROM ({_LIT})""")
def report(spark, d):
    cat = catalog(spark, d)
    return C.cohort_report(cat.concept("sepsis3").filter(F.col("sepsis3")), _literature(cat))
