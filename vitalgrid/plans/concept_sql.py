"""The derived tables once more as SQL text for the comparison engine.

Written independently of the DataFrame code where the method matters: range frames appear as self joins,
hour arithmetic as joins with the grid, as-of joins as lateral lookups. Item lists, limits and rule tables
come from the shared definitions.
"""

from __future__ import annotations

from ..concepts import definitions as D
from ..concepts.firstday import GAS_COLUMNS, LAB_COLUMNS, LAB_STEMS, VITAL_COLUMNS
from ..operators.reshape import ItemCol
from ..operators.scoring import CodeRule, RuleScore, bands, total_sql, worst_of

DBL = "CAST({} AS DOUBLE)"


def dec(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 10)), {digits}) AS DOUBLE)"


def ids(values) -> str:
    return ", ".join(str(v) for v in values)


def texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def item_value(c: ItemCol, agg: str) -> str:
    """One pivoted column with FILTER."""
    v = c.field
    tests = [f"itemid IN ({ids(c.itemids)})"]
    for limit, op in ((c.gt, ">"), (c.ge, ">="), (c.lt, "<"), (c.le, "<=")):
        if limit is not None:
            tests.append(f"{v} {op} {limit}")
    shown = v
    if c.scale:
        shown = "CASE " + " ".join(f"WHEN itemid = {i} THEN {v} / {DBL.format(d)}" for i, d in c.scale.items()) + f" ELSE {v} END"
    return f"{agg}({shown}) FILTER (WHERE {' AND '.join(tests)}) AS {c.name}"


def all_items(cols) -> str:
    return ids(sorted({i for c in cols for i in c.itemids}))


def lab_view(cols, keep: str) -> str:
    return (f"SELECT max(subject_id) AS subject_id, max(hadm_id) AS hadm_id, max(charttime) AS charttime, specimen_id, "
            f"{', '.join(item_value(c, 'max') for c in cols)} FROM v_labevents WHERE itemid IN ({all_items(cols)}) AND {keep} GROUP BY specimen_id")


def flags(rules: dict[str, CodeRule]) -> str:
    return ", ".join(f"max(CASE WHEN {r.predicate()} THEN 1 ELSE 0 END) AS {n}" for n, r in rules.items())


def scores(rules) -> str:
    return ", ".join(f"{s.sql()} AS {s.name}" for s in rules)


def first_day(points: str, key: str, aggs: str, extra: str = "", low: str = "s.intime - INTERVAL 6 HOUR", high: str = "s.intime + INTERVAL 1 DAY",
              bounds: str = "[]", ts: str = "charttime") -> str:
    lo, hi = (">=" if bounds[0] == "[" else ">"), ("<=" if bounds[1] == "]" else "<")
    return (f"SELECT s.subject_id, s.stay_id, {aggs} FROM v_icustays s LEFT JOIN {points} p ON p.{key} = s.{key} "
            f"AND p.{ts} {lo} {low} AND p.{ts} {hi} {high} {extra} GROUP BY s.subject_id, s.stay_id")


def minmax(cols, fns=("min", "max")) -> str:
    sql = {"min": "min", "max": "max", "mean": "avg"}
    return ", ".join(f"{sql[f]}(p.{src}) AS {stem}_{f}" for stem, src in cols for f in fns)


def _pairs(cols):
    return [(c, c) for c in cols]


def fio2(v: str, low: str, gap: str) -> str:
    return f"CASE WHEN {v} {low} 0.2 AND {v} <= 1 THEN {v} * 100.0 WHEN {v} {gap} 20 AND {v} <= 100 THEN {v} END"


def concept_views() -> dict[str, str]:
    v: dict[str, str] = {}
    epoch = "epoch_us({})".format
    year0 = "epoch_us(make_timestamp(CAST(anchor_year AS BIGINT), 1, 1, 0, 0, 0))"
    v["v_age"] = f"""SELECT a.subject_id, a.hadm_id, admittime, anchor_age, anchor_year,
        anchor_age + (epoch_us(admittime) - {year0}) / CAST(1000000 AS DOUBLE) / CAST(31556908.8 AS DOUBLE) AS age
        FROM v_admissions a JOIN v_patients p USING (subject_id)"""
    v["v_icustay_times"] = f"""SELECT s.subject_id, s.hadm_id, s.stay_id, min(charttime) AS intime_hr, max(charttime) AS outtime_hr
        FROM v_icustays s LEFT JOIN (SELECT stay_id, charttime FROM v_chartevents WHERE itemid = {D.HEART_RATE}) c USING (stay_id) GROUP BY ALL"""
    v["v_icustay_hourly"] = """SELECT stay_id, hr, first_end + to_hours(CAST(hr AS INTEGER)) AS endtime FROM (
        SELECT stay_id, CASE WHEN date_trunc('hour', intime_hr) = intime_hr THEN intime_hr ELSE date_trunc('hour', intime_hr) + INTERVAL 1 HOUR END AS first_end,
        unnest(range(-24, CAST(ceil((epoch_us(outtime_hr) - epoch_us(intime_hr)) / CAST(3600000000 AS DOUBLE)) AS BIGINT) + 1)) AS hr
        FROM v_icustay_times WHERE intime_hr IS NOT NULL)"""
    v["v_icustay_detail"] = f"""SELECT s.subject_id, s.hadm_id, s.stay_id, gender, dod, admittime, dischtime,
        (epoch_us(dischtime) - epoch_us(admittime)) / CAST(86400000000 AS DOUBLE) AS los_hospital,
        anchor_age + (epoch_us(admittime) - {year0}) / CAST(1000000 AS DOUBLE) / CAST(31556908.8 AS DOUBLE) AS admission_age,
        race, hospital_expire_flag, dense_rank() OVER adm AS hospstay_seq, dense_rank() OVER adm = 1 AS first_hosp_stay,
        intime AS icu_intime, outtime AS icu_outtime, {dec("(epoch_us(outtime) - epoch_us(intime)) / CAST(86400000000 AS DOUBLE)", 2)} AS los_icu,
        dense_rank() OVER icu AS icustay_seq, dense_rank() OVER icu = 1 AS first_icu_stay
        FROM v_icustays s JOIN v_admissions a ON a.hadm_id = s.hadm_id JOIN v_patients p ON p.subject_id = s.subject_id
        WINDOW adm AS (PARTITION BY s.subject_id ORDER BY admittime NULLS FIRST), icu AS (PARTITION BY s.hadm_id ORDER BY intime NULLS FIRST)"""
    v["v_weight_durations"] = f"""WITH w AS (SELECT stay_id, charttime, CASE itemid WHEN {D.WEIGHT_ADMIT} THEN 'admit' ELSE 'daily' END AS weight_type, valuenum AS weight
            FROM v_chartevents WHERE itemid IN ({D.WEIGHT_ADMIT}, {D.WEIGHT_DAILY}) AND valuenum > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY stay_id, weight_type ORDER BY charttime, weight) AS n FROM w),
        b AS (SELECT r.stay_id, intime, outtime, weight_type, weight, CASE WHEN weight_type = 'admit' AND n = 1 THEN intime - INTERVAL 2 HOUR ELSE charttime END AS starttime
            FROM r JOIN v_icustays s USING (stay_id)),
        d AS (SELECT *, coalesce(lead(starttime) OVER o, outtime + INTERVAL 2 HOUR) AS endtime, row_number() OVER o AS pos FROM b
            WINDOW o AS (PARTITION BY stay_id ORDER BY starttime, weight_type, weight))
        SELECT stay_id, starttime, endtime, weight, weight_type FROM d
        UNION ALL SELECT stay_id, intime - INTERVAL 2 HOUR, starttime, weight, weight_type FROM d WHERE pos = 1 AND intime < starttime"""
    v["v_height"] = f"""SELECT a.subject_id, a.stay_id, a.charttime, coalesce(a.h, b.h) AS height FROM
        (SELECT subject_id, stay_id, charttime, {dec('valuenum', 2)} AS h FROM v_chartevents WHERE itemid = {D.HEIGHT_CM} AND valuenum IS NOT NULL) a
        FULL JOIN (SELECT subject_id, charttime, {dec('valuenum * 2.54', 2)} AS h FROM v_chartevents WHERE itemid = {D.HEIGHT_INCH} AND valuenum IS NOT NULL) b
        ON a.subject_id = b.subject_id AND a.charttime = b.charttime WHERE coalesce(a.h, b.h) > 120 AND coalesce(a.h, b.h) < 230"""
    v["v_cardiac_marker"] = lab_view(D.CARDIAC_MARKER, "valuenum IS NOT NULL")
    v["v_chemistry"] = lab_view(D.CHEMISTRY, f"valuenum IS NOT NULL AND (valuenum > 0 OR itemid = {D.ANION_GAP})")
    v["v_coagulation"] = lab_view(D.COAGULATION, "valuenum IS NOT NULL")
    v["v_complete_blood_count"] = lab_view(D.BLOOD_COUNT, "valuenum > 0")
    v["v_enzyme"] = lab_view(D.ENZYME, "valuenum > 0")
    v["v_inflammation"] = lab_view(D.INFLAMMATION, "valuenum > 0")
    imputed = {f"{n}_abs": dec(f"CASE WHEN {n}_abs IS NULL AND wbc > 0 AND percent_sum > 0 THEN {n} * wbc / 100 ELSE {n}_abs END", 4) for n in D.IMPUTED}
    v["v_blood_differential"] = (
        "SELECT subject_id, hadm_id, charttime, specimen_id, "
        + ", ".join(f"{imputed[c.name]} AS {c.name}" if c.name in imputed else c.name for c in D.BLOOD_DIFFERENTIAL)
        + " FROM (SELECT max(subject_id) AS subject_id, max(hadm_id) AS hadm_id, max(charttime) AS charttime, specimen_id, "
        + ", ".join(item_value(c, "max") for c in D.BLOOD_DIFFERENTIAL)
        + f", sum(valuenum) FILTER (WHERE itemid IN ({ids(D.DIFFERENTIAL_PERCENT)})) AS percent_sum FROM v_labevents WHERE valuenum >= 0 AND itemid IN "
        + f"({all_items(D.BLOOD_DIFFERENTIAL)}, {D.GRANULOCYTES}) GROUP BY specimen_id)")
    out_gas = ("specimen so2 po2 pco2 fio2_chartevents fio2 aado2".split(), "ph baseexcess bicarbonate totalco2 hematocrit hemoglobin carboxyhemoglobin "
               "methemoglobin chloride calcium temperature potassium sodium lactate glucose".split())
    v["v_bg_all"] = f"""WITH g AS (SELECT max(subject_id) AS subject_id, max(hadm_id) AS hadm_id, max(charttime) AS charttime, specimen_id,
            {', '.join(item_value(c, 'max') for c in D.BLOOD_GAS)}, max({fio2('valuenum', '>', '>')}) FILTER (WHERE itemid = {D.FIO2_LAB}) AS fio2
            FROM v_labevents WHERE itemid IN ({all_items(D.BLOOD_GAS)}, {D.FIO2_LAB}, 50807, 50815, 50819, 50823) GROUP BY specimen_id),
        one AS (SELECT * FROM g WHERE po2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject_id, charttime ORDER BY specimen_id) = 1),
        sat AS (SELECT subject_id AS s_id, charttime AS s_time, avg(valuenum) AS spo2 FROM v_chartevents WHERE itemid = {D.SPO2} AND valuenum > 0 AND valuenum <= 100 GROUP BY ALL),
        frac AS (SELECT subject_id AS f_id, charttime AS f_time, max({fio2('valuenum', '>', '>=')}) AS fio2_chartevents FROM v_chartevents
            WHERE itemid = {D.FIO2_CHARTED} AND valuenum > 0 AND valuenum <= 100 GROUP BY ALL),
        a AS (SELECT one.*, spo2 FROM one LEFT JOIN sat ON s_id = subject_id AND s_time BETWEEN charttime - INTERVAL 2 HOUR AND charttime
            QUALIFY row_number() OVER (PARTITION BY subject_id, charttime ORDER BY s_time DESC NULLS LAST) = 1),
        b AS (SELECT a.*, fio2_chartevents FROM a LEFT JOIN frac ON f_id = subject_id AND f_time BETWEEN charttime - INTERVAL 4 HOUR AND charttime AND fio2_chartevents > 0
            QUALIFY row_number() OVER (PARTITION BY subject_id, charttime ORDER BY f_time DESC NULLS LAST) = 1)
        SELECT subject_id, hadm_id, charttime, {', '.join(out_gas[0])}, coalesce(fio2, fio2_chartevents) / 100 * (760 - 47) - pco2 / 0.8 - po2 AS aado2_calc,
        100 * po2 / coalesce(fio2, fio2_chartevents) AS pao2fio2ratio, {', '.join(out_gas[1])}, spo2 FROM b"""
    v["v_bg"] = "SELECT * EXCLUDE (spo2) FROM v_bg_all"
    r75 = "CAST(75 AS DOUBLE) / CAST(186 AS DOUBLE)"
    v["v_creatinine_baseline"] = f"""SELECT *, CASE WHEN scr_min <= 1.1 OR ckd = 1 THEN scr_min ELSE mdrd_est END AS scr_baseline FROM (
        SELECT a.hadm_id, gender, age, scr_min, coalesce(c.hit, 0) AS ckd, CASE WHEN gender = 'F' THEN {r75} / pow(age, CAST(-0.203 AS DOUBLE)) / pow(CAST(0.742 AS DOUBLE), -1) / 1.154
        ELSE {r75} / pow(pow(age, CAST(-0.203 AS DOUBLE)), -1) / 1.154 END AS mdrd_est
        FROM v_age a LEFT JOIN v_patients p USING (subject_id) LEFT JOIN (SELECT hadm_id, min(creatinine) AS scr_min FROM v_chemistry GROUP BY hadm_id) l ON l.hadm_id = a.hadm_id
        LEFT JOIN (SELECT DISTINCT hadm_id, 1 AS hit FROM v_diagnoses_icd WHERE {D.KIDNEY_DISEASE.predicate()}) c ON c.hadm_id = a.hadm_id WHERE age >= 18)"""
    v["v_gcs"] = f"""WITH b AS (SELECT subject_id, stay_id, charttime, max(valuenum) FILTER (WHERE itemid = {D.GCS_MOTOR}) AS motor,
            max(CASE WHEN value = '{D.INTUBATED_TEXT}' THEN 0 ELSE valuenum END) FILTER (WHERE itemid = {D.GCS_VERBAL}) AS verbal,
            max(valuenum) FILTER (WHERE itemid = {D.GCS_EYES}) AS eyes,
            max(CASE WHEN itemid = {D.GCS_VERBAL} AND value = '{D.INTUBATED_TEXT}' THEN 1 ELSE 0 END) AS gcs_unable
            FROM v_chartevents WHERE itemid IN ({D.GCS_VERBAL}, {D.GCS_MOTOR}, {D.GCS_EYES}) GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY charttime) AS n FROM b)
        SELECT x.subject_id, x.stay_id, x.charttime, CASE WHEN x.verbal = 0 OR (x.verbal IS NULL AND y.verbal = 0) THEN CAST(15 AS DOUBLE)
            WHEN y.verbal = 0 THEN coalesce(x.motor, 6) + coalesce(x.verbal, 5) + coalesce(x.eyes, 4)
            ELSE coalesce(x.motor, y.motor, 6) + coalesce(x.verbal, y.verbal, 5) + coalesce(x.eyes, y.eyes, 4) END AS gcs,
            coalesce(x.motor, y.motor) AS gcs_motor, coalesce(x.verbal, y.verbal) AS gcs_verbal, coalesce(x.eyes, y.eyes) AS gcs_eyes, x.gcs_unable
        FROM o x LEFT JOIN o y ON y.stay_id = x.stay_id AND y.n = x.n - 1 AND y.charttime > x.charttime - INTERVAL 6 HOUR"""
    v["v_icp"] = f"""SELECT subject_id, stay_id, charttime, {item_value(D.ICP[0], 'max')} FROM v_chartevents WHERE itemid IN ({all_items(D.ICP)}) GROUP BY ALL"""
    v["v_rhythm"] = f"""SELECT subject_id, charttime, {', '.join(item_value(c, 'max') for c in D.RHYTHM)} FROM v_chartevents
        WHERE stay_id IS NOT NULL AND itemid IN ({all_items(D.RHYTHM)}) GROUP BY subject_id, charttime"""
    v["v_ventilator_setting"] = f"""SELECT subject_id, max(stay_id) AS stay_id, charttime, {', '.join(item_value(c, 'max') for c in D.VENTILATOR)},
        max({fio2('valuenum', '>=', '>=')}) FILTER (WHERE itemid = {D.FIO2_CHARTED}) AS fio2 FROM v_chartevents
        WHERE value IS NOT NULL AND stay_id IS NOT NULL AND itemid IN ({all_items(D.VENTILATOR)}, {D.FIO2_CHARTED}) GROUP BY subject_id, charttime"""
    v["v_vitalsign"] = f"""SELECT subject_id, stay_id, charttime, {', '.join(item_value(c, 'avg') for c in D.VITALS)},
        {dec(f"avg(CASE WHEN itemid = {D.TEMP_FAHRENHEIT} AND valuenum > 70 AND valuenum < 120 THEN (valuenum - 32) / 1.8 WHEN itemid = {D.TEMP_CELSIUS} AND valuenum > 10 AND valuenum < 50 THEN valuenum END)", 2)} AS temperature,
        max(value) FILTER (WHERE itemid = {D.TEMP_SITE}) AS temperature_site FROM v_chartevents WHERE stay_id IS NOT NULL
        AND itemid IN ({all_items(D.VITALS)}, {D.TEMP_FAHRENHEIT}, {D.TEMP_CELSIUS}, {D.TEMP_SITE}) GROUP BY subject_id, stay_id, charttime"""
    v["v_oxygen_delivery"] = f"""WITH f AS (SELECT subject_id, stay_id, charttime, CASE WHEN itemid = {D.O2_FLOW_BIPAP} THEN {D.O2_FLOW} ELSE itemid END AS kind, valuenum, storetime
            FROM v_chartevents WHERE value IS NOT NULL AND itemid IN ({D.O2_FLOW}, {D.O2_FLOW_BIPAP}, {D.O2_FLOW_ADDITIONAL})),
        l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY subject_id, charttime, kind ORDER BY storetime DESC NULLS LAST) = 1),
        d AS (SELECT subject_id, charttime, value, row_number() OVER (PARTITION BY subject_id, charttime ORDER BY value NULLS FIRST) AS n FROM v_chartevents WHERE itemid = {D.O2_DEVICE})
        SELECT l.subject_id, max(l.stay_id) AS stay_id, l.charttime, max(valuenum) FILTER (WHERE kind = {D.O2_FLOW}) AS o2_flow,
        max(valuenum) FILTER (WHERE kind = {D.O2_FLOW_ADDITIONAL}) AS o2_flow_additional,
        {', '.join(f"max(d.value) FILTER (WHERE n = {i}) AS o2_delivery_device_{i}" for i in (1, 2, 3, 4))}
        FROM l LEFT JOIN d ON d.subject_id = l.subject_id AND d.charttime = l.charttime GROUP BY l.subject_id, l.charttime"""
    v["v_urine_output"] = f"""SELECT stay_id, charttime, sum(CASE WHEN itemid = {D.IRRIGANT_IN} AND value > 0 THEN -value ELSE value END) AS urineoutput
        FROM v_outputevents WHERE itemid IN ({ids(D.URINE_ITEMS)}) GROUP BY ALL"""
    frames = ", ".join(
        f"sum(y.urineoutput) FILTER (WHERE y.charttime >= x.charttime - INTERVAL {reach} HOUR) AS urineoutput_{h}hr, "
        f"sum(y.since) FILTER (WHERE y.charttime >= x.charttime - INTERVAL {reach} HOUR) / CAST(60 AS DOUBLE) AS tm_{h}" for h, reach in ((6, 5), (12, 11), (24, 23)))
    v["v_urine_output_rate"] = f"""WITH h AS (SELECT s.stay_id, min(charttime) AS first_hr FROM v_icustays s JOIN v_chartevents c ON c.stay_id = s.stay_id AND c.itemid = {D.HEART_RATE}
            AND c.charttime > s.intime - INTERVAL 1 MONTH AND c.charttime < s.outtime + INTERVAL 1 MONTH GROUP BY s.stay_id),
        u AS (SELECT o.stay_id, charttime, urineoutput, (epoch_us(charttime) - epoch_us(coalesce(lag(charttime) OVER (PARTITION BY o.stay_id ORDER BY charttime), first_hr)))
            / CAST(60000000 AS DOUBLE) AS since FROM v_urine_output o JOIN h USING (stay_id)),
        r AS (SELECT x.stay_id, x.charttime, x.urineoutput AS uo, {frames} FROM u x JOIN u y ON y.stay_id = x.stay_id AND y.charttime <= x.charttime
            AND y.charttime >= x.charttime - INTERVAL 23 HOUR GROUP BY x.stay_id, x.charttime, x.urineoutput)
        SELECT r.stay_id, r.charttime, weight, uo, urineoutput_6hr, urineoutput_12hr, urineoutput_24hr,
        {', '.join(f"CASE WHEN tm_{h} >= {h} THEN {dec(f'urineoutput_{h}hr / weight / tm_{h}', 4)} END AS uo_mlkghr_{h}hr, {dec(f'tm_{h}', 2)} AS uo_tm_{h}hr" for h in (6, 12, 24))}
        FROM r LEFT JOIN v_weight_durations w ON w.stay_id = r.stay_id AND r.charttime > w.starttime AND r.charttime <= w.endtime AND w.weight > 0"""
    # --- comorbidity, drugs, treatment ---
    single = ("myocardial_infarct", "congestive_heart_failure", "peripheral_vascular_disease", "cerebrovascular_disease", "dementia",
              "chronic_pulmonary_disease", "rheumatic_disease", "peptic_ulcer_disease")
    v["v_charlson"] = f"""SELECT *, age_score + {' + '.join(single)} + greatest(mild_liver_disease, severe_liver_disease * 3) + greatest(diabetes_without_cc, diabetes_with_cc * 2)
        + greatest(malignant_cancer * 2, metastatic_solid_tumor * 6) + (paraplegia + renal_disease) * 2 + aids * 6 AS charlson_comorbidity_index FROM (
        SELECT a.subject_id, a.hadm_id, CASE WHEN age <= 50 THEN 0 WHEN age <= 60 THEN 1 WHEN age <= 70 THEN 2 WHEN age <= 80 THEN 3 ELSE 4 END AS age_score,
        {', '.join(f'coalesce({n}, 0) AS {n}' for n in D.CHARLSON)} FROM v_admissions a
        LEFT JOIN (SELECT hadm_id, {flags(D.CHARLSON)} FROM v_diagnoses_icd GROUP BY hadm_id) f USING (hadm_id) LEFT JOIN v_age g ON g.hadm_id = a.hadm_id)"""

    def keyword(col: str, words) -> str:
        return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"
    for name, words in (("acei", D.ACE_INHIBITORS), ("arb", D.RECEPTOR_BLOCKERS), ("nsaid", D.ANTI_INFLAMMATORY)):
        v[f"v_{name}"] = f"SELECT subject_id, hadm_id, drug AS {name}, starttime, stoptime FROM v_prescriptions WHERE {keyword('drug', words)}"
    v["v_antibiotic"] = f"""SELECT p.subject_id, p.hadm_id, stay_id, p.drug AS antibiotic, p.route, starttime, stoptime FROM v_prescriptions p
        JOIN (SELECT DISTINCT drug, route FROM v_prescriptions WHERE drug_type <> 'BASE' AND route NOT IN ({texts(D.EXCLUDED_ROUTES)})
            AND NOT {keyword('route', D.EXCLUDED_ROUTE_WORDS)} AND NOT {keyword('drug', D.EXCLUDED_FORMS)} AND {keyword('drug', D.ANTIBIOTICS)}) k
        ON k.drug = p.drug AND k.route = p.route LEFT JOIN v_icustays s ON s.hadm_id = p.hadm_id AND p.starttime >= s.intime AND p.starttime < s.outtime"""
    rates = {"norepinephrine": "CASE WHEN rateuom = 'mg/kg/min' AND patientweight <> 1 THEN rate * 1000 ELSE rate END",
             "phenylephrine": "CASE rateuom WHEN 'mcg/min' THEN rate / patientweight ELSE rate END",
             "vasopressin": "CASE rateuom WHEN 'units/min' THEN rate * 60 ELSE rate END"}
    for name, item in D.INFUSIONS.items():
        v[f"v_{name}"] = f"SELECT stay_id, linkorderid, {rates.get(name, 'rate')} AS vaso_rate, amount AS vaso_amount, starttime, endtime FROM v_inputevents WHERE itemid = {item}"
    v["v_neuroblock"] = f"""SELECT stay_id, orderid, rate AS drug_rate, amount AS drug_amount, starttime, endtime FROM v_inputevents
        WHERE itemid IN ({ids(D.NEUROBLOCK)}) AND rate IS NOT NULL"""
    agents = list(D.INFUSIONS)
    v["v_vasoactive_agent"] = f"""WITH t AS ({' UNION '.join(f'SELECT stay_id, {c} AS moment FROM v_{a}' for a in agents for c in ('starttime', 'endtime'))}),
        g AS (SELECT stay_id, moment AS starttime, lead(moment) OVER (PARTITION BY stay_id ORDER BY moment) AS endtime FROM t)
        SELECT g.*, {', '.join(f'r_{a}.vaso_rate AS {a}' for a in agents)} FROM g
        {' '.join(f'LEFT JOIN v_{a} r_{a} ON r_{a}.stay_id = g.stay_id AND r_{a}.starttime <= g.starttime AND r_{a}.endtime >= g.endtime' for a in agents)}
        WHERE g.endtime IS NOT NULL"""
    v["v_norepinephrine_equivalent_dose"] = f"""SELECT stay_id, starttime, endtime, {dec("coalesce(norepinephrine, 0) + coalesce(epinephrine, 0) + coalesce(phenylephrine / 10, 0) + coalesce(dopamine / 100, 0) + coalesce(vasopressin * 2.5 / 60, 0)", 4)}
        AS norepinephrine_equivalent_dose FROM v_vasoactive_agent WHERE coalesce(norepinephrine, epinephrine, phenylephrine, dopamine, vasopressin) IS NOT NULL"""
    state_cols = ", ".join(
        f"max(CASE WHEN value IN ({texts(on)}) THEN 1 {f'WHEN value IN ({texts(off)}) THEN 0' if off else ''} END) FILTER (WHERE itemid = {D.CRRT_SYSTEM}) AS {n}"
        for n, (on, off) in D.CRRT_STATES.items())
    v["v_crrt"] = f"""SELECT stay_id, charttime, {', '.join(item_value(c, 'max') for c in D.CRRT)}, {state_cols} FROM v_chartevents
        WHERE value IS NOT NULL AND itemid IN ({all_items(D.CRRT)}, {D.CRRT_SYSTEM}) GROUP BY stay_id, charttime"""

    def canon(col: str, mapping) -> str:
        return "CASE " + " ".join(f"WHEN {col} IN ({texts(vs)}) THEN '{k}'" for k, vs in mapping.items()) + f" ELSE {col} END"
    v["v_invasive_line"] = f"""SELECT stay_id, {canon('label', D.LINE_TYPES)} AS line_type, {canon('location', D.LINE_SITES)} AS line_site, starttime, endtime
        FROM v_procedureevents JOIN v_d_items USING (itemid) WHERE itemid IN ({ids(D.INVASIVE_LINES)})"""
    proc_type = "CASE itemid " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in D.DIALYSIS_PROCEDURES.items() if t) + " END"
    v["v_rrt"] = f"""WITH c AS (SELECT stay_id, charttime, CASE WHEN itemid IN ({ids(D.DIALYSIS_ACTIVE_ITEMS)}) OR (itemid = {D.PERITONEAL_STATUS} AND value = '{D.PERITONEAL_IN_USE}') THEN 1 ELSE 0 END AS active,
            CASE WHEN itemid = {D.CRRT_MODE} THEN value WHEN itemid IN ({ids(D.PERITONEAL_ITEMS)}) THEN 'Peritoneal' WHEN itemid = {D.HEMODIALYSIS_OUTPUT} THEN 'IHD' END AS kind
            FROM v_chartevents WHERE value IS NOT NULL AND itemid IN ({ids(D.DIALYSIS_ITEMS)})),
        m AS (SELECT stay_id, starttime, endtime, 1 AS active, 'CRRT' AS kind FROM v_inputevents WHERE itemid IN ({ids(D.DIALYSIS_INFUSIONS)}) AND amount > 0
            UNION SELECT stay_id, starttime, endtime, CASE WHEN itemid IN ({ids(D.DIALYSIS_PASSIVE)}) THEN 0 ELSE 1 END, {proc_type} FROM v_procedureevents
            WHERE itemid IN ({ids(D.DIALYSIS_PROCEDURES)}) AND value IS NOT NULL),
        t AS (SELECT stay_id, charttime, active, kind FROM c UNION SELECT stay_id, starttime, active, kind FROM m)
        SELECT t.stay_id, charttime, 1 AS dialysis_present, coalesce(m.active, t.active) AS dialysis_active, coalesce(m.kind, t.kind) AS dialysis_type
        FROM t LEFT JOIN m ON m.stay_id = t.stay_id AND t.charttime BETWEEN m.starttime AND m.endtime"""
    dev = "o2_delivery_device_1"
    v["v_ventilation"] = f"""WITH s AS (SELECT stay_id, charttime, CASE WHEN {dev} IN ({texts(D.TRACH_DEVICES)}) THEN 'Tracheostomy'
            WHEN {dev} IN ({texts(D.INVASIVE_DEVICES)}) OR ventilator_mode IN ({texts(D.INVASIVE_MODES)}) OR ventilator_mode_hamilton IN ({texts(D.INVASIVE_HAMILTON)}) THEN 'InvasiveVent'
            WHEN {dev} IN ({texts(D.NONINVASIVE_DEVICES)}) OR ventilator_mode_hamilton IN ({texts(D.NONINVASIVE_HAMILTON)}) THEN 'NonInvasiveVent'
            WHEN {dev} IN ({texts(D.HIGH_FLOW_DEVICES)}) THEN 'HFNC' WHEN {dev} IN ({texts(D.SUPPLEMENTAL_DEVICES)}) THEN 'SupplementalOxygen'
            WHEN {dev} IN ({texts(D.NO_DEVICE)}) THEN 'None' END AS st
            FROM (SELECT stay_id, charttime FROM v_ventilator_setting UNION SELECT stay_id, charttime FROM v_oxygen_delivery)
            LEFT JOIN v_ventilator_setting USING (stay_id, charttime) LEFT JOIN v_oxygen_delivery USING (stay_id, charttime)),
        n AS (SELECT *, lag(charttime) OVER (PARTITION BY stay_id, st ORDER BY charttime) AS same, lag(st) OVER w AS before, lead(charttime) OVER w AS after
            FROM s WHERE st IS NOT NULL WINDOW w AS (PARTITION BY stay_id ORDER BY charttime)),
        e AS (SELECT *, sum(CASE WHEN before IS NULL OR charttime - same >= INTERVAL 14 HOUR OR before <> st THEN 1 ELSE 0 END) OVER (PARTITION BY stay_id ORDER BY charttime) AS ep FROM n)
        SELECT stay_id, min(charttime) AS starttime, max(CASE WHEN after IS NULL OR after - charttime >= INTERVAL 14 HOUR THEN charttime ELSE after END) AS endtime,
        max(st) AS ventilation_status FROM e GROUP BY stay_id, ep HAVING min(charttime) <> max(charttime)"""
    # --- first day ---
    v["v_first_day_bg"] = first_day("v_bg", "subject_id", minmax(_pairs(GAS_COLUMNS)))
    v["v_first_day_bg_art"] = first_day("v_bg", "subject_id", minmax(_pairs(GAS_COLUMNS)), "AND p.specimen = 'ART.'")
    v["v_first_day_gcs"] = """SELECT s.subject_id, s.stay_id, gcs AS gcs_min, gcs_motor, gcs_verbal, gcs_eyes, gcs_unable FROM v_icustays s LEFT JOIN
        (SELECT g.* FROM v_gcs g JOIN v_icustays i ON i.stay_id = g.stay_id AND g.charttime BETWEEN i.intime - INTERVAL 6 HOUR AND i.intime + INTERVAL 1 DAY
        QUALIFY row_number() OVER (PARTITION BY g.stay_id ORDER BY g.gcs NULLS FIRST, g.charttime) = 1) b ON b.stay_id = s.stay_id"""
    v["v_first_day_height"] = first_day("v_height", "stay_id", f"{dec('avg(height)', 2)} AS height")
    v["v_first_day_weight"] = """SELECT s.subject_id, s.stay_id, avg(weight) FILTER (WHERE weight_type = 'admit') AS weight_admit, avg(weight) AS weight, min(weight) AS weight_min,
        max(weight) AS weight_max FROM v_icustays s LEFT JOIN v_weight_durations w ON w.stay_id = s.stay_id AND w.starttime <= s.intime + INTERVAL 1 DAY GROUP BY ALL"""
    for table, cols in LAB_COLUMNS.items():
        v[f"v_fd_{table}"] = first_day(f"v_{table}", "subject_id", minmax(cols))
    v["v_first_day_lab"] = (f"SELECT s.subject_id, s.stay_id, {', '.join(f'{c}_min, {c}_max' for c in LAB_STEMS)} FROM v_icustays s "
                            + " ".join(f"JOIN (SELECT * EXCLUDE (subject_id) FROM v_fd_{t}) x_{t} USING (stay_id)" for t in LAB_COLUMNS))
    v["v_first_day_rrt"] = first_day("v_rrt", "stay_id", """max(dialysis_present) AS dialysis_present, max(dialysis_active) AS dialysis_active,
        string_agg(DISTINCT dialysis_type, ', ' ORDER BY dialysis_type) AS dialysis_type""")
    v["v_first_day_urine_output"] = first_day("v_urine_output", "stay_id", "sum(urineoutput) AS urineoutput", low="s.intime")
    v["v_first_day_vitalsign"] = first_day("v_vitalsign", "stay_id", minmax(_pairs(VITAL_COLUMNS), ("min", "max", "mean")))
    inv = "ventilation_status = 'InvasiveVent'"
    drugs = ("norepinephrine", "epinephrine", "dopamine", "dobutamine")
    window = "BETWEEN s.intime - INTERVAL 6 HOUR AND s.intime + INTERVAL 1 DAY"
    v["v_first_day_sofa"] = f"""WITH pf AS (SELECT s.stay_id, min(pao2fio2ratio) FILTER (WHERE e.stay_id IS NULL) AS pao2fio2ratio_novent,
            min(pao2fio2ratio) FILTER (WHERE e.stay_id IS NOT NULL) AS pao2fio2ratio_vent FROM v_icustays s JOIN v_bg b ON b.subject_id = s.subject_id AND b.charttime {window}
            LEFT JOIN v_ventilation e ON e.stay_id = s.stay_id AND b.charttime BETWEEN e.starttime AND e.endtime AND e.{inv} GROUP BY s.stay_id),
        c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, {', '.join(f'(SELECT max(vaso_rate) FROM v_{d} x WHERE x.stay_id = s.stay_id AND x.starttime {window}) AS rate_{d}' for d in drugs)},
            pao2fio2ratio_novent, pao2fio2ratio_vent, mbp_min AS meanbp_min, creatinine_max, bilirubin_total_max AS bilirubin_max, platelets_min AS platelet_min,
            urineoutput AS uo_24hr, gcs_min FROM v_icustays s LEFT JOIN pf USING (stay_id) LEFT JOIN v_first_day_vitalsign fv USING (stay_id)
            LEFT JOIN v_first_day_lab fl USING (stay_id) LEFT JOIN v_first_day_urine_output fu USING (stay_id) LEFT JOIN v_first_day_gcs fg USING (stay_id)),
        p AS (SELECT subject_id, hadm_id, stay_id, {scores(D.FIRST_DAY_SOFA)} FROM c) SELECT *, {total_sql(D.SOFA_PARTS)} AS sofa FROM p"""
    # --- kidney ---
    v["v_kdigo_creatinine"] = f"""WITH c AS (SELECT s.hadm_id, s.stay_id, l.charttime, avg(valuenum) AS creat FROM v_icustays s LEFT JOIN v_labevents l ON l.subject_id = s.subject_id
            AND itemid = {D.CREATININE} AND valuenum <= 150 AND l.charttime BETWEEN s.intime - INTERVAL 7 DAY AND s.outtime GROUP BY ALL)
        SELECT c.hadm_id, c.stay_id, c.charttime, c.creat, min(b.creat) FILTER (WHERE b.charttime >= c.charttime - INTERVAL 48 HOUR) AS creat_low_past_48hr,
        min(b.creat) AS creat_low_past_7day FROM c LEFT JOIN c b ON b.stay_id = c.stay_id AND b.charttime < c.charttime AND b.charttime >= c.charttime - INTERVAL 7 DAY
        GROUP BY c.hadm_id, c.stay_id, c.charttime, c.creat"""
    kd = ", ".join(f"sum(y.urineoutput) FILTER (WHERE y.charttime >= x.charttime - INTERVAL {h} HOUR) AS urineoutput_{h}hr, "
                   f"sum(y.hours) FILTER (WHERE y.charttime >= x.charttime - INTERVAL {h} HOUR) AS uo_tm_{h}hr" for h in (6, 12, 24))
    v["v_kdigo_uo"] = f"""WITH u AS (SELECT o.stay_id, charttime, urineoutput, coalesce((epoch_us(charttime) - epoch_us(lag(charttime) OVER (PARTITION BY o.stay_id ORDER BY charttime)))
            / CAST(3600000000 AS DOUBLE), 1) AS hours FROM v_urine_output o JOIN v_icustays s USING (stay_id)),
        r AS (SELECT x.stay_id, x.charttime, {kd} FROM u x JOIN u y ON y.stay_id = x.stay_id AND y.charttime <= x.charttime AND y.charttime >= x.charttime - INTERVAL 24 HOUR GROUP BY ALL)
        SELECT r.*, weight, CASE WHEN uo_tm_6hr >= 6 AND uo_tm_6hr < 12 THEN {dec('urineoutput_6hr / weight / uo_tm_6hr', 4)} END AS uo_rt_6hr,
        {', '.join(f"CASE WHEN uo_tm_{h}hr >= {h} THEN {dec(f'urineoutput_{h}hr / weight / uo_tm_{h}hr', 4)} END AS uo_rt_{h}hr" for h in (12, 24))}
        FROM r LEFT JOIN v_weight_durations w ON w.stay_id = r.stay_id AND r.charttime >= w.starttime AND r.charttime < w.endtime"""
    v["v_kdigo_stages"] = f"""WITH c AS (SELECT *, {D.KDIGO_CREATININE.sql()} AS aki_stage_creat FROM v_kdigo_creatinine),
        u AS (SELECT k.*, {D.KDIGO_URINE.sql()} AS aki_stage_uo FROM v_kdigo_uo k JOIN v_icustays s USING (stay_id)),
        d AS (SELECT stay_id, charttime, 3 AS aki_stage_crrt FROM v_crrt WHERE crrt_mode IS NOT NULL),
        t AS (SELECT stay_id, charttime FROM c UNION SELECT stay_id, charttime FROM u UNION SELECT stay_id, charttime FROM d),
        x AS (SELECT s.subject_id, s.hadm_id, s.stay_id, t.charttime, s.intime, creat_low_past_7day, creat_low_past_48hr, creat, aki_stage_creat, uo_rt_6hr, uo_rt_12hr, uo_rt_24hr,
            aki_stage_uo, aki_stage_crrt, greatest(coalesce(aki_stage_creat, 0), coalesce(aki_stage_uo, 0), coalesce(aki_stage_crrt, 0)) AS aki_stage
            FROM v_icustays s LEFT JOIN t ON t.stay_id = s.stay_id LEFT JOIN c ON c.stay_id = s.stay_id AND c.charttime = t.charttime
            LEFT JOIN u ON u.stay_id = s.stay_id AND u.charttime = t.charttime LEFT JOIN d ON d.stay_id = s.stay_id AND d.charttime = t.charttime)
        SELECT * EXCLUDE (intime), max(aki_stage) OVER (PARTITION BY subject_id ORDER BY (epoch_us(charttime) - epoch_us(intime)) // 1000000 NULLS FIRST
            RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS aki_stage_smoothed FROM x"""
    lnf = "ln(greatest(coalesce({}, 1), 1))".format
    v["v_meld"] = f"""SELECT subject_id, hadm_id, stay_id, meld_initial, CASE WHEN meld_initial > 11 THEN meld_initial + CAST(1.32 AS DOUBLE) * na - CAST(0.033 AS DOUBLE) * meld_initial * na ELSE meld_initial END AS meld,
        rrt, creatinine_max, bilirubin_total_max, inr_max, sodium_min FROM (SELECT *, CASE WHEN raw > 4 THEN CAST(40 AS DOUBLE) ELSE {dec('raw', 1)} * 10 END AS meld_initial FROM (
        SELECT s.subject_id, s.hadm_id, s.stay_id, dialysis_present AS rrt, creatinine_max, bilirubin_total_max, inr_max, sodium_min,
        CASE WHEN sodium_min IS NULL OR sodium_min > 137 THEN CAST(0 AS DOUBLE) WHEN sodium_min < 125 THEN CAST(12 AS DOUBLE) ELSE 137 - sodium_min END AS na,
        CAST(0.957 AS DOUBLE) * CASE WHEN dialysis_present = 1 OR creatinine_max > 4 THEN ln(4) ELSE {lnf('creatinine_max')} END
        + CAST(0.378 AS DOUBLE) * {lnf('bilirubin_total_max')} + (CAST(1.120 AS DOUBLE) * {lnf('inr_max')} + CAST(0.643 AS DOUBLE)) AS raw
        FROM v_icustays s LEFT JOIN v_first_day_lab l USING (stay_id) LEFT JOIN v_first_day_rrt r USING (stay_id)))"""
    # --- hourly score: every source joins the grid ---
    grid_join = "FROM co LEFT JOIN {src} p ON p.{key} = co.{key} AND p.charttime > co.starttime AND p.charttime <= co.endtime GROUP BY co.stay_id, co.hr"
    hourly = {"vs": ("min(p.mbp) AS meanbp_min", "v_vitalsign", "stay_id"), "gc": ("min(p.gcs) AS gcs_min", "v_gcs", "stay_id"),
              "bi": ("max(p.bilirubin_total) AS bilirubin_max", "v_enzyme", "hadm_id"), "cr": ("max(p.creatinine) AS creatinine_max", "v_chemistry", "hadm_id"),
              "pl": ("min(p.platelet) AS platelet_min", "v_complete_blood_count", "hadm_id"),
              "uo": ("max(p.urineoutput_24hr / p.uo_tm_24hr * 24) FILTER (WHERE p.uo_tm_24hr BETWEEN 22 AND 30) AS uo_24hr", "v_urine_output_rate", "stay_id"),
              "pf": ("min(p.novent) AS pao2fio2ratio_novent, min(p.vent) AS pao2fio2ratio_vent", "pafi", "stay_id")}
    for d in ("epinephrine", "norepinephrine", "dopamine", "dobutamine"):
        hourly[f"r_{d}"] = (f"max(p.vaso_rate) AS rate_{d}", f"v_{d}", "")
    ctes = []
    for n, (agg, src, key) in hourly.items():
        join = grid_join.format(src=src, key=key) if key else f"FROM co LEFT JOIN {src} p ON p.stay_id = co.stay_id AND co.endtime > p.starttime AND co.endtime <= p.endtime GROUP BY co.stay_id, co.hr"
        ctes.append(f"{n} AS (SELECT co.stay_id, co.hr, {agg} {join})")
    roll = ", ".join(f"coalesce(max({c}) OVER w, 0) AS {c}_24hours" for c in D.SOFA_PARTS)
    v["v_sofa"] = f"""WITH co AS (SELECT g.stay_id, s.hadm_id, hr, endtime - INTERVAL 1 HOUR AS starttime, endtime FROM v_icustay_hourly g JOIN v_icustays s USING (stay_id)),
        pafi AS (SELECT s.stay_id, b.charttime, CASE WHEN e.stay_id IS NULL THEN pao2fio2ratio END AS novent, CASE WHEN e.stay_id IS NOT NULL THEN pao2fio2ratio END AS vent
            FROM v_icustays s JOIN v_bg b ON b.subject_id = s.subject_id AND specimen = 'ART.' LEFT JOIN v_ventilation e ON e.stay_id = s.stay_id
            AND b.charttime BETWEEN e.starttime AND e.endtime AND e.{inv}), {', '.join(ctes)},
        a AS (SELECT co.stay_id, co.hr, co.starttime, co.endtime, pao2fio2ratio_novent, pao2fio2ratio_vent, rate_epinephrine, rate_norepinephrine, rate_dopamine, rate_dobutamine,
            meanbp_min, gcs_min, uo_24hr, bilirubin_max, creatinine_max, platelet_min FROM co {' '.join(f'JOIN {n} USING (stay_id, hr)' for n in hourly)}),
        p AS (SELECT a.*, {scores(D.SOFA)} FROM a), q AS (SELECT *, {roll} FROM p WINDOW w AS (PARTITION BY stay_id ORDER BY hr ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
        SELECT *, {' + '.join(f'{c}_24hours' for c in D.SOFA_PARTS)} AS sofa_24hours FROM q WHERE hr >= 0"""
    # --- admission scores ---
    v["v_sirs"] = f"""SELECT *, {total_sql([s.name for s in D.SIRS])} AS sirs FROM (SELECT subject_id, hadm_id, stay_id, {scores(D.SIRS)} FROM (
        SELECT s.subject_id, s.hadm_id, s.stay_id, pco2_min AS paco2_min, fv.temperature_min, fv.temperature_max, heart_rate_max, resp_rate_max, wbc_min, wbc_max, bands_max
        FROM v_icustays s LEFT JOIN v_first_day_bg_art a USING (stay_id) LEFT JOIN v_first_day_vitalsign fv USING (stay_id) LEFT JOIN v_first_day_lab l USING (stay_id)))"""
    v["v_lods"] = f"""WITH m AS (SELECT c.stay_id, min(charttime) - INTERVAL 1 HOUR AS a, max(charttime) + INTERVAL 4 HOUR AS z FROM v_chartevents c JOIN v_icustays s USING (stay_id)
            WHERE itemid = {D.O2_DEVICE} AND charttime BETWEEN intime AND intime + INTERVAL 1 DAY AND (lower(value) LIKE '%cpap%' OR lower(value) LIKE '%bipap mask%') GROUP BY c.stay_id),
        pf AS (SELECT s.stay_id, min(pao2fio2ratio) AS pao2fio2_vent_min FROM v_bg b JOIN v_icustays s ON s.hadm_id = b.hadm_id AND b.charttime >= s.intime AND b.charttime < s.outtime
            WHERE EXISTS (FROM v_ventilation e WHERE e.stay_id = s.stay_id AND e.{inv} AND b.charttime BETWEEN e.starttime AND e.endtime)
            OR EXISTS (FROM m WHERE m.stay_id = s.stay_id AND b.charttime BETWEEN m.a AND m.z) GROUP BY s.stay_id),
        c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, gcs_min, heart_rate_max, heart_rate_min, sbp_max, sbp_min, pao2fio2_vent_min, bun_max, wbc_max, wbc_min,
            bilirubin_total_max AS bilirubin_max, creatinine_max, pt_min, pt_max, platelets_min AS platelet_min, urineoutput FROM v_icustays s LEFT JOIN pf USING (stay_id)
            LEFT JOIN v_first_day_gcs g USING (stay_id) LEFT JOIN v_first_day_vitalsign fv USING (stay_id) LEFT JOIN v_first_day_urine_output u USING (stay_id) LEFT JOIN v_first_day_lab l USING (stay_id))
        SELECT *, {total_sql([s.name for s in D.LODS])} AS lods FROM (SELECT subject_id, hadm_id, stay_id, {scores(D.LODS)} FROM c)"""
    day1 = "intime + INTERVAL 1 DAY"
    v["v_vent_day"] = f"""SELECT s.stay_id, max(CASE WHEN e.stay_id IS NULL THEN 0 ELSE 1 END) AS vent FROM v_icustays s LEFT JOIN v_ventilation e ON e.stay_id = s.stay_id AND e.{inv} AND (
        e.starttime BETWEEN s.intime AND s.{day1} OR e.endtime BETWEEN s.intime AND s.{day1} OR (e.starttime <= s.intime AND e.endtime >= s.{day1})) GROUP BY s.stay_id"""
    shown = []
    for vital, rules in D.OASIS_VITALS.items():
        extreme, value_name, _ = D.OASIS_NAMES[vital]
        shown.append(f"CASE WHEN {vital}_{extreme} IS NULL THEN NULL " + " ".join(f"WHEN {t} THEN {vital}_{side}" for t, _p, side in rules)
                     + f" ELSE ({vital}_min + {vital}_max) / 2 END AS {value_name}")
    names = [s.name for s in D.OASIS]
    v["v_oasis"] = f"""WITH c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, (epoch_us(intime) - epoch_us(a.admittime)) / CAST(60000000 AS DOUBLE) AS preiculos, age, gcs_min,
            {', '.join(f'fv.{x}_{m}' for x in D.OASIS_VITALS for m in ('min', 'max'))}, urineoutput, vent AS mechvent,
            CASE WHEN admission_type IS NULL THEN NULL WHEN admission_type = 'ELECTIVE' AND EXISTS (FROM v_services z WHERE z.hadm_id = s.hadm_id AND z.transfertime < s.{day1}
                AND (lower(curr_service) LIKE '%surg%' OR curr_service = 'ORTHO')) THEN 1 ELSE 0 END AS electivesurgery
            FROM v_icustays s JOIN v_admissions a ON a.hadm_id = s.hadm_id LEFT JOIN v_age g ON g.hadm_id = s.hadm_id LEFT JOIN v_vent_day d ON d.stay_id = s.stay_id
            LEFT JOIN v_first_day_gcs x ON x.stay_id = s.stay_id LEFT JOIN v_first_day_vitalsign fv ON fv.stay_id = s.stay_id LEFT JOIN v_first_day_urine_output u ON u.stay_id = s.stay_id),
        p AS (SELECT subject_id, hadm_id, stay_id, age, preiculos, gcs_min AS gcs, {', '.join(shown)}, urineoutput, mechvent, electivesurgery, {scores(D.OASIS)} FROM c),
        q AS (SELECT *, {total_sql(names)} AS oasis FROM p) SELECT *, 1 / (1 + exp(-(CAST(-6.1746 AS DOUBLE) + CAST(0.1275 AS DOUBLE) * oasis))) AS oasis_prob FROM q"""
    win = "p.charttime > s.intime AND p.charttime <= s.intime + INTERVAL 24 HOUR"

    def saps_part(table: str, key: str, aggs: str) -> str:
        return f"(SELECT s.stay_id, {aggs} FROM v_icustays s LEFT JOIN {table} p ON p.{key} = s.{key} AND {win} GROUP BY s.stay_id)"
    mm = lambda pairs: ", ".join(f"{f}(p.{c}) AS {n}_{f}" for c, n in pairs for f in ("min", "max"))
    saps_names = [s.name for s in D.SAPS2]
    v["v_sapsii"] = f"""WITH m AS (SELECT s.subject_id, s.stay_id, greatest(min(charttime) - INTERVAL 1 HOUR, s.intime) AS a, least(max(charttime) + INTERVAL 4 HOUR, s.intime + INTERVAL 24 HOUR) AS z
            FROM v_icustays s JOIN v_chartevents p ON p.stay_id = s.stay_id AND {win} WHERE itemid = {D.O2_DEVICE} AND regexp_matches(lower(value), '(cpap mask|bipap)') GROUP BY s.subject_id, s.stay_id, s.intime),
        pf AS (SELECT s.stay_id, min(pao2fio2ratio) AS pao2fio2_vent_min FROM v_icustays s JOIN v_bg p ON p.subject_id = s.subject_id AND p.specimen = 'ART.' AND {win}
            WHERE EXISTS (FROM v_ventilation e WHERE e.stay_id = s.stay_id AND e.{inv} AND p.charttime > e.starttime AND p.charttime <= e.endtime)
            OR EXISTS (FROM m WHERE m.subject_id = p.subject_id AND p.charttime > m.a AND p.charttime <= m.z) GROUP BY s.stay_id),
        sv AS (SELECT hadm_id, CASE WHEN lower(curr_service) LIKE '%surg%' THEN 1 ELSE 0 END AS surgical FROM v_services QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY transfertime NULLS FIRST, curr_service) = 1),
        c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, intime AS starttime, intime + INTERVAL 24 HOUR AS endtime, age, heartrate_min, heartrate_max, sysbp_min, sysbp_max, tempc_min, tempc_max,
            pao2fio2_vent_min, urineoutput, bun_max, wbc_min, wbc_max, potassium_min, potassium_max, sodium_min, sodium_max, bicarbonate_min, bicarbonate_max, bilirubin_max, mingcs, aids, hem, mets,
            CASE WHEN coalesce(surgical, 0) = 0 OR admission_type IS NULL THEN 'Medical' WHEN admission_type = 'ELECTIVE' THEN 'ScheduledSurgical' ELSE 'UnscheduledSurgical' END AS admissiontype
            FROM v_icustays s JOIN v_admissions a ON a.hadm_id = s.hadm_id LEFT JOIN v_age g ON g.hadm_id = s.hadm_id LEFT JOIN pf ON pf.stay_id = s.stay_id LEFT JOIN sv ON sv.hadm_id = s.hadm_id
            LEFT JOIN (SELECT hadm_id, {flags(D.SAPS_COMORBIDITY)} FROM v_diagnoses_icd GROUP BY hadm_id) f ON f.hadm_id = s.hadm_id
            JOIN {saps_part('v_vitalsign', 'subject_id', mm((('heart_rate', 'heartrate'), ('sbp', 'sysbp'), ('temperature', 'tempc'))))} q1 ON q1.stay_id = s.stay_id
            JOIN {saps_part('v_chemistry', 'subject_id', mm(_pairs(('bun', 'potassium', 'sodium', 'bicarbonate'))))} q2 ON q2.stay_id = s.stay_id
            JOIN {saps_part('v_complete_blood_count', 'subject_id', mm(_pairs(('wbc',))))} q3 ON q3.stay_id = s.stay_id
            JOIN {saps_part('v_enzyme', 'subject_id', 'max(p.bilirubin_total) AS bilirubin_max')} q4 ON q4.stay_id = s.stay_id
            JOIN {saps_part('v_gcs', 'stay_id', 'min(p.gcs) AS mingcs')} q5 ON q5.stay_id = s.stay_id
            JOIN {saps_part('v_urine_output', 'stay_id', 'sum(p.urineoutput) AS urineoutput')} q6 ON q6.stay_id = s.stay_id),
        t AS (SELECT subject_id, hadm_id, stay_id, starttime, endtime, {scores(D.SAPS2)} FROM c), u AS (SELECT *, {total_sql(saps_names)} AS sapsii FROM t)
        SELECT *, 1 / (1 + exp(-(CAST(-7.7631 AS DOUBLE) + CAST(0.0737 AS DOUBLE) * sapsii + CAST(0.9971 AS DOUBLE) * ln(sapsii + 1)))) AS sapsii_prob FROM u"""

    def side(which: str) -> list[str]:
        out = []
        for name, (stem, steps, above) in D.APS_BANDS.items():
            c = f"{stem}_{which}"
            body = RuleScore("x", bands(c, steps, above)).sql()
            if name == "resp_rate":
                body = f"CASE WHEN vent = 1 AND {c} < 14 THEN 0 ELSE {body} END"
            if name == "creatinine":
                body = f"CASE WHEN arf = 1 AND {c} < 1.5 THEN 0 WHEN arf = 1 AND {c} >= 1.5 THEN 10 ELSE {body} END"
            out.append(f"{body} AS {name}_{which}_pts")
        return out
    final = []
    for name, (stem, _, _) in D.APS_BANDS.items():
        hi = f"{name}_max_pts"
        sql = worst_of(f"{stem}_min", f"{stem}_max", D.APS_NORMAL[name], f"{name}_min_pts", hi).sql() if name in D.APS_NORMAL else hi
        final.append(f"{f'CASE WHEN arf = 1 THEN {hi} ELSE {sql} END' if name == 'creatinine' else sql} AS {name}_score")
    gas_in = "v_bg b JOIN v_icustays i ON i.hadm_id = b.hadm_id AND b.charttime >= i.intime AND b.charttime < i.outtime AND b.specimen = 'ART.'"
    vented = f"EXISTS (FROM v_ventilation e WHERE e.stay_id = i.stay_id AND e.{inv} AND b.charttime BETWEEN e.starttime AND e.endtime)"
    v["v_apsiii"] = f"""WITH pa AS (SELECT i.stay_id, max(po2) AS pao2 FROM {gas_in} WHERE NOT {vented} AND coalesce(fio2, fio2_chartevents, 21) < 50 GROUP BY i.stay_id),
        aa AS (SELECT i.stay_id, max(aado2) AS aado2 FROM {gas_in} WHERE {vented} AND coalesce(fio2, fio2_chartevents) >= 50 GROUP BY i.stay_id),
        ac AS (SELECT stay_id, max(acidbase_score) AS acidbase_score FROM (SELECT i.stay_id, {D.APS_ACID.sql()} AS acidbase_score FROM {gas_in} WHERE ph IS NOT NULL AND pco2 IS NOT NULL) GROUP BY stay_id),
        k AS (SELECT hadm_id, {flags({'ckd': D.LATE_KIDNEY_DISEASE})} FROM v_diagnoses_icd GROUP BY hadm_id),
        c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, pao2, aado2, acidbase_score, vent, urineoutput, gcs_motor, gcs_verbal, gcs_eyes, gcs_unable,
            fv.heart_rate_min, fv.heart_rate_max, fv.mbp_min, fv.mbp_max, fv.temperature_min, fv.temperature_max, fv.resp_rate_min, fv.resp_rate_max,
            {', '.join(f'l.{x}_{m}' for x in ('hematocrit', 'wbc', 'creatinine', 'bun', 'sodium', 'albumin') for m in ('min', 'max'))},
            bilirubin_total_min AS bilirubin_min, bilirubin_total_max AS bilirubin_max, greatest(l.glucose_max, fv.glucose_max) AS glucose_max, least(l.glucose_min, fv.glucose_min) AS glucose_min,
            CASE WHEN creatinine_max >= 1.5 AND urineoutput < 410 AND ckd = 0 THEN 1 ELSE 0 END AS arf
            FROM v_icustays s LEFT JOIN pa USING (stay_id) LEFT JOIN aa USING (stay_id) LEFT JOIN ac USING (stay_id) LEFT JOIN v_vent_day vd USING (stay_id)
            LEFT JOIN v_first_day_gcs g USING (stay_id) LEFT JOIN v_first_day_vitalsign fv USING (stay_id) LEFT JOIN v_first_day_urine_output u USING (stay_id)
            LEFT JOIN v_first_day_lab l USING (stay_id) LEFT JOIN k ON k.hadm_id = s.hadm_id),
        p AS (SELECT *, {', '.join(side('min') + side('max'))} FROM c),
        q AS (SELECT subject_id, hadm_id, stay_id, acidbase_score, {', '.join(final)}, {D.APS_URINE.sql()} AS uo_score, {D.APS_GCS.sql()} AS gcs_score, {D.APS_OXYGEN.sql()} AS pao2_aado2_score FROM p),
        r AS (SELECT *, {total_sql(D.APS_PARTS)} AS apsiii FROM q) SELECT *, 1 / (1 + exp(-(CAST(-4.4360 AS DOUBLE) + CAST(0.04726 AS DOUBLE) * apsiii))) AS apsiii_prob FROM r"""
    # --- sepsis ---
    after = "c.at_time IS NOT NULL AND a.antibiotic_time >= c.at_time - INTERVAL 24 HOUR AND a.antibiotic_time < c.at_time"
    before = "c.at_time IS NOT NULL AND a.antibiotic_time > c.at_time AND a.antibiotic_time <= c.at_time + INTERVAL 72 HOUR"
    day_b = "c.at_time IS NULL AND a.ab_day >= c.day AND a.ab_day <= c.day + INTERVAL 3 DAY"
    day_a = "c.at_time IS NULL AND a.ab_day >= c.day - INTERVAL 1 DAY AND a.ab_day <= c.day"
    first = "QUALIFY row_number() OVER (PARTITION BY a.subject_id, a.ab_id ORDER BY c.day NULLS FIRST, c.at_time NULLS LAST, c.micro_specimen_id) = 1"

    def match(time_test: str, day_test: str) -> str:
        return (f"(SELECT a.subject_id, a.ab_id, coalesce(c.at_time, c.day) AS at, c.specimen, c.positive FROM a JOIN c ON c.subject_id = a.subject_id "
                f"AND (({time_test}) OR ({day_test})) {first})")
    v["v_suspicion_of_infection"] = f"""WITH a AS (SELECT subject_id, hadm_id, stay_id, antibiotic, starttime AS antibiotic_time, date_trunc('day', starttime)::TIMESTAMP AS ab_day,
            row_number() OVER (PARTITION BY subject_id ORDER BY starttime NULLS FIRST, stoptime NULLS FIRST, antibiotic NULLS FIRST, stay_id NULLS FIRST) AS ab_id FROM v_antibiotic),
        c AS (SELECT micro_specimen_id, max(subject_id) AS subject_id, date_trunc('day', max(chartdate))::TIMESTAMP AS day, max(charttime) AS at_time, max(spec_type_desc) AS specimen,
            max(CASE WHEN org_name IS NOT NULL AND org_itemid <> {D.NO_GROWTH_ORGANISM} AND org_name <> '' THEN 1 ELSE 0 END) AS positive FROM v_microbiologyevents GROUP BY micro_specimen_id)
        SELECT a.subject_id, a.stay_id, a.hadm_id, a.ab_id, antibiotic, antibiotic_time, CASE WHEN b.specimen IS NULL AND n.specimen IS NULL THEN 0 ELSE 1 END AS suspected_infection,
        CASE WHEN b.specimen IS NOT NULL OR n.specimen IS NOT NULL THEN coalesce(b.at, antibiotic_time) END AS suspected_infection_time, coalesce(b.at, n.at) AS culture_time,
        coalesce(b.specimen, n.specimen) AS specimen, coalesce(b.positive, n.positive) AS positive_culture
        FROM a LEFT JOIN {match(before, day_b)} b ON b.subject_id = a.subject_id AND b.ab_id = a.ab_id LEFT JOIN {match(after, day_a)} n ON n.subject_id = a.subject_id AND n.ab_id = a.ab_id"""
    v["v_sepsis3"] = f"""SELECT i.subject_id, i.stay_id, antibiotic_time, culture_time, suspected_infection_time, f.endtime AS sofa_time, sofa_24hours AS sofa_score,
        {', '.join(f'{c}_24hours AS {c}' for c in D.SOFA_PARTS)}, sofa_24hours >= 2 AND suspected_infection = 1 AS sepsis3 FROM v_suspicion_of_infection i
        JOIN v_sofa f ON f.stay_id = i.stay_id AND f.sofa_24hours >= 2 AND f.endtime BETWEEN suspected_infection_time - INTERVAL 48 HOUR AND suspected_infection_time + INTERVAL 24 HOUR
        QUALIFY row_number() OVER (PARTITION BY i.stay_id ORDER BY suspected_infection_time NULLS FIRST, antibiotic_time NULLS FIRST, culture_time NULLS FIRST, f.endtime NULLS FIRST) = 1"""
    return v
