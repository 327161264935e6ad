"""Queries for unified events, dictionaries, pseudo-items and per-patient views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from .dag import event_source
from .registry import catalog, query, views

COLS = ", ".join(E.EVENT_COLUMNS)


def tables(cat, subject=None):
    """Base tables and the stored views of the event layer."""
    return event_source(cat, subject)


def unified(spark, d, **scope):
    return E.unify_events(tables(catalog(spark, d)), ordered=False, **scope)


def _numeric(table: str, value: str, uom: str, start: str, end: str) -> str:
    return (f"SELECT e.subject_id, e.hadm_id, e.stay_id, e.itemid, label, abbreviation, linksto, category, unitname, param_type, lownormalvalue, highnormalvalue, "
            f"{value} AS value, {uom} AS valueuom, {start} AS starttime, {end} AS endtime FROM v_{table} e JOIN v_d_items d ON d.itemid = e.itemid")


_NONE_T = "CAST(NULL AS TIMESTAMP)"
_NORM = "CAST(NULL AS DOUBLE) AS lownormalvalue, CAST(NULL AS DOUBLE) AS highnormalvalue"
_NEAR = "charttime > a.admittime - INTERVAL 2 DAY AND {0}.charttime < a.dischtime + INTERVAL 2 DAY"


def _kept(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def event_views() -> dict[str, str]:
    dec = "CAST({} AS VARCHAR)".format
    v = {}
    v["v_d_prescriptions"] = "SELECT 1000000 + row_number() OVER (ORDER BY drug) AS itemid, drug FROM (SELECT DISTINCT drug FROM v_prescriptions)"
    flag = "CASE WHEN {0} THEN {1} ELSE {2} END AS valuenum"
    base = "subject_id, hadm_id, CAST(NULL AS BIGINT) AS stay_id, test_itemid AS itemid, 'microbiologyevents' AS linksto, coalesce(charttime, chartdate) AS charttime, spec_type_desc, test_name AS label"
    v["v_microbiology_results"] = f"""SELECT {base}, org_name AS value, {flag.format("org_name LIKE 'NEGATIVE%' OR org_name = 'CANCELLED'", 0, 1)}, microevent_id, '' AS valueuom
        FROM v_microbiologyevents WHERE org_name IS NOT NULL UNION SELECT {base}, comments, {flag.format("comments LIKE 'POSITIVE%'", 1, 0)}, microevent_id, ''
        FROM v_microbiologyevents WHERE org_name IS NULL AND (upper(comments) LIKE 'POSITIVE%' OR upper(comments) LIKE 'NEGATIVE%')"""
    v["v_mortality"] = """SELECT s.subject_id, s.hadm_id, s.stay_id, coalesce(dod <= outtime + INTERVAL 24 HOUR, false) AS icu_death, coalesce(dod <= dischtime + INTERVAL 24 HOUR, false) AS hospital_death,
        coalesce(dod <= intime + INTERVAL 30 DAY, false) AS death_30d, coalesce(dod <= intime + INTERVAL 1 YEAR, false) AS death_1y,
        CAST(ceil((epoch_us(outtime) - epoch_us(intime)) / CAST(3600000000 AS DOUBLE)) AS BIGINT) AS icu_hours,
        CAST(ceil((epoch_us(dischtime) - epoch_us(admittime)) / CAST(3600000000 AS DOUBLE)) AS BIGINT) AS hospital_hours
        FROM v_icustays s JOIN v_admissions a ON a.subject_id = s.subject_id AND a.hadm_id = s.hadm_id JOIN v_patients p ON p.subject_id = s.subject_id"""
    keys = "s.subject_id, s.hadm_id, s.stay_id"

    def item(i, label, value, num, uom, time, src):
        return f"SELECT {keys}, CAST({i} AS BIGINT) AS itemid, '{label}' AS label, {value} AS value, CAST({num} AS DOUBLE) AS valuenum, '{uom}' AS valueuom, {time} AS charttime FROM {src}"
    stays = "v_icustays s"
    kg = "coalesce(weight_admit, weight)"
    bmi = f"{kg} / ((height / 100) * (height / 100))"
    four = "CAST(CAST({} AS DECIMAL(18, 4)) AS VARCHAR)".format
    mort = f"{stays} JOIN v_mortality m ON m.stay_id = s.stay_id"
    yes = "CASE WHEN {} THEN 'Yes' ELSE 'No' END".format
    rows = [
        item(1, "age", dec("CAST(ceil(age) AS BIGINT)"), "ceil(age)", "y.o.", "intime", f"{stays} JOIN v_age g ON g.hadm_id = s.hadm_id"),
        item(2, "gender", "gender", "NULL", "", "intime", f"{stays} JOIN v_patients p ON p.subject_id = s.subject_id"),
        item(3, "height", "CAST(CAST(height AS DECIMAL(18, 2)) AS VARCHAR)", "height", "cm", "intime", f"{stays} JOIN v_height h ON h.stay_id = s.stay_id AND h.subject_id = s.subject_id"),
        item(4, "weight", four(kg), f"round({kg}, 6)", "kg", "intime", f"{stays} JOIN v_first_day_weight w ON w.stay_id = s.stay_id"),
        item(5, "BMI", four(bmi), f"round({bmi}, 6)", "kg/m2", "intime", f"{stays} JOIN v_first_day_weight w ON w.stay_id = s.stay_id JOIN v_height h ON h.stay_id = s.stay_id AND h.subject_id = s.subject_id"),
        item(6, "Charlson Score at hospital admission", dec("charlson_comorbidity_index"), "charlson_comorbidity_index", "", "intime", f"{stays} JOIN v_charlson c ON c.hadm_id = s.hadm_id"),
        item(7, "Simplified Acute Physiology Score (SAPSII)", dec("sapsii"), "sapsii", "", "x.starttime", f"{stays} JOIN v_sapsii x ON x.stay_id = s.stay_id"),
        item(8, "Sequential Organ Failure Assessment score (SOFA)", dec("sofa_24hours"), "sofa_24hours", "", "f.starttime", f"{stays} JOIN v_sofa f ON f.stay_id = s.stay_id AND f.hr = 0"),
        item(9, "Length of ICU Stay (LIS)", dec("icu_hours"), "icu_hours", "hr", "intime", mort), item(10, "Length of Hospital Stay (LHS)", dec("hospital_hours"), "hospital_hours", "hr", "intime", mort)]
    for i, (label, c) in enumerate((("Death in ICU", "icu_death"), ("Death in Hospital", "hospital_death"), ("30-day after ICU admission death", "death_30d"),
                                    ("1-year after ICU admission death", "death_1y")), 11):
        rows.append(item(i, label, yes(c), "NULL", "", "outtime", mort))
    v["v_demographics"] = " UNION ".join(rows)
    numeric = [_numeric("procedureevents", _kept("value"), "valueuom", "starttime", "endtime"), _numeric("ingredientevents", _kept("amount"), "amountuom", "starttime", "endtime"),
               _numeric("inputevents", _kept("amount"), "amountuom", "starttime", "endtime"), _numeric("outputevents", _kept("value"), "valueuom", "charttime", _NONE_T),
               _numeric("datetimeevents", "CAST(NULL AS VARCHAR)", "valueuom", "charttime", _NONE_T), _numeric("chartevents", _kept("valuenum"), "valueuom", "charttime", _NONE_T),
               f"""SELECT a.subject_id, a.hadm_id, NULL, l.itemid, label, NULL, 'labevents', category, NULL, fluid, {_NORM}, {_kept('valuenum')}, valueuom, l.charttime, {_NONE_T}
               FROM v_labevents l JOIN v_admissions a ON a.subject_id = l.subject_id AND l.{_NEAR.format('l')} JOIN v_d_labitems d ON d.itemid = l.itemid"""]
    text = [f"""SELECT a.subject_id, a.hadm_id, CAST(NULL AS BIGINT) AS stay_id, test_itemid AS itemid, test_name AS label, NULL AS abbreviation, 'microbiologyevents' AS linksto, 'Microbiology' AS category,
            NULL AS unitname, NULL AS param_type, {_NORM}, org_name AS value, {_kept('microevent_id')} AS valueuom, m.charttime AS starttime, {_NONE_T} AS endtime
            FROM v_microbiologyevents m JOIN v_admissions a ON a.subject_id = m.subject_id AND m.{_NEAR.format('m')}""",
            f"SELECT subject_id, hadm_id, stay_id, c.itemid, label, abbreviation, 'customevents', 'User imported', NULL, abbreviation, {_NORM}, value, valueuom, charttime, {_NONE_T} FROM v_customevents c JOIN v_d_customevents d ON d.itemid = c.itemid",
            f"""SELECT subject_id, hadm_id, NULL, itemid, p.drug, NULL, 'prescriptions', 'Prescriptions', dose_unit_rx, drug_type, {_NORM}, dose_val_rx, dose_unit_rx, starttime, stoptime
            FROM v_prescriptions p JOIN v_d_prescriptions d ON d.drug = p.drug""",
            f"SELECT subject_id, hadm_id, stay_id, itemid, label, '', 'demographics', 'Demographics', NULL, valueuom, {_NORM}, value, valueuom, charttime, {_NONE_T} FROM v_demographics"]
    v["v_unified"] = f"SELECT * FROM ({' UNION ALL '.join(numeric)}) UNION ALL SELECT * FROM ({' UNION '.join(text)})"
    return v


views().update(event_views())


@query("unify_events", f"SELECT {COLS} FROM v_unified")
def unify(spark, d):
    return E.unify_events(tables(catalog(spark, d)))


@query("unify_events_one_admission", f"SELECT {COLS} FROM v_unified WHERE subject_id = 2 AND hadm_id = 5 AND (stay_id = 10 OR stay_id IS NULL)")
def unify_one(spark, d):
    return E.unify_events(tables(catalog(spark, d), subject=2), subject=2, hadm=5, stay=10)


@query("lab_attachment_by_time", f"""SELECT a.hadm_id, l.labevent_id FROM v_labevents l JOIN v_admissions a ON a.subject_id = l.subject_id AND l.{_NEAR.format('l')}
    UNION ALL SELECT a.hadm_id, m.microevent_id FROM v_microbiologyevents m JOIN v_admissions a ON a.subject_id = m.subject_id AND m.{_NEAR.format('m')}""")
def attachment(spark, d):
    cat = catalog(spark, d)
    adm = cat.table("admissions")
    a = E.around_admission(cat.table("labevents").select("subject_id", "hadm_id", "labevent_id", "charttime"), adm).select("hadm_id", "labevent_id")
    m = E.around_admission(cat.table("microbiologyevents").select("subject_id", "hadm_id", F.col("microevent_id").alias("labevent_id"), "charttime"), adm).select("hadm_id", "labevent_id")
    return a.unionByName(m)


@query("d_prescriptions", "SELECT itemid, drug FROM v_d_prescriptions")
def drugs(spark, d):
    return E.d_prescriptions(catalog(spark, d).table("prescriptions"))


@query("d_prescriptions_parts", "SELECT 1000000 + row_number() OVER (ORDER BY p_name) AS itemid, p_name AS drug FROM (SELECT DISTINCT p_name FROM part)")
def drugs_parts(spark, d):
    from .registry import read
    return E.d_prescriptions(read(spark, d, "part").select(F.col("p_name").alias("drug")))


@query("microbiology_results", "SELECT * FROM v_microbiology_results")
def results(spark, d):
    return E.microbiology_results(catalog(spark, d).table("microbiologyevents"))


@query("positive_microbiology", """SELECT DISTINCT subject_id, hadm_id, charttime, itemid, label, value, infection_type FROM v_microbiology_results JOIN v_infection_type USING (label, value) WHERE valuenum = 1""")
def positive(spark, d):
    cat = catalog(spark, d)
    return E.positive_microbiology(E.microbiology_results(cat.table("microbiologyevents")), cat.table("infection_type"))


@query("demographics", "SELECT * FROM v_demographics")
def demo(spark, d):
    return catalog(spark, d).concept("demographics")


@query("uid_list", """SELECT DISTINCT * FROM (SELECT 'subject_id' AS type, subject_id AS uid FROM v_patients UNION ALL SELECT 'hadm_id', hadm_id FROM v_admissions UNION ALL SELECT 'stay_id', stay_id FROM v_icustays)""")
def uids(spark, d):
    cat = catalog(spark, d)
    return E.uid_list(cat.table("patients"), cat.table("admissions"), cat.table("icustays"))


@query("cohort_ids", """SELECT DISTINCT type, uid FROM (SELECT subject_id, hadm_id, stay_id FROM v_icustays WHERE los > 3.65) UNPIVOT (uid FOR type IN (subject_id, hadm_id, stay_id))""")
def ids(spark, d):
    return E.cohort_ids(catalog(spark, d).table("icustays").filter(F.col("los") > 3.65))


@query("resolve_uid", """SELECT 'subject_id' AS type, subject_id, CAST(NULL AS BIGINT) AS hadm_id, CAST(NULL AS BIGINT) AS stay_id FROM v_patients WHERE subject_id = 3
    UNION ALL SELECT 'hadm_id', subject_id, hadm_id, NULL FROM v_admissions WHERE hadm_id = 3 UNION ALL SELECT 'stay_id', subject_id, hadm_id, stay_id FROM v_icustays WHERE stay_id = 3""")
def resolve(spark, d):
    cat = catalog(spark, d)
    return E.resolve_uid(cat.table("admissions"), cat.table("icustays"), cat.table("patients"), 3)


_LINKS = ", ".join(f"'{t}'" for t in E.ITEM_TABLES)


@query("distinct_events", f"""SELECT DISTINCT itemid, label, category, linksto, param_type FROM v_d_items WHERE linksto IN ({_LINKS})
    UNION ALL SELECT DISTINCT itemid, label, category, 'labevents', fluid FROM v_d_labitems UNION ALL SELECT DISTINCT itemid, label, 'Microbiology', 'microbiologyresultsevents', NULL FROM v_microbiology_results
    UNION ALL SELECT itemid, drug, 'Prescriptions', 'prescriptions', NULL FROM v_d_prescriptions UNION ALL SELECT DISTINCT itemid, label, 'Demographics', 'demographics', valueuom FROM v_demographics
    UNION ALL SELECT itemid, label, 'User imported', 'customevents', author FROM v_d_customevents""")
def distinct(spark, d):
    cat = catalog(spark, d)
    t = tables(cat)
    return E.distinct_events(cat.table("d_items"), cat.table("d_labitems"), t("microbiologyresultsevents"), t("d_prescriptions"),
                             t("demographics") if cat.built("demographics") else E.demographic_items(cat.table, cat.concept), cat.table("d_customevents"))


@query("event_detail_chart", "SELECT c.subject_id, c.stay_id, c.itemid, c.charttime, c.valuenum, label FROM v_chartevents c JOIN v_d_items d ON d.itemid = c.itemid WHERE c.itemid = 220045 AND c.valuenum > 150")
def detail_chart(spark, d):
    cat = catalog(spark, d)
    ce = cat.table("chartevents").filter((F.col("itemid") == 220045) & (F.col("valuenum") > 150))
    records = ce.select("subject_id", "hadm_id", "stay_id", "itemid", F.lit("chartevents").alias("linksto"), F.col("valuenum").cast("string").alias("value"), "valueuom",
                        F.col("charttime").alias("starttime"), F.lit(None).cast("timestamp_ntz").alias("endtime"), F.lit("").alias("label"))
    return E.event_detail(tables(cat), records, "chartevents").select("subject_id", "stay_id", "itemid", "charttime", "valuenum", "label")


@query("event_detail_prescription", "SELECT DISTINCT subject_id, hadm_id, drug, starttime, stoptime, route FROM v_prescriptions WHERE dose_val_rx = '42'")
def detail_rx(spark, d):
    cat = catalog(spark, d)
    rx = cat.table("prescriptions").filter(F.col("dose_val_rx") == "42")
    records = rx.select("subject_id", "hadm_id", F.lit(None).cast("long").alias("stay_id"), F.lit(0).alias("itemid"), F.lit("prescriptions").alias("linksto"), F.col("dose_val_rx").alias("value"),
                        F.col("dose_unit_rx").alias("valueuom"), "starttime", F.col("stoptime").alias("endtime"), F.col("drug").alias("label"))
    return E.event_detail(tables(cat), records, "prescriptions").select("subject_id", "hadm_id", "drug", "starttime", "stoptime", "route").distinct()


_TITLE = "category || coalesce(' ' || param_type, '') || ' ' || label || ' ' || CAST(itemid AS VARCHAR)"
_LINES = f"""SELECT subject_id, hadm_id, itemid, title, part, string_agg(value, ' ' ORDER BY starttime) AS "values" FROM (
    SELECT *, (row_number() OVER (PARTITION BY subject_id, hadm_id, itemid, title ORDER BY starttime) - 1) // 1000 AS part FROM (
    SELECT subject_id, hadm_id, itemid, {_TITLE} AS title, starttime, min(value) AS value FROM v_unified WHERE category <> 'User imported' GROUP BY ALL) WHERE value IS NOT NULL) GROUP BY ALL"""


@query("patient_text_lines", _LINES)
def text_lines(spark, d):
    return E.patient_text_lines(unified(spark, d))


_AGE = "anchor_age + year(admittime) - anchor_year"
_OVERVIEW = f"""SELECT p.subject_id, a.hadm_id, s.stay_id, gender, admission_type, {_AGE} AS age, (epoch_us(dischtime) - epoch_us(admittime)) / CAST(86400000000 AS DOUBLE) AS hadm_days,
    (epoch_us(outtime) - epoch_us(intime)) / CAST(86400000000 AS DOUBLE) AS stay_days, dod <= dischtime AS in_hospital_death,
    (epoch_us(dod::TIMESTAMP) - epoch_us(dischtime)) / CAST(86400000000 AS DOUBLE) AS days_to_death, charlson_comorbidity_index, sofa, gcs_min
    FROM v_patients p JOIN v_admissions a ON a.subject_id = p.subject_id LEFT JOIN v_icustays s ON s.subject_id = p.subject_id AND s.hadm_id = a.hadm_id
    LEFT JOIN v_charlson c ON c.hadm_id = a.hadm_id LEFT JOIN v_first_day_sofa f ON f.stay_id = s.stay_id LEFT JOIN v_first_day_gcs g ON g.stay_id = s.stay_id"""


@query("patient_overview", _OVERVIEW, {"hadm_days": 6, "stay_days": 6, "days_to_death": 6})
def overview(spark, d):
    cat = catalog(spark, d)
    return E.patient_overview(cat.table, cat.concept)


_HEADER = f"""SELECT subject_id, hadm_id, stay_id, 'Gender : ' || gender || chr(10) || 'Age : ' || age || chr(10) || 'Charlson Comorbidity Index : ' || charlson_comorbidity_index || chr(10)
    || 'SOFA : ' || sofa || chr(10) || 'Glasgow Score Minimum : ' || coalesce(CAST(gcs_min AS VARCHAR), 'NA') AS header FROM ({_OVERVIEW})"""
_DX_LINES = "SELECT subject_id, hadm_id, seq_num, icd_code || ' v' || icd_version || ' ' || long_title AS line FROM v_diagnoses_icd JOIN v_d_icd_diagnoses USING (icd_code, icd_version)"


@query("patient_text_header", _HEADER)
def text_header(spark, d):
    cat = catalog(spark, d)
    return E.patient_text_header(E.patient_overview(cat.table, cat.concept))


@query("patient_text", f"""SELECT subject_id, hadm_id, 0 AS section, coalesce(stay_id, 0) AS position, '' AS title, 0 AS part, header AS text FROM ({_HEADER})
    UNION ALL SELECT subject_id, hadm_id, 1, seq_num, line, 0, line FROM ({_DX_LINES})
    UNION ALL SELECT subject_id, hadm_id, 2, itemid, title, part, title || ' : ' || "values" FROM ({_LINES})""")
def text_whole(spark, d):
    cat = catalog(spark, d)
    return E.patient_text(E.patient_overview(cat.table, cat.concept), E.diagnosis_lines(cat.table("diagnoses_icd"), cat.table("d_icd_diagnoses")),
                          E.patient_text_lines(unified(spark, d)))


@query("diagnosis_lines", _DX_LINES)
def dx_lines(spark, d):
    cat = catalog(spark, d)
    return E.diagnosis_lines(cat.table("diagnoses_icd"), cat.table("d_icd_diagnoses"))


@query("patient_transfers", "SELECT * FROM v_transfers WHERE subject_id = 4")
def transfers(spark, d):
    return E.patient_transfers(catalog(spark, d).table("transfers"), subject=4)


@query("patient_transfers_triage", """SELECT t.*, temperature, heartrate, resprate, o2sat, sbp, dbp, pain, acuity, chiefcomplaint FROM v_transfers t LEFT JOIN v_triage g ON g.stay_id = t.transfer_id""")
def transfers_triage(spark, d):
    cat = catalog(spark, d)
    return E.patient_transfers(cat.table("transfers"), triage=cat.table("triage"))


@query("discharge_notes", f"""SELECT a.subject_id, a.hadm_id, coalesce(note, 0) AS note, note_id, charttime, storetime, CASE WHEN note IS NULL THEN '{E.NO_NOTE}' ELSE
    'Note ID : ' || note_id || ' | Chart time : ' || strftime(charttime, '%Y-%m-%d %H:%M:%S') || ' | Store time : ' || strftime(storetime, '%Y-%m-%d %H:%M:%S') END AS facts, text
    FROM v_admissions a LEFT JOIN (SELECT hadm_id, note_id, charttime, storetime, text, row_number() OVER (PARTITION BY hadm_id ORDER BY charttime, note_id) AS note FROM v_discharge) n ON n.hadm_id = a.hadm_id""")
def discharge(spark, d):
    cat = catalog(spark, d)
    return E.discharge_notes(cat.table("admissions"), cat.table("discharge"))


@query("patient_overview_notes", f"""SELECT o.*, coalesce(notes, 0) AS notes, last_note, note_characters FROM ({_OVERVIEW}) o
    LEFT JOIN (SELECT hadm_id, count(*) AS notes, max(charttime) AS last_note, CAST(sum(length(text)) AS BIGINT) AS note_characters FROM v_discharge GROUP BY hadm_id) n ON n.hadm_id = o.hadm_id""",
       {"hadm_days": 6, "stay_days": 6, "days_to_death": 6})
def overview_notes(spark, d):
    cat = catalog(spark, d)
    return E.overview_notes(E.patient_overview(cat.table, cat.concept), cat.table("discharge"))


@query("patient_index", """SELECT p.subject_id, gender, (SELECT count(*) FROM v_admissions a WHERE a.subject_id = p.subject_id) AS total_hadm,
    (SELECT count(*) FROM v_icustays s WHERE s.subject_id = p.subject_id) AS total_stay,
    anchor_age + (SELECT min(year(admittime)) FROM v_admissions a WHERE a.subject_id = p.subject_id) - anchor_year AS age FROM v_patients p""")
def index(spark, d):
    cat = catalog(spark, d)
    return E.patient_index(cat.table("patients"), cat.table("admissions"), cat.table("icustays"))


@query("admission_index", """SELECT a.subject_id, a.hadm_id, admission_type, count(stay_id) AS total_stay FROM v_admissions a LEFT JOIN v_icustays s ON s.hadm_id = a.hadm_id GROUP BY ALL""")
def adm_index(spark, d):
    cat = catalog(spark, d)
    return E.admission_index(cat.table("admissions"), cat.table("icustays"))


@query("patient_chart_bundle", """SELECT 'chartevents' AS source, c.subject_id, count(*) AS n, count(DISTINCT label) AS labels FROM v_chartevents c JOIN v_d_items d ON d.itemid = c.itemid GROUP BY ALL
    UNION ALL SELECT 'labevents', l.subject_id, count(*), count(DISTINCT label) FROM v_labevents l JOIN v_d_labitems d ON d.itemid = l.itemid GROUP BY ALL
    UNION ALL SELECT 'diagnoses_icd', x.subject_id, count(*), count(DISTINCT long_title) FROM v_diagnoses_icd x LEFT JOIN v_d_icd_diagnoses d USING (icd_code, icd_version) GROUP BY ALL
    UNION ALL SELECT 'procedures_icd', x.subject_id, count(*), count(DISTINCT long_title) FROM v_diagnoses_icd x LEFT JOIN v_d_icd_diagnoses d USING (icd_code, icd_version) GROUP BY ALL
    """ + " ".join(f"UNION ALL SELECT '{t}', e.subject_id, count(*), count(DISTINCT label) FROM v_{t} e JOIN v_d_items d ON d.itemid = e.itemid GROUP BY ALL" for t in ("inputevents", "outputevents", "procedureevents"))
    + " ".join(f" UNION ALL SELECT '{t}', subject_id, count(*), 0 FROM v_{t} GROUP BY ALL" for t in ("admissions", "icustays", "prescriptions", "microbiologyevents")))
def bundle(spark, d):
    from functools import reduce

    from pyspark.sql import DataFrame
    cat = catalog(spark, d)
    # the fixture has no procedure codes: the diagnosis codes stand in for them
    parts = E.patient_chart_bundle(lambda name: cat.table({"procedures_icd": "diagnoses_icd", "d_icd_procedures": "d_icd_diagnoses"}.get(name, name)))
    title = lambda df: next((F.col(c) for c in ("long_title", "label") if c in df.columns), F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, [
        df.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(title(df)).alias("labels"))
        .select(F.lit(name).alias("source"), "subject_id", "n", "labels") for name, df in parts.items()])


def _labelled_labs(cat):
    return cat.table("labevents").join(cat.table("d_labitems"), "itemid")


_FREQ = """SELECT hadm_id, l.itemid, label, valueuom, category, count(*) AS n FROM v_labevents l JOIN v_d_labitems d ON d.itemid = l.itemid WHERE valuenum IS NOT NULL GROUP BY ALL"""


@query("item_frequency", f"SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY n DESC, itemid, valueuom) AS rank FROM ({_FREQ}) WHERE n > 10 QUALIFY rank <= 10")
def frequency(spark, d):
    return E.item_frequency(_labelled_labs(catalog(spark, d)))


@query("item_frequency_all", f"SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY n DESC, itemid, valueuom) AS rank FROM ({_FREQ}) WHERE n > 4")
def frequency_all(spark, d):
    return E.item_frequency(_labelled_labs(catalog(spark, d)), min_n=4, top=None)


@query("rare_item_rows", """SELECT l.hadm_id, l.charttime, l.itemid, label, l.valuenum, l.valueuom, category FROM (SELECT *, min(n) OVER (PARTITION BY hadm_id, itemid) AS least FROM (
    SELECT x.*, label, category, count(*) OVER (PARTITION BY x.hadm_id, x.itemid, label, x.valueuom, category) AS n FROM v_labevents x JOIN v_d_labitems d ON d.itemid = x.itemid WHERE x.valuenum IS NOT NULL)) l
    WHERE least <= 4 AND hadm_id IS NOT NULL""")
def rare(spark, d):
    return E.rare_item_rows(_labelled_labs(catalog(spark, d)))


@query("timeline_items", """WITH c AS (SELECT e.subject_id, e.hadm_id, e.starttime AS "start", e.endtime AS "end", label AS content, category AS "group" FROM v_inputevents e JOIN v_d_items USING (itemid)),
    n AS (SELECT *, count(*) OVER (PARTITION BY subject_id, hadm_id, "start", "group") AS k, row_number() OVER (PARTITION BY subject_id, hadm_id, "start", "group" ORDER BY content, "end") AS r FROM c)
    SELECT subject_id, hadm_id, "start", "end", CASE WHEN k > 1 AND "group" = 'Labs' THEN "group" ELSE content END AS content, "group", 'range' AS type FROM n WHERE "group" <> 'Labs' OR r = 1
    UNION ALL SELECT subject_id, hadm_id, admittime, dischtime, 'Hospital Stay', 'Hospital Stay', 'background' FROM v_admissions
    UNION ALL SELECT subject_id, hadm_id, intime, outtime, 'ICU Stay', 'ICU Stay', 'background' FROM v_icustays""")
def timeline(spark, d):
    cat = catalog(spark, d)
    ev = cat.table("inputevents").join(cat.table("d_items").select("itemid", "label", "category"), "itemid")
    return E.timeline_items(ev, ["Labs"], adm=cat.table("admissions"), stays=cat.table("icustays"))
