"""Unified event records, dictionaries, pseudo-items and per-patient views."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY, age_by_year, span_days
from ..sources.schemas import EVENTS
from .joins import anchored, star_join
from .windows import row_numbers

Tables = Callable[[str], DataFrame]
EVENT_COLUMNS = ("subject_id", "hadm_id", "stay_id", "itemid", "label", "abbreviation", "linksto", "category", "unitname", "param_type",
                 "lownormalvalue", "highnormalvalue", "value", "valueuom", "starttime", "endtime")
FIRST_DRUG_ITEM = 1_000_000
_TYPES = {"subject_id": "long", "hadm_id": "long", "stay_id": "long", "itemid": "long", "lownormalvalue": "double", "highnormalvalue": "double",
          "starttime": "timestamp_ntz", "endtime": "timestamp_ntz"}


def _record(df: DataFrame, **cols: str | Column | None) -> DataFrame:
    """The 16 event columns; names not given are NULL, strings name columns."""
    out = []
    for name in EVENT_COLUMNS:
        c = cols.get(name)
        c = F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
        out.append(c.cast(_TYPES.get(name, "string")).alias(name))
    return df.select(*out)


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_ITEM = _same("itemid", "label", "abbreviation", "linksto", "category", "unitname", "param_type", "lownormalvalue", "highnormalvalue")
_KEYS = _same("subject_id", "hadm_id", "stay_id")


def scope(df: DataFrame, subject: int | None = None, hadm: int | None = None, stay: int | None = None, open_stay: bool = False) -> DataFrame:
    """Limit to ids; the filters reach the scan. `open_stay` keeps rows without a stay."""
    if subject is not None:
        df = df.filter(F.col("subject_id") == subject)
    if hadm is not None:
        df = df.filter(F.col("hadm_id") == hadm)
    if stay is not None and "stay_id" in df.columns:
        test = F.col("stay_id") == stay
        df = df.filter(test | F.col("stay_id").isNull() if open_stay else test)
    return df


def around_admission(points: DataFrame, adm: DataFrame) -> DataFrame:
    """A patient's rows from two days before to two days after each admission, with the admission's hadm_id."""
    two = F.make_dt_interval(F.lit(2))
    return anchored(points.drop("hadm_id"), adm.select("subject_id", "hadm_id", "admittime", "dischtime"), ["subject_id"], "charttime", "admittime",
                    F.col("admittime") - two, F.col("dischtime") + two, "()", stay_cols=["hadm_id"])


def unify_events(t: Tables, subject: int | None = None, hadm: int | None = None, stay: int | None = None, ordered: bool = False) -> DataFrame:
    """Ten event tables and the pseudo-items as one list of 16-column records.

    Numbers become text. Laboratory and culture rows belong to an admission by time, whatever admission they
    name. The text sources are free of duplicates. The six ICU tables are united before they meet their dictionary, once.
    `ordered` sorts all rows by start time.
    """
    def charted(table: str, value: str, uom: str, start: str, end: str | None) -> DataFrame:
        nothing = F.lit(None)
        return scope(t(table), subject, hadm, stay).select(
            *_KEYS, "itemid", (F.col(value) if value else nothing).cast("string").alias("value"), F.col(uom).alias("valueuom"), F.col(start).cast("timestamp_ntz").alias("starttime"),
            (F.col(end) if end else nothing).cast("timestamp_ntz").alias("endtime"))
    icu = reduce(DataFrame.unionByName, [
        charted("procedureevents", "value", "valueuom", "starttime", "endtime"), charted("ingredientevents", "amount", "amountuom", "starttime", "endtime"),
        charted("inputevents", "amount", "amountuom", "starttime", "endtime"), charted("outputevents", "value", "valueuom", "charttime", None),
        charted("datetimeevents", "", "valueuom", "charttime", None), charted("chartevents", "valuenum", "valueuom", "charttime", None)])
    adm = scope(t("admissions"), subject, hadm)
    labs = around_admission(scope(t("labevents"), subject), adm).join(t("d_labitems"), "itemid")
    numeric = [
        _record(icu.join(t("d_items"), "itemid"), **_KEYS, **_ITEM, **_same("value", "valueuom", "starttime", "endtime")),
        _record(labs, **_same("subject_id", "hadm_id", "itemid", "label", "category", "valueuom"), linksto=F.lit("labevents"), param_type="fluid",
                value="valuenum", starttime="charttime")]
    micro = around_admission(scope(t("microbiologyevents"), subject).filter(F.col("charttime").isNotNull()), adm)
    rx = scope(t("prescriptions"), subject, hadm).join(t("d_prescriptions"), "drug")
    custom = scope(t("customevents"), subject, hadm, stay, open_stay=True).join(t("d_customevents"), "itemid")
    demo = scope(t("demographics"), subject, hadm, stay, open_stay=True)
    text = [
        _record(micro, **_same("subject_id", "hadm_id"), itemid="test_itemid", label="test_name", linksto=F.lit("microbiologyevents"),
                category=F.lit("Microbiology"), value="org_name", valueuom="microevent_id", starttime="charttime"),
        _record(custom, **_KEYS, **_same("itemid", "label", "abbreviation", "value", "valueuom"), linksto=F.lit("customevents"),
                category=F.lit("User imported"), param_type="abbreviation", starttime="charttime"),
        _record(rx, **_same("subject_id", "hadm_id", "itemid", "starttime"), label="drug", linksto=F.lit("prescriptions"), category=F.lit("Prescriptions"),
                unitname="dose_unit_rx", param_type="drug_type", value="dose_val_rx", valueuom="dose_unit_rx", endtime="stoptime"),
        _record(demo, **_KEYS, **_same("itemid", "label", "value", "valueuom"), abbreviation=F.lit(""), linksto=F.lit("demographics"),
                category=F.lit("Demographics"), param_type="valueuom", starttime="charttime")]
    out = reduce(DataFrame.unionByName, numeric).unionByName(reduce(DataFrame.unionByName, text).distinct())
    return out.orderBy(F.col("starttime").asc_nulls_last()) if ordered else out


# --- dictionaries -----------------------------------------------------------------------------------
def number_texts(texts: DataFrame, col: str, out: str, first: int = 1, cuts: int = 256) -> DataFrame:
    """Consecutive numbers for distinct texts in binary order; NULL has none.

    The `cuts` texts with the smallest hashes, a chance sample that is the same in every run, cut the order into ranges.
    Numbers are given per range and shifted by the sizes of the ranges before, so the texts are never sorted in one task,
    whatever prefixes they share.
    """
    d = texts.select(col).filter(F.col(col).isNotNull()).distinct()
    limits = d.orderBy(F.xxhash64(col), col).limit(cuts).agg(F.collect_list(col).alias("__limits")).withColumn("__one", F.lit(1))  # one row
    d = d.withColumn("__one", F.lit(1)).join(F.broadcast(limits), "__one")
    d = d.select(col, F.size(F.filter("__limits", lambda x: x < F.col(col))).alias("__p"))
    sizes = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__p").orderBy(col))
    return d.withColumn("__local", local).join(sizes, "__p").select((F.col("__local") + F.col("__offset") + F.lit(first - 1)).cast("long").alias(out), col)


def d_prescriptions(rx: DataFrame) -> DataFrame:
    """Every drug name with a synthetic item id, numbered in binary order of the name."""
    return number_texts(rx.select("drug"), "drug", "itemid", FIRST_DRUG_ITEM + 1)


def microbiology_results(me: DataFrame) -> DataFrame:
    """Organism rows, and comment rows that start with positive or negative, as one kind of result."""
    base = [F.col("subject_id"), F.col("hadm_id"), F.lit(None).cast("long").alias("stay_id"), F.col("test_itemid").alias("itemid"),
            F.lit("microbiologyevents").alias("linksto"), F.coalesce("charttime", "chartdate").alias("charttime"), F.col("spec_type_desc"),
            F.col("test_name").alias("label")]
    tail = [F.col("microevent_id"), F.lit("").alias("valueuom")]
    org, note = F.col("org_name"), F.col("comments")
    organisms = me.filter(org.isNotNull()).select(
        *base, org.alias("value"), F.when(org.startswith("NEGATIVE") | (org == "CANCELLED"), 0).otherwise(1).alias("valuenum"), *tail)
    said = F.upper(note).startswith("POSITIVE") | F.upper(note).startswith("NEGATIVE")
    notes = me.filter(org.isNull() & said).select(
        *base, note.alias("value"), F.when(note.startswith("POSITIVE"), 1).otherwise(0).alias("valuenum"), *tail)
    return organisms.union(notes).distinct()


def positive_microbiology(results: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct positive results with their kind of infection."""
    d = results.filter(F.col("valuenum") == 1).join(types.select("label", "value", "infection_type"), ["label", "value"])
    return d.select("subject_id", "hadm_id", "charttime", "itemid", "label", "value", "infection_type").distinct()


def _decimal_text(c: Column | str, digits: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{digits})").cast("string")


def demographics(t: Tables, concept: Tables) -> DataFrame:
    """Fourteen pseudo-items per stay: text value, unit, and the typed number where there is one."""
    from .cohort import mortality_flags
    stays = t("icustays").select("subject_id", "hadm_id", "stay_id", "intime", "outtime")
    adm, pat = t("admissions"), t("patients")
    base = star_join(stays, [concept("age").select("hadm_id", "age"), concept("charlson").select("hadm_id", "charlson_comorbidity_index")], "hadm_id")
    flags = mortality_flags(stays, adm, pat).drop("subject_id", "hadm_id")
    base = base.join(pat.select("subject_id", "gender"), "subject_id").join(flags, "stay_id")
    none = F.lit(None).cast("double")

    def item(i: int, label: str, value: Column, num: Column, uom: str, time: str = "intime") -> Column:
        return F.struct(F.lit(i).cast("long").alias("itemid"), F.lit(label).alias("label"), value.cast("string").alias("value"), num.cast("double").alias("valuenum"),
                        F.lit(uom).alias("valueuom"), F.col(time).alias("charttime"))

    def whole(c: str | Column) -> Column:
        return F.ceil(c).cast("long")

    def yes(c: str) -> Column:
        return F.when(F.col(c), "Yes").otherwise("No")
    age, lis, lhs = whole("age"), F.col("icu_hours"), F.col("hospital_hours")
    index = F.col("charlson_comorbidity_index")
    listed = F.array(
        item(1, "age", age, age, "y.o."), item(2, "gender", F.col("gender"), none, ""), item(6, "Charlson Score at hospital admission", index, index, ""),
        item(9, "Length of ICU Stay (LIS)", lis, lis, "hr"), item(10, "Length of Hospital Stay (LHS)", lhs, lhs, "hr"),
        item(11, "Death in ICU", yes("icu_death"), none, "", "outtime"), item(12, "Death in Hospital", yes("hospital_death"), none, "", "outtime"),
        item(13, "30-day after ICU admission death", yes("death_30d"), none, "", "outtime"),
        item(14, "1-year after ICU admission death", yes("death_1y"), none, "", "outtime"))
    keys = ["subject_id", "hadm_id", "stay_id"]
    out = ["itemid", "label", "value", "valuenum", "valueuom", "charttime"]
    parts = [base.select(*keys, F.explode(listed).alias("x")).select(*keys, "x.*")]
    h = concept("height").filter(F.col("subject_id").isNotNull()).select("subject_id", "stay_id", "height")
    w = concept("first_day_weight").select("subject_id", "stay_id", F.coalesce("weight_admit", "weight").alias("kg"))
    placed = stays.select(*keys, "intime")
    height = h.join(placed, ["subject_id", "stay_id"]).select(*keys, item(3, "height", _decimal_text("height", 2), F.col("height"), "cm").alias("x"))
    weight = w.join(placed, ["subject_id", "stay_id"]).select(*keys, item(4, "weight", _decimal_text("kg", 4), F.round("kg", 6), "kg").alias("x"))
    metres = F.col("height") / 100
    bmi = F.col("kg") / (metres * metres)
    body = w.join(h, ["subject_id", "stay_id"]).join(placed, ["subject_id", "stay_id"]).select(
        *keys, item(5, "BMI", _decimal_text(bmi, 4), F.round(bmi, 6), "kg/m2").alias("x"))
    saps = concept("sapsii").select(*keys, item(7, "Simplified Acute Physiology Score (SAPSII)", F.col("sapsii"), F.col("sapsii"), "", "starttime").alias("x"))
    first_hour = concept("sofa").filter(F.col("hr") == 0).select("stay_id", "starttime", "sofa_24hours").join(placed, "stay_id")
    sofa = first_hour.select(*keys, item(8, "Sequential Organ Failure Assessment score (SOFA)", F.col("sofa_24hours"), F.col("sofa_24hours"), "", "starttime").alias("x"))
    parts += [d.select(*keys, "x.*") for d in (height, weight, body, saps, sofa)]
    return reduce(DataFrame.unionByName, [p.select(*keys, *out) for p in parts]).distinct()


def demographic_items(t: Tables, concept: Tables) -> DataFrame:
    """The pseudo-items that occur (itemid, label, valueuom), without the scores behind their values.

    The scores have a row for every stay or hour that they are asked for, so stand-ins with these rows and empty values do.
    """
    stays, none = t("icustays").select("subject_id", "hadm_id", "stay_id", "intime"), F.lit(None).cast("double")

    def rows(name: str) -> DataFrame:
        if name in ("age", "charlson"):
            return t("admissions").select("hadm_id", none.alias("age"), none.alias("charlson_comorbidity_index"))
        if name == "first_day_weight":
            return stays.select("subject_id", "stay_id", none.alias("weight_admit"), none.alias("weight"))
        if name == "sapsii":
            return stays.join(t("admissions").select("hadm_id"), "hadm_id").select("subject_id", "hadm_id", "stay_id", F.col("intime").alias("starttime"), none.alias("sapsii"))
        if name == "sofa":
            return concept("icustay_hourly").join(stays.select("stay_id"), "stay_id").select("stay_id", "hr", F.col("endtime").alias("starttime"), none.alias("sofa_24hours"))
        return concept(name)
    return demographics(t, rows).select("itemid", "label", "valueuom").distinct()


def uid_list(patients: DataFrame, adm: DataFrame, stays: DataFrame) -> DataFrame:
    """Distinct (type, id) of the three key levels, in id order."""
    d = patients.select("subject_id").join(adm.select("subject_id", "hadm_id"), "subject_id", "left").join(
        stays.select("subject_id", "hadm_id", "stay_id"), ["subject_id", "hadm_id"], "left")
    return cohort_ids(d).orderBy("uid", "type")


def cohort_ids(cohort: DataFrame) -> DataFrame:
    """Key columns to distinct (type, uid) rows without NULLs."""
    long = cohort.select("subject_id", "hadm_id", "stay_id").unpivot([], ["subject_id", "hadm_id", "stay_id"], "type", "uid")
    return long.filter(F.col("uid").isNotNull()).distinct()


def resolve_uid(adm: DataFrame, stays: DataFrame, patients: DataFrame, uid: int) -> DataFrame:
    """(subject, admission, stay) of an id of any level; levels below the id's own are NULL."""
    none = F.lit(None).cast("long")
    return (patients.filter(F.col("subject_id") == uid).select(F.lit("subject_id").alias("type"), "subject_id", none.alias("hadm_id"), none.alias("stay_id"))
            .unionByName(adm.filter(F.col("hadm_id") == uid).select(F.lit("hadm_id").alias("type"), "subject_id", "hadm_id", none.alias("stay_id")))
            .unionByName(stays.filter(F.col("stay_id") == uid).select(F.lit("stay_id").alias("type"), "subject_id", "hadm_id", "stay_id")))


ITEM_TABLES = ("procedureevents", "ingredientevents", "inputevents", "outputevents", "datetimeevents", "chartevents")


def distinct_events(items: DataFrame, labs: DataFrame, micro: DataFrame, drugs: DataFrame, demo: DataFrame, custom: DataFrame) -> DataFrame:
    """The searchable catalogue of items from every source."""
    def rows(df: DataFrame, label: str, category: Column, linksto: Column, kind: Column) -> DataFrame:
        return df.select("itemid", F.col(label).alias("label"), category.alias("category"), linksto.alias("linksto"), kind.cast("string").alias("param_type")).distinct()
    none = F.lit(None)
    parts = [
        rows(items.filter(F.col("linksto").isin(list(ITEM_TABLES))), "label", F.col("category"), F.col("linksto"), F.col("param_type")),
        rows(labs, "label", F.col("category"), F.lit("labevents"), F.col("fluid")),
        rows(micro, "label", F.lit("Microbiology"), F.lit("microbiologyresultsevents"), none),
        rows(drugs, "drug", F.lit("Prescriptions"), F.lit("prescriptions"), none),
        rows(demo, "label", F.lit("Demographics"), F.lit("demographics"), F.col("valueuom")),
        rows(custom, "label", F.lit("User imported"), F.lit("customevents"), F.col("author"))]
    return reduce(DataFrame.unionByName, parts)


def event_detail(t: Tables, records: DataFrame, table: str) -> DataFrame:
    """Source rows of timeline records of one table, with their dictionary entry.

    Keys differ per source: culture rows by their event id; laboratory rows by patient, item, time, value and
    unit (not admission); interval rows also by end time. NULL values and units match NULL. A text value
    is compared as number where the source holds numbers.
    """
    src = t(table)
    r = records.filter(F.col("linksto") == table)
    if table == "microbiologyevents":
        return src.join(r.select(F.col("valueuom").cast("long").alias("microevent_id")).distinct(), "microevent_id", "left_semi")
    spec = EVENTS[table]
    uom = spec.uom.get(spec.value)
    typed = src.schema[spec.value].dataType
    value = F.col("value").try_cast(typed) if typed.typeName() == "double" else F.col("value")
    keys = {"subject_id": F.col("subject_id"), spec.time: F.col("starttime")}
    if table != "prescriptions":
        keys["itemid"] = F.col("itemid")
    if table != "labevents":
        keys["hadm_id"] = F.col("hadm_id")
    if spec.scope == "icu":
        keys["stay_id"] = F.col("stay_id")
    if table != "datetimeevents":
        keys[spec.value] = value
    if uom and table not in ("customevents", "demographics"):
        keys[uom] = F.col("valueuom")
    if spec.end:
        keys[spec.end] = F.col("endtime")
    if table == "prescriptions":
        keys["drug"] = F.col("label")
    wanted = r.select(*[c.alias(f"__k_{k}") for k, c in keys.items()]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    hit = src.join(wanted, cond, "left_semi")
    if spec.dictionary is None:
        return hit
    dim = t(spec.dictionary)
    on = "drug" if table == "prescriptions" else "itemid"
    return hit.join(dim, on)


# --- per patient ------------------------------------------------------------------------------------
#: Rows of an admission up to which one task puts its text in order.
MOST_ROWS = 1 << 18


def patient_text_lines(events: DataFrame, size: int = 1000, most: int = MOST_ROWS) -> DataFrame:
    """One line per patient, admission and item: its values in time order, one per (item, time).

    A line comes in parts of at most `size` values (`part` orders them); joining the parts of a line with blanks gives
    the full text. User events are left out.

    The rows of an admission go to one task, which needs no other exchange for their text: in the order of the input they share
    ids and times, so that they take few bytes. Admissions of more than `most` rows, which can only be few, are counted beforehand
    and go by item and span of time instead, so that no task holds a whole history.
    """
    d = events.filter(F.coalesce(F.col("category") != "User imported", F.lit(True)) & F.col("value").isNotNull())
    title = F.concat_ws(" ", "category", "param_type", "label", F.col("itemid").cast("string"))
    one = ["subject_id", "hadm_id"]
    keys = [*one, "itemid", "title"]
    d = d.select(*one, "itemid", title.alias("title"), "starttime", "value")
    large = F.broadcast(d.groupBy(*one).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > most).select(*[F.col(c).alias(f"__{c}") for c in one]))
    is_large = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in one])

    # titles stay behind under a 128-bit name, as most of the bytes of a row would be theirs
    name = F.struct(F.xxhash64("itemid", "title").alias("a"), F.xxhash64(F.lit(7), "itemid", "title").alias("b"))
    names = d.select("itemid", "title").distinct().withColumn("name", name)
    whole = d.join(large, is_large, "left_anti").select(*one, name.alias("name"), "starttime", "value").repartition(*one)
    whole = whole.groupBy(*one, "name").agg(F.sort_array(F.collect_list(F.struct("starttime", "value"))).alias("all"))
    # of the values of one time the least, which comes first
    first = F.filter("all", lambda x, i: (i == 0) | ~x["starttime"].eqNullSafe(F.get("all", i - 1)["starttime"]))
    whole = whole.select(*one, "name", F.transform(first, lambda x: x["value"]).alias("all"))
    whole = whole.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size("all") - 1) / size))).alias("part"))
    whole = whole.select(*one, "name", "part", F.array_join(F.slice("all", (F.col("part") * size + 1).cast("int"), size), " ").alias("values"))
    whole = whole.join(names, "name").select(*keys, "part", "values")

    cut = d.join(large, is_large, "left_semi").groupBy(*keys, "starttime").agg(F.min("value").alias("value"))
    cut = row_numbers(cut, keys, "starttime", "n", span=30 * DAY).withColumn("part", F.floor((F.col("n") - 1) / size).cast("long"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"])
    return whole.unionByName(cut.groupBy(*keys, "part").agg(F.array_join(values, " ").alias("values")))


def patient_text(overview: DataFrame, diagnoses: DataFrame, lines: DataFrame) -> DataFrame:
    """The whole text of every admission as ordered rows: header, diagnoses, item lines.

    Order by (section, position, title, part) within a patient and admission.
    """
    keys = ["subject_id", "hadm_id"]
    none, blank = F.lit(0).cast("long"), F.lit("")
    head = patient_text_header(overview).select(*keys, F.lit(0).alias("section"), F.coalesce("stay_id", F.lit(0)).cast("long").alias("position"), blank.alias("title"),
                                                none.alias("part"), F.col("header").alias("text"))
    dx = diagnoses.select(*keys, F.lit(1).alias("section"), F.col("seq_num").cast("long").alias("position"), F.col("line").alias("title"), none.alias("part"), F.col("line").alias("text"))
    body = lines.select(*keys, F.lit(2).alias("section"), F.col("itemid").alias("position"), "title", "part", F.concat(F.col("title"), F.lit(" : "), F.col("values")).alias("text"))
    return head.unionByName(dx).unionByName(body)


def patient_text_header(overview: DataFrame) -> DataFrame:
    """The header fields of the patient text."""
    field = lambda name, c: F.concat(F.lit(f"{name} : "), F.coalesce(F.col(c).cast("string"), F.lit("NA")))
    text = F.concat_ws("\n", field("Gender", "gender"), field("Age", "age"), field("Charlson Comorbidity Index", "charlson_comorbidity_index"),
                       field("SOFA", "sofa"), field("Glasgow Score Minimum", "gcs_min"))
    return overview.select("subject_id", "hadm_id", "stay_id", text.alias("header"))


def diagnosis_lines(dx: DataFrame, d_dx: DataFrame) -> DataFrame:
    """One line per diagnosis: code, version, title."""
    return dx.join(d_dx, ["icd_code", "icd_version"]).select(
        "subject_id", "hadm_id", "seq_num",
        F.concat(F.col("icd_code"), F.lit(" v"), F.col("icd_version").cast("string"), F.lit(" "), F.col("long_title")).alias("line"))


def patient_overview(t: Tables, concept: Tables, subject: int | None = None, hadm: int | None = None) -> DataFrame:
    """Patient, admission and stay with comorbidity, organ failure and coma scores, age, lengths and death."""
    d = scope(t("patients"), subject).select("subject_id", "gender", "anchor_age", "anchor_year", "dod").join(
        scope(t("admissions"), subject, hadm).select("subject_id", "hadm_id", "admittime", "dischtime", "admission_type"), "subject_id")
    d = d.join(t("icustays").select("subject_id", "hadm_id", "stay_id", "intime", "outtime"), ["subject_id", "hadm_id"], "left")
    d = d.join(concept("charlson").select("subject_id", "hadm_id", "charlson_comorbidity_index"), ["subject_id", "hadm_id"], "left")
    d = d.join(concept("first_day_sofa").select("stay_id", "sofa"), "stay_id", "left").join(concept("first_day_gcs").select("stay_id", "gcs_min"), "stay_id", "left")
    died = F.col("dod").cast("timestamp_ntz")
    return d.select(
        "subject_id", "hadm_id", "stay_id", "gender", "admission_type", age_by_year("admittime", "anchor_age", "anchor_year").alias("age"),
        span_days("dischtime", "admittime").alias("hadm_days"), span_days("outtime", "intime").alias("stay_days"),
        (died <= F.col("dischtime")).alias("in_hospital_death"), span_days(died, F.col("dischtime")).alias("days_to_death"),
        "charlson_comorbidity_index", "sofa", "gcs_min")


NO_NOTE = "No discharge note is associated with this hospital admission."


def discharge_notes(adm: DataFrame, notes: DataFrame, subject: int | None = None, hadm: int | None = None) -> DataFrame:
    """Discharge notes of admissions as one line of facts and the whole text, numbered in the order they were charted.

    An admission without a note has one row that says so, with note 0.
    """
    who = scope(adm, subject, hadm).select("subject_id", "hadm_id")
    n = scope(notes, subject, hadm).select("hadm_id", "note_id", "charttime", "storetime", "text")
    # an admission has few notes
    order = Window.partitionBy("hadm_id").orderBy(F.col("charttime").asc_nulls_last(), "note_id")
    n = n.withColumn("note", F.row_number().over(order))
    shown = lambda name, c: F.concat(F.lit(f"{name} : "), F.coalesce(F.col(c).cast("string"), F.lit("NA")))
    facts = F.concat_ws(" | ", shown("Note ID", "note_id"), shown("Chart time", "charttime"), shown("Store time", "storetime"))
    has = F.col("note").isNotNull()
    return who.join(n, "hadm_id", "left").select(
        "subject_id", "hadm_id", F.coalesce("note", F.lit(0)).alias("note"), "note_id", "charttime", "storetime", F.when(has, facts).otherwise(NO_NOTE).alias("facts"), "text")


def overview_notes(overview: DataFrame, notes: DataFrame) -> DataFrame:
    """The patient overview with the number of discharge notes, the time of the last one and the number of characters in them."""
    per = notes.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("notes"), F.max("charttime").alias("last_note"), F.sum(F.length("text")).alias("note_characters"))
    return overview.join(per, "hadm_id", "left").fillna(0, ["notes"])


def patient_transfers(transfers: DataFrame, subject: int | None = None, triage: DataFrame | None = None) -> DataFrame:
    """Transfers in time order, with emergency triage where that table is loaded."""
    d = scope(transfers, subject)
    if triage is not None:
        d = d.join(triage.withColumnRenamed("stay_id", "transfer_id").drop("subject_id"), "transfer_id", "left")
    return d.orderBy("subject_id", F.col("intime").asc_nulls_last())


def patient_index(patients: DataFrame, adm: DataFrame, stays: DataFrame) -> DataFrame:
    """Per patient: admissions, stays, age at the first admission."""
    a = adm.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_hadm"), F.min("admittime").alias("first_admit"))
    s = stays.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_stay"))
    d = patients.join(a, "subject_id").join(s, "subject_id", "left")
    return d.select("subject_id", "gender", "total_hadm", F.coalesce("total_stay", F.lit(0)).alias("total_stay"),
                    age_by_year("first_admit", "anchor_age", "anchor_year").alias("age"))


def admission_index(adm: DataFrame, stays: DataFrame) -> DataFrame:
    """Per admission: its type and number of stays."""
    s = stays.groupBy("subject_id", "hadm_id").agg(F.count("stay_id").alias("total_stay"))
    return adm.select("subject_id", "hadm_id", "admission_type").join(s, ["subject_id", "hadm_id"], "left").fillna(0, ["total_stay"])


CHART_TABLES: Mapping[str, tuple[str | None, tuple[str, ...]]] = {
    "admissions": (None, ()), "icustays": (None, ()), "diagnoses_icd": ("d_icd_diagnoses", ("icd_code", "icd_version")),
    "procedures_icd": ("d_icd_procedures", ("icd_code", "icd_version")), "prescriptions": (None, ()), "chartevents": ("d_items", ("itemid",)),
    "labevents": ("d_labitems", ("itemid",)), "inputevents": ("d_items", ("itemid",)), "outputevents": ("d_items", ("itemid",)),
    "procedureevents": ("d_items", ("itemid",)), "microbiologyevents": (None, ()),
}


def patient_chart_bundle(t: Tables, subjects: Sequence[int] | None = None, tables: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every table of the patient chart with labels, for all patients or a list of them.

    Codes are left-joined to their titles, items inner-joined to their labels.
    """
    out = {}
    for name in tables or CHART_TABLES:
        dictionary, on = CHART_TABLES[name]
        d = t(name) if subjects is None else t(name).filter(F.col("subject_id").isin(list(subjects)))
        if dictionary:
            dim = t(dictionary)
            take = [c for c in ("label", "category", "long_title") if c in dim.columns]
            d = d.join(dim.select(*on, *take), list(on), "left" if "icd_code" in on else "inner")
        out[name] = d
    return out


def item_frequency(events: DataFrame, min_n: int = 10, top: int | None = 10) -> DataFrame:
    """Items of an admission recorded more than `min_n` times, the `top` most frequent ones (all when None)."""
    counts = events.filter(F.col("valuenum").isNotNull()).groupBy("hadm_id", "itemid", "label", "valueuom", "category").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") > min_n)
    w = Window.partitionBy("hadm_id").orderBy(F.desc("n"), "itemid", F.col("valueuom").asc_nulls_last())
    ranked = often.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def rare_item_rows(events: DataFrame, max_n: int = 4) -> DataFrame:
    """The rows of items with at most `max_n` values in an admission."""
    with_value = events.filter(F.col("valuenum").isNotNull())
    rare = with_value.groupBy("hadm_id", "itemid", "label", "valueuom", "category").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_n)
    return with_value.join(rare.select("hadm_id", "itemid").distinct(), ["hadm_id", "itemid"], "left_semi").select(
        "hadm_id", "charttime", "itemid", "label", "valuenum", "valueuom", "category")


def timeline_items(events: DataFrame, merge: Sequence[str], key: Sequence[str] = ("subject_id", "hadm_id"), adm: DataFrame | None = None,
                   stays: DataFrame | None = None) -> DataFrame:
    """Timeline entries: simultaneous items of a merged category become one entry named after it.

    Entries with an end are ranges, others boxes. Admissions and stays are added as background spans.
    """
    keys = list(key)
    d = events.select(*keys, F.col("starttime").alias("start"), F.col("endtime").alias("end"), F.col("label").alias("content"), F.col("category").alias("group"))
    merged = d.filter(F.col("group").isin(list(merge)))
    first = F.min_by(F.struct("content", "end"), F.struct(F.col("content").isNull(), F.col("content"), F.col("end").isNull(), F.col("end")))
    merged = merged.groupBy(*keys, "start", "group").agg(F.count(F.lit(1)).alias("n"), first.alias("x"))
    merged = merged.select(*keys, "start", F.col("x.end").alias("end"), F.when(F.col("n") > 1, F.col("group")).otherwise(F.col("x.content")).alias("content"), "group")
    rest = d.filter(~F.coalesce(F.col("group").isin(list(merge)), F.lit(False)))
    out = merged.unionByName(rest).withColumn("type", F.when(F.col("end").isNotNull(), "range").otherwise("box"))

    def background(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        return df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end"), F.lit(name).alias("content"), F.lit(name).alias("group"), F.lit("background").alias("type"))
    if adm is not None:
        out = out.unionByName(background(adm, "admittime", "dischtime", "Hospital Stay"))
    if stays is not None:
        out = out.unionByName(background(stays, "intime", "outtime", "ICU Stay"))
    return out
