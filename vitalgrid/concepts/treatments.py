"""Comorbidity, medication and treatment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HOUR, any_keyword, canonical, round_dec
from ..operators.joins import contained_join, interval_join, with_dictionary
from ..operators.reshape import gap_episodes, pivot_events, segment_intervals
from ..operators.scoring import code_flags
from ..sources.catalog import Catalog
from . import definitions as D


def charlson(cat: Catalog) -> DataFrame:
    adm = cat.table("admissions").select("subject_id", "hadm_id")
    flags = code_flags(cat.table("diagnoses_icd"), ["hadm_id"], D.CHARLSON)
    a = F.col("age")
    age = cat.concept("age").select("hadm_id", F.when(a <= 50, 0).when(a <= 60, 1).when(a <= 70, 2).when(a <= 80, 3).otherwise(4).alias("age_score"))
    d = adm.join(flags, "hadm_id", "left").fillna(0, list(D.CHARLSON)).join(age, "hadm_id", "left")
    c = {n: F.col(n) for n in D.CHARLSON}
    single = ("myocardial_infarct", "congestive_heart_failure", "peripheral_vascular_disease", "cerebrovascular_disease", "dementia",
              "chronic_pulmonary_disease", "rheumatic_disease", "peptic_ulcer_disease")
    index = reduce(lambda x, y: x + y, (c[n] for n in single), F.col("age_score"))
    index = (index + F.greatest(c["mild_liver_disease"], 3 * c["severe_liver_disease"]) + F.greatest(2 * c["diabetes_with_cc"], c["diabetes_without_cc"])
             + F.greatest(2 * c["malignant_cancer"], 6 * c["metastatic_solid_tumor"]) + 2 * c["paraplegia"] + 2 * c["renal_disease"] + 6 * c["aids"])
    return d.select("subject_id", "hadm_id", "age_score", *D.CHARLSON, index.alias("charlson_comorbidity_index"))


# --- drugs by keyword --------------------------------------------------------------------------------
def drug_class(rx: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Orders whose drug name contains one of the words: one expression on the scan, nothing is shuffled."""
    return rx.filter(any_keyword("drug", words))


def _named_class(cat: Catalog, name: str, words: tuple[str, ...]) -> DataFrame:
    return drug_class(cat.table("prescriptions"), words).select("subject_id", "hadm_id", F.col("drug").alias(name), "starttime", "stoptime")


def acei(cat: Catalog) -> DataFrame:
    return _named_class(cat, "acei", D.ACE_INHIBITORS)


def arb(cat: Catalog) -> DataFrame:
    return _named_class(cat, "arb", D.RECEPTOR_BLOCKERS)


def nsaid(cat: Catalog) -> DataFrame:
    return _named_class(cat, "nsaid", D.ANTI_INFLAMMATORY)


def antibiotic(cat: Catalog) -> DataFrame:
    """Antibiotic orders by name, route and form, with the stay that holds their start.

    A base solution counts only when the same drug and route is also ordered as a drug of its own; so only
    those few rows are joined back to the drugs.
    """
    text = ~F.col("route").isin(list(D.EXCLUDED_ROUTES)) & ~any_keyword("route", D.EXCLUDED_ROUTE_WORDS) & ~any_keyword("drug", D.EXCLUDED_FORMS)
    named = drug_class(cat.table("prescriptions"), D.ANTIBIOTICS).filter(text)
    own = F.coalesce(F.col("drug_type") != "BASE", F.lit(False))
    main = named.filter(own)
    base = named.filter(~own).join(main.select("drug", "route").distinct(), ["drug", "route"], "left_semi").select(named.columns)
    stays = cat.table("icustays").select("hadm_id", "stay_id", "intime", "outtime")
    d = interval_join(main.unionByName(base), stays, ["hadm_id"], "starttime", "intime", "outtime", "[)", "left")
    return d.select("subject_id", "hadm_id", "stay_id", F.col("drug").alias("antibiotic"), "route", "starttime", "stoptime")


# --- infusions --------------------------------------------------------------------------------------
def normalise_rate(itemid: int) -> Column:
    """Infusion rate in the unit the scores expect."""
    rate, uom, weight = F.col("rate"), F.col("rateuom"), F.col("patientweight")
    if itemid == D.INFUSIONS["norepinephrine"]:
        return F.when((uom == "mg/kg/min") & (weight != 1), rate * 1000.0).when((uom == "mg/kg/min") & weight.isNull(), rate * 1000.0).otherwise(rate)
    if itemid == D.INFUSIONS["phenylephrine"]:
        return F.when(uom == "mcg/min", rate / weight).otherwise(rate)
    if itemid == D.INFUSIONS["vasopressin"]:
        return F.when(uom == "units/min", rate * 60.0).otherwise(rate)
    return rate


def infusion(name: str):
    def build(cat: Catalog) -> DataFrame:
        item = D.INFUSIONS[name]
        return cat.table("inputevents").filter(F.col("itemid") == item).select(
            "stay_id", "linkorderid", normalise_rate(item).alias("vaso_rate"), F.col("amount").alias("vaso_amount"), "starttime", "endtime")
    build.__name__ = name
    return build


def neuroblock(cat: Catalog) -> DataFrame:
    return cat.table("inputevents").filter(F.col("itemid").isin(list(D.NEUROBLOCK)) & F.col("rate").isNotNull()).select(
        "stay_id", "orderid", F.col("rate").alias("drug_rate"), F.col("amount").alias("drug_amount"), "starttime", "endtime")


_AGENT_COLUMNS = ("dopamine", "epinephrine", "norepinephrine", "phenylephrine", "vasopressin", "dobutamine", "milrinone")


def vasoactive_agent(cat: Catalog) -> DataFrame:
    """Segments between all infusion boundaries with the rate of every agent that covers the segment.

    The infusions are read once; one containment join serves all agents. Rates are counted per (segment, agent, rate) before they are
    put side by side; several infusions of one agent over a segment give one row per combination.
    """
    items = {D.INFUSIONS[n]: n for n in _AGENT_COLUMNS}
    agent, rate = F.lit(None).cast("string"), F.lit(None).cast("double")
    for item, name in items.items():
        agent = F.when(F.col("itemid") == item, name).otherwise(agent)
        rate = F.when(F.col("itemid") == item, normalise_rate(item)).otherwise(rate)
    runs = cat.table("inputevents").filter(F.col("itemid").isin(list(items))).select("stay_id", "starttime", "endtime", agent.alias("agent"), rate.alias("vaso_rate"))
    segs = segment_intervals({"all": runs})
    runs = runs.withColumnsRenamed({"starttime": "i_start", "endtime": "i_end"})
    ids = ["stay_id", "starttime", "endtime"]
    hits = contained_join(segs, runs, ["stay_id"], ("starttime", "endtime"), ("i_start", "i_end"), "left")
    counted = hits.groupBy(*ids, "agent", "vaso_rate").agg(F.count(F.lit(1)).alias("n"))
    wide = counted.groupBy(*ids).agg(*[
        F.collect_list(F.when(F.col("agent") == n, F.struct("vaso_rate", "n"))).alias(n) for n in _AGENT_COLUMNS])
    for n in _AGENT_COLUMNS:
        wide = wide.withColumn(n, F.explode_outer(n))
    copies = reduce(lambda x, y: x * y, [F.coalesce(F.col(f"{n}.n"), F.lit(1).cast("long")) for n in _AGENT_COLUMNS])
    wide = wide.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return wide.select(*ids, *[F.col(f"{n}.vaso_rate").alias(n) for n in _AGENT_COLUMNS])


def norepinephrine_equivalent_dose(cat: Catalog) -> DataFrame:
    used = ("norepinephrine", "epinephrine", "phenylephrine", "dopamine", "vasopressin")
    z = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in used}
    dose = z["norepinephrine"] + z["epinephrine"] + z["phenylephrine"] / 10 + z["dopamine"] / 100 + z["vasopressin"] * 2.5 / 60
    return (cat.concept("vasoactive_agent").filter(F.coalesce(*used).isNotNull())
            .select("stay_id", "starttime", "endtime", round_dec(dose, 4).alias("norepinephrine_equivalent_dose")))


# --- treatment --------------------------------------------------------------------------------------
def crrt(cat: Catalog) -> DataFrame:
    ce = cat.table("chartevents").filter(F.col("value").isNotNull())
    items = sorted({i for c in D.CRRT for i in c.itemids} | {D.CRRT_SYSTEM})
    states = []
    for name, (on, off) in D.CRRT_STATES.items():
        is_system = F.col("itemid") == D.CRRT_SYSTEM
        flag = F.when(is_system & F.col("value").isin(list(on)), 1)
        if off:
            flag = flag.when(is_system & F.col("value").isin(list(off)), 0)
        states.append(F.max(flag).alias(name))
    return (ce.filter(F.col("itemid").isin(items)).groupBy("stay_id", "charttime")
            .agg(*[F.max(c.value()).alias(c.name) for c in D.CRRT], *states))


def invasive_line(cat: Catalog) -> DataFrame:
    mv = cat.table("procedureevents").filter(F.col("itemid").isin(list(D.INVASIVE_LINES)))
    d = with_dictionary(mv, cat.table("d_items").select("itemid", "label"))
    out = d.select("stay_id", canonical("label", D.LINE_TYPES).alias("line_type"), canonical("location", D.LINE_SITES).alias("line_site"),
                   "starttime", "endtime")
    return out.orderBy(*[F.col(c).asc_nulls_first() for c in ("stay_id", "starttime", "line_type", "line_site")])


def rrt(cat: Catalog) -> DataFrame:
    """Dialysis signs from charting, infusions and procedures, overlaid by the ranges that cover them."""
    item = F.col("itemid")
    ce = cat.table("chartevents").filter(item.isin(list(D.DIALYSIS_ITEMS)) & F.col("value").isNotNull())
    active = (((item == D.PERITONEAL_STATUS) & (F.col("value") == D.PERITONEAL_IN_USE)) | item.isin(list(D.DIALYSIS_ACTIVE_ITEMS))).cast("int")
    kind = (F.when(item == D.CRRT_MODE, F.col("value")).when(item.isin(list(D.PERITONEAL_ITEMS)), "Peritoneal")
            .when(item == D.HEMODIALYSIS_OUTPUT, "IHD"))
    charted = ce.select("stay_id", "charttime", F.lit(1).alias("dialysis_present"), active.alias("dialysis_active"), kind.alias("dialysis_type"))
    infused = cat.table("inputevents").filter(item.isin(list(D.DIALYSIS_INFUSIONS)) & (F.col("amount") > 0)).select(
        "stay_id", "starttime", "endtime", F.lit(1).alias("r_active"), F.lit("CRRT").alias("r_type"))
    proc_type = F.lit(None).cast("string")
    for i, label in D.DIALYSIS_PROCEDURES.items():
        if label:
            proc_type = F.when(item == i, label).otherwise(proc_type)
    procs = cat.table("procedureevents").filter(item.isin(list(D.DIALYSIS_PROCEDURES)) & F.col("value").isNotNull()).select(
        "stay_id", "starttime", "endtime", F.when(item.isin(list(D.DIALYSIS_PASSIVE)), 0).otherwise(1).alias("r_active"), proc_type.alias("r_type"))
    ranges = infused.union(procs).distinct()
    starts = ranges.select("stay_id", F.col("starttime").alias("charttime"), F.lit(1).alias("dialysis_present"),
                           F.col("r_active").alias("dialysis_active"), F.col("r_type").alias("dialysis_type"))
    times = charted.union(starts).distinct()
    d = interval_join(times, ranges, ["stay_id"], "charttime", "starttime", "endtime", "[]", "left")
    return d.select("stay_id", "charttime", "dialysis_present", F.coalesce("r_active", "dialysis_active").alias("dialysis_active"),
                    F.coalesce("r_type", "dialysis_type").alias("dialysis_type"))


def ventilation_state() -> Column:
    device, mode, hamilton = (F.col(c) for c in ("o2_delivery_device_1", "ventilator_mode", "ventilator_mode_hamilton"))

    def listed(c: Column, values: tuple[str, ...]) -> Column:
        return F.coalesce(c.isin(list(values)), F.lit(False))
    return (F.when(listed(device, D.TRACH_DEVICES), "Tracheostomy")
            .when(listed(device, D.INVASIVE_DEVICES) | listed(mode, D.INVASIVE_MODES) | listed(hamilton, D.INVASIVE_HAMILTON), "InvasiveVent")
            .when(listed(device, D.NONINVASIVE_DEVICES) | listed(hamilton, D.NONINVASIVE_HAMILTON), "NonInvasiveVent")
            .when(listed(device, D.HIGH_FLOW_DEVICES), "HFNC").when(listed(device, D.SUPPLEMENTAL_DEVICES), "SupplementalOxygen")
            .when(listed(device, D.NO_DEVICE), "None"))


def ventilation(cat: Catalog) -> DataFrame:
    vs = cat.concept("ventilator_setting").select("stay_id", "charttime", "ventilator_mode", "ventilator_mode_hamilton")
    od = cat.concept("oxygen_delivery").select("stay_id", "charttime", "o2_delivery_device_1")
    states = vs.join(od, ["stay_id", "charttime"], "full").withColumn("ventilation_status", ventilation_state())
    states = states.filter(F.col("ventilation_status").isNotNull()).select("stay_id", "charttime", "ventilation_status")
    return gap_episodes(states, ["stay_id"], "charttime", "ventilation_status", 14 * HOUR).select("stay_id", "starttime", "endtime", "ventilation_status")


BUILDERS = {f.__name__: f for f in (
    charlson, acei, arb, nsaid, antibiotic, neuroblock, vasoactive_agent, norepinephrine_equivalent_dose, crrt, invasive_line, rrt, ventilation)}
BUILDERS.update({n: infusion(n) for n in D.INFUSIONS})
