"""Demographics, hourly grid, body size, laboratory and charted measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HOUR, age_years, datetime_diff, fio2_percent, micros, round_dec, shift
from ..operators.joins import asof_join, interval_join
from ..operators.reshape import ItemCol, hourly_grid, pivot_events, to_intervals
from ..operators.windows import Agg, Order, carry_previous, neighbours, range_window, sequence_flags, top1
from ..sources.catalog import Catalog
from . import definitions as D


# --- demographics and grid ---------------------------------------------------------------------------
def age(cat: Catalog) -> DataFrame:
    a = cat.table("admissions").select("subject_id", "hadm_id", "admittime")
    p = cat.table("patients").select("subject_id", "anchor_age", "anchor_year")
    return a.join(p, "subject_id").select(
        "subject_id", "hadm_id", "admittime", "anchor_age", "anchor_year", age_years("admittime", "anchor_age", "anchor_year").alias("age"))


def icustay_times(cat: Catalog) -> DataFrame:
    hr = (cat.table("chartevents").filter(F.col("itemid") == D.HEART_RATE)
          .groupBy("stay_id").agg(F.min("charttime").alias("intime_hr"), F.max("charttime").alias("outtime_hr")))
    return cat.table("icustays").select("subject_id", "hadm_id", "stay_id").join(hr, "stay_id", "left").select(
        "subject_id", "hadm_id", "stay_id", "intime_hr", "outtime_hr")


def icustay_hourly(cat: Catalog) -> DataFrame:
    return hourly_grid(cat.concept("icustay_times"), ["stay_id"], "intime_hr", "outtime_hr")


def icustay_detail(cat: Catalog) -> DataFrame:
    adm = cat.table("admissions").select("subject_id", "hadm_id", "admittime", "dischtime", "race", "hospital_expire_flag")
    pat = cat.table("patients").select("subject_id", "gender", "dod", "anchor_age", "anchor_year")
    stays = cat.table("icustays").select("subject_id", "hadm_id", "stay_id", F.col("intime").alias("icu_intime"), F.col("outtime").alias("icu_outtime"))
    d = stays.join(adm.drop("subject_id"), "hadm_id").join(pat, "subject_id")
    d = sequence_flags(d, ["subject_id"], "admittime", "hospstay_seq", "first_hosp_stay")
    d = sequence_flags(d, ["hadm_id"], "icu_intime", "icustay_seq", "first_icu_stay")
    return d.select(
        "subject_id", "hadm_id", "stay_id", "gender", "dod", "admittime", "dischtime",
        datetime_diff("dischtime", "admittime", "day").alias("los_hospital"),
        age_years("admittime", "anchor_age", "anchor_year").alias("admission_age"), "race", "hospital_expire_flag",
        "hospstay_seq", "first_hosp_stay", "icu_intime", "icu_outtime",
        round_dec(datetime_diff("icu_outtime", "icu_intime", "day"), 2).alias("los_icu"), "icustay_seq", "first_icu_stay")


def weight_durations(cat: Catalog) -> DataFrame:
    """Weights as intervals: each lasts to the next one, the last to two hours after the stay."""
    w = (cat.table("chartevents").filter(F.col("itemid").isin(D.WEIGHT_ADMIT, D.WEIGHT_DAILY) & (F.col("valuenum") > 0))
         .select("stay_id", "charttime", F.when(F.col("itemid") == D.WEIGHT_ADMIT, "admit").otherwise("daily").alias("weight_type"),
                 F.col("valuenum").alias("weight")))
    stays = cat.table("icustays").select("stay_id", "intime", "outtime")
    w = neighbours(w, ["stay_id", "weight_type"], "charttime", lag={"earlier": "charttime"}, tie=["weight"]).join(stays, "stay_id")
    first_admit = (F.col("weight_type") == "admit") & F.col("earlier").isNull()
    w = w.select("stay_id", "intime", "outtime", "weight_type", "weight",
                 F.when(first_admit, shift("intime", -2, "hour")).otherwise(F.col("charttime")).alias("starttime"))
    spans = to_intervals(w, ["stay_id"], "starttime", "endtime", shift("outtime", 2, "hour"), tie=["weight_type", "weight"])
    head = top1(spans, ["stay_id"], [Order("starttime"), Order("weight_type"), Order("weight")]).filter(F.col("intime") < F.col("starttime"))
    back = head.select("stay_id", shift("intime", -2, "hour").alias("starttime"), F.col("starttime").alias("endtime"), "weight", "weight_type")
    return spans.select(back.columns).unionByName(back)


def height(cat: Catalog, merge_keys: bool = False) -> DataFrame:
    """Charted height in cm, completed by inches.

    By default rows known only in inches carry no keys, as the definition has it; `merge_keys` fills them.
    """
    ce = cat.table("chartevents").filter(F.col("valuenum").isNotNull())
    cm = ce.filter(F.col("itemid") == D.HEIGHT_CM).select("subject_id", "stay_id", "charttime", round_dec("valuenum", 2).alias("cm"))
    inch = ce.filter(F.col("itemid") == D.HEIGHT_INCH).select(
        F.col("subject_id").alias("i_subject"), F.col("stay_id").alias("i_stay"), F.col("charttime").alias("i_time"),
        round_dec(F.col("valuenum") * 2.54, 2).alias("inch"))
    j = cm.join(inch, (F.col("subject_id") == F.col("i_subject")) & (F.col("charttime") == F.col("i_time")), "full")
    keys = [F.coalesce(a, b).alias(a) if merge_keys else F.col(a) for a, b in
            (("subject_id", "i_subject"), ("stay_id", "i_stay"), ("charttime", "i_time"))]
    h = F.coalesce("cm", "inch")
    return j.select(*keys, h.alias("height")).filter((F.col("height") > 120) & (F.col("height") < 230))


# --- laboratory ------------------------------------------------------------------------------------
def _specimen() -> list[Column]:
    """Keys of a specimen; its rows agree on them but for late corrections."""
    return [F.max(c).alias(c) for c in ("subject_id", "hadm_id", "charttime")]


def _lab_pivot(cat: Catalog, items: tuple[ItemCol, ...], keep: Column) -> DataFrame:
    d = pivot_events(cat.table("labevents").filter(keep), ["specimen_id"], items, "max", _specimen())
    return d.select("subject_id", "hadm_id", "charttime", "specimen_id", *[i.name for i in items])


def cardiac_marker(cat: Catalog) -> DataFrame:
    return _lab_pivot(cat, D.CARDIAC_MARKER, F.col("valuenum").isNotNull())


def chemistry(cat: Catalog) -> DataFrame:
    return _lab_pivot(cat, D.CHEMISTRY, (F.col("valuenum") > 0) | (F.col("valuenum").isNotNull() & (F.col("itemid") == D.ANION_GAP)))


def coagulation(cat: Catalog) -> DataFrame:
    return _lab_pivot(cat, D.COAGULATION, F.col("valuenum").isNotNull())


def complete_blood_count(cat: Catalog) -> DataFrame:
    return _lab_pivot(cat, D.BLOOD_COUNT, F.col("valuenum") > 0)


def enzyme(cat: Catalog) -> DataFrame:
    return _lab_pivot(cat, D.ENZYME, F.col("valuenum") > 0)


def inflammation(cat: Catalog) -> DataFrame:
    return _lab_pivot(cat, D.INFLAMMATION, F.col("valuenum") > 0)


def blood_differential(cat: Catalog) -> DataFrame:
    """Counts and percentages; a missing count is percentage x white cells / 100 when both are usable."""
    percent_sum = F.sum(F.when(F.col("itemid").isin(list(D.DIFFERENTIAL_PERCENT)), F.col("valuenum")))
    granulocytes = ItemCol("granulocytes_abs", (D.GRANULOCYTES,), scale={D.GRANULOCYTES: 1000.0})
    d = pivot_events(cat.table("labevents").filter(F.col("valuenum") >= 0), ["specimen_id"], (*D.BLOOD_DIFFERENTIAL, granulocytes), "max",
                     [*_specimen(), percent_sum.alias("percent_sum")])
    can = (F.col("wbc") > 0) & (F.col("percent_sum") > 0)
    absolute = {f"{n}_abs": round_dec(F.when(F.col(f"{n}_abs").isNull() & can, F.col(n) * F.col("wbc") / 100).otherwise(F.col(f"{n}_abs")), 4)
                for n in D.IMPUTED}
    names = [i.name for i in D.BLOOD_DIFFERENTIAL]
    return d.select("subject_id", "hadm_id", "charttime", "specimen_id", *[absolute[n].alias(n) if n in absolute else F.col(n) for n in names])


def bg(cat: Catalog, with_spo2: bool = False) -> DataFrame:
    """Blood gases with the charted oxygen fraction of the last 4 h before the sample.

    `with_spo2` adds the last pulse oximetry of the 2 h before; the stored table does not keep it.
    """
    fio2 = fio2_percent("valuenum", low=0.2, gap_from=20.0, gap_inclusive=False)
    gas_fio2 = F.max(F.when(F.col("itemid") == D.FIO2_LAB, fio2)).alias("fio2")
    items = sorted({i for c in D.BLOOD_GAS for i in c.itemids} | {D.FIO2_LAB, 50807, 50815, 50819, 50823})
    labs = cat.table("labevents").filter(F.col("itemid").isin(items))
    gas = labs.groupBy("specimen_id").agg(*_specimen(), gas_fio2, *[F.max(c.value()).alias(c.name) for c in D.BLOOD_GAS])
    gas = gas.filter(F.col("po2").isNotNull())
    # one sample per patient and time
    gas = top1(gas, ["subject_id", "charttime"], [Order("specimen_id")])
    charted = cat.table("chartevents").filter((F.col("valuenum") > 0) & (F.col("valuenum") <= 100))
    frac = (charted.filter(F.col("itemid") == D.FIO2_CHARTED).groupBy("subject_id", "charttime")
            .agg(F.max(fio2_percent("valuenum")).alias("frac")).filter(F.col("frac") > 0))
    if with_spo2:
        spo2 = charted.filter(F.col("itemid") == D.SPO2).groupBy("subject_id", "charttime").agg(F.avg("valuenum").alias("spo2"))
        gas = asof_join(gas, spo2, ["subject_id"], "charttime", 2 * HOUR, {"spo2": "spo2"})
    gas = asof_join(gas, frac, ["subject_id"], "charttime", 4 * HOUR, {"fio2_chartevents": "frac"})
    used = F.coalesce("fio2", "fio2_chartevents")
    return gas.select(
        "subject_id", "hadm_id", "charttime", "specimen", "so2", "po2", "pco2", "fio2_chartevents", "fio2", "aado2",
        ((used / 100) * (760 - 47) - (F.col("pco2") / 0.8) - F.col("po2")).alias("aado2_calc"),
        (F.lit(100) * F.col("po2") / used).alias("pao2fio2ratio"), "ph", "baseexcess", "bicarbonate", "totalco2", "hematocrit", "hemoglobin",
        "carboxyhemoglobin", "methemoglobin", "chloride", "calcium", "temperature", "potassium", "sodium", "lactate", "glucose",
        *(["spo2"] if with_spo2 else []))


def creatinine_baseline(cat: Catalog, corrected: bool = False) -> DataFrame:
    """Lowest creatinine when normal or with kidney disease, else the renal-function estimate.

    The estimate as defined applies the last exponent to a single factor; `corrected` solves the formula for
    a filtration rate of 75 instead.
    """
    p = cat.concept("age").filter(F.col("age") >= 18).join(cat.table("patients").select("subject_id", "gender"), "subject_id", "left")
    female = F.col("gender") == "F"
    rate = F.lit(75.0 / 186.0)
    aged = F.pow(F.col("age"), F.lit(-0.203))
    if corrected:
        estimate = F.pow(rate / aged / F.when(female, 0.742).otherwise(1.0), F.lit(-1.0 / 1.154))
    else:
        estimate = F.when(female, rate / aged / F.pow(F.lit(0.742), F.lit(-1.0)) / 1.154).otherwise(rate / F.pow(aged, F.lit(-1.0)) / 1.154)
    low = cat.concept("chemistry").groupBy("hadm_id").agg(F.min("creatinine").alias("scr_min"))
    ckd = (cat.table("diagnoses_icd").filter(F.expr(D.KIDNEY_DISEASE.predicate())).groupBy("hadm_id").agg(F.max(F.lit(1)).alias("ckd_flag")))
    d = p.join(low, "hadm_id", "left").join(ckd, "hadm_id", "left").withColumn("mdrd_est", estimate)
    usable = (F.col("scr_min") <= 1.1) | (F.col("ckd_flag") == 1)
    return d.select("hadm_id", "gender", "age", "scr_min", F.coalesce("ckd_flag", F.lit(0)).alias("ckd"), "mdrd_est",
                    F.when(usable, F.col("scr_min")).otherwise(F.col("mdrd_est")).alias("scr_baseline"))


# --- charted ---------------------------------------------------------------------------------------
_STAY_TIME = ["subject_id", "stay_id", "charttime"]


def gcs(cat: Catalog) -> DataFrame:
    """Coma scale; missing parts come from the directly preceding row when less than six hours old."""
    etube = (F.col("itemid") == D.GCS_VERBAL) & (F.col("value") == D.INTUBATED_TEXT)
    verbal = F.when(etube, F.lit(0.0)).when(F.col("itemid") == D.GCS_VERBAL, F.col("valuenum"))
    ce = cat.table("chartevents").filter(F.col("itemid").isin(D.GCS_VERBAL, D.GCS_MOTOR, D.GCS_EYES))
    b = ce.groupBy(*_STAY_TIME).agg(
        F.max(F.when(F.col("itemid") == D.GCS_MOTOR, F.col("valuenum"))).alias("motor"), F.max(verbal).alias("verbal"),
        F.max(F.when(F.col("itemid") == D.GCS_EYES, F.col("valuenum"))).alias("eyes"),
        F.max(F.when(etube, 1).otherwise(0)).alias("gcs_unable"))
    b = carry_previous(b, ["stay_id"], "charttime", {"p_motor": "motor", "p_verbal": "verbal", "p_eyes": "eyes"}, 6 * HOUR)
    full = {"motor": 6, "verbal": 5, "eyes": 4}
    own = sum((F.coalesce(F.col(c), F.lit(v)) for c, v in full.items()), F.lit(0.0))
    carried = sum((F.coalesce(F.col(c), F.col(f"p_{c}"), F.lit(v)) for c, v in full.items()), F.lit(0.0))
    tube_now = (F.col("verbal") == 0) | (F.col("verbal").isNull() & (F.col("p_verbal") == 0))
    score = F.when(tube_now, F.lit(15.0)).when(F.col("p_verbal") == 0, own).otherwise(carried)
    return b.select(*_STAY_TIME, score.alias("gcs"), F.coalesce("motor", "p_motor").alias("gcs_motor"),
                    F.coalesce("verbal", "p_verbal").alias("gcs_verbal"), F.coalesce("eyes", "p_eyes").alias("gcs_eyes"), "gcs_unable")


def icp(cat: Catalog) -> DataFrame:
    return pivot_events(cat.table("chartevents"), _STAY_TIME, D.ICP)


def rhythm(cat: Catalog) -> DataFrame:
    return pivot_events(cat.table("chartevents").filter(F.col("stay_id").isNotNull()), ["subject_id", "charttime"], D.RHYTHM)


def ventilator_setting(cat: Catalog) -> DataFrame:
    ce = cat.table("chartevents").filter(F.col("value").isNotNull() & F.col("stay_id").isNotNull())
    fio2 = F.max(F.when(F.col("itemid") == D.FIO2_CHARTED, fio2_percent("valuenum", low=0.2, low_inclusive=True))).alias("fio2")
    items = sorted({i for c in D.VENTILATOR for i in c.itemids} | {D.FIO2_CHARTED})
    cols = [F.max(c.value()).alias(c.name) for c in D.VENTILATOR]
    return (ce.filter(F.col("itemid").isin(items)).groupBy("subject_id", "charttime")
            .agg(F.max("stay_id").alias("stay_id"), *cols[:9], fio2, *cols[9:])
            .select("subject_id", "stay_id", "charttime", *[c.name for c in D.VENTILATOR[:9]], "fio2", *[c.name for c in D.VENTILATOR[9:]]))


def vitalsign(cat: Catalog) -> DataFrame:
    v = F.col("valuenum")
    celsius = (F.when((F.col("itemid") == D.TEMP_FAHRENHEIT) & (v > 70) & (v < 120), (v - 32) / 1.8)
               .when((F.col("itemid") == D.TEMP_CELSIUS) & (v > 10) & (v < 50), v))
    items = sorted({i for c in D.VITALS for i in c.itemids} | {D.TEMP_FAHRENHEIT, D.TEMP_CELSIUS, D.TEMP_SITE})
    d = (cat.table("chartevents").filter(F.col("stay_id").isNotNull() & F.col("itemid").isin(items)).groupBy(*_STAY_TIME)
         .agg(round_dec(F.avg(celsius), 2).alias("temperature"), F.max(F.when(F.col("itemid") == D.TEMP_SITE, F.col("value"))).alias("temperature_site"),
              *[F.avg(c.value()).alias(c.name) for c in D.VITALS]))
    return d.select(*_STAY_TIME, *D.VITAL_ORDER)


def oxygen_delivery(cat: Catalog) -> DataFrame:
    """Last stored flow per kind and up to four devices per patient and time (only times with a flow row).

    Of flows stored at one time that of the highest stay counts, then the highest.
    """
    ce = cat.table("chartevents")
    kind = F.when(F.col("itemid").isin(D.O2_FLOW, D.O2_FLOW_BIPAP), D.O2_FLOW).otherwise(F.col("itemid")).cast("long")
    flow = ce.filter(F.col("value").isNotNull() & F.col("itemid").isin(D.O2_FLOW, D.O2_FLOW_BIPAP, D.O2_FLOW_ADDITIONAL)).select(
        "subject_id", "stay_id", "charttime", kind.alias("itemid"), "valuenum", "storetime")
    flow = top1(flow, ["subject_id", "charttime", "itemid"], [Order("storetime", desc=True), Order("stay_id", desc=True), Order("valuenum", desc=True)])
    flows = flow.groupBy("subject_id", "charttime").agg(
        F.max("stay_id").alias("stay_id"), F.max(F.when(F.col("itemid") == D.O2_FLOW, F.col("valuenum"))).alias("o2_flow"),
        F.max(F.when(F.col("itemid") == D.O2_FLOW_ADDITIONAL, F.col("valuenum"))).alias("o2_flow_additional"))
    # a time has a handful of device rows; they are ranked inside one small array
    device = (ce.filter(F.col("itemid") == D.O2_DEVICE).groupBy("subject_id", "charttime", "value").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("subject_id", "charttime")
              .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("value").isNotNull().alias("f"), "value", "n"))),
                                         lambda x: F.array_repeat(x["value"], F.least(x["n"], F.lit(4)).cast("int")))).alias("devices")))
    d = flows.join(device, ["subject_id", "charttime"], "left")
    return d.select("subject_id", "stay_id", "charttime", "o2_flow", "o2_flow_additional",
                    *[F.get("devices", F.lit(i)).alias(f"o2_delivery_device_{i + 1}") for i in range(4)])


def urine_output(cat: Catalog) -> DataFrame:
    signed = F.when((F.col("itemid") == D.IRRIGANT_IN) & (F.col("value") > 0), -F.col("value")).otherwise(F.col("value"))
    return (cat.table("outputevents").filter(F.col("itemid").isin(list(D.URINE_ITEMS))).groupBy("stay_id", "charttime")
            .agg(F.sum(signed).alias("urineoutput")))


def urine_output_rate(cat: Catalog) -> DataFrame:
    """Sums over 6/12/24 hours (frames of 5/11/23 hours) and ml/kg/h once the documented time suffices.

    Unique (stay, time) rows make the range frames equal to a self join.
    """
    stays = cat.table("icustays").select("stay_id", "intime", "outtime")
    hr = cat.table("chartevents").filter(F.col("itemid") == D.HEART_RATE).select("stay_id", "charttime")
    near = ((F.col("charttime") > shift("intime", -1, "month")) & (F.col("charttime") < shift("outtime", 1, "month")))
    tm = hr.join(stays, "stay_id").filter(near).groupBy("stay_id").agg(F.min("charttime").alias("intime_hr"))
    uo = cat.concept("urine_output").join(tm, "stay_id")
    uo = neighbours(uo, ["stay_id"], "charttime", lag={"prev": "charttime"})
    # whole microseconds add up exactly, so a time that just suffices does
    uo = uo.withColumn("since", micros("charttime") - micros(F.coalesce("prev", "intime_hr")))
    frames = {}
    for h, reach in ((6, 5), (12, 11), (24, 23)):
        frames[f"urineoutput_{h}hr"] = Agg("sum", "urineoutput", -reach * HOUR)
        frames[f"documented_{h}"] = Agg("sum", "since", -reach * HOUR)
    uo = range_window(uo, ["stay_id"], "charttime", frames)
    weight = cat.concept("weight_durations").filter(F.col("weight") > 0).select("stay_id", "starttime", "endtime", "weight")
    d = interval_join(uo, weight, ["stay_id"], "charttime", "starttime", "endtime", "(]", "left")
    rates, hours = [], []
    for h in (6, 12, 24):
        tm_h = F.col(f"documented_{h}") / F.lit(float(HOUR))
        rates.append(F.when(F.col(f"documented_{h}") >= h * HOUR, round_dec(F.col(f"urineoutput_{h}hr") / F.col("weight") / tm_h, 4)).alias(f"uo_mlkghr_{h}hr"))
        hours.append(round_dec(tm_h, 2).alias(f"uo_tm_{h}hr"))
    return d.select("stay_id", "charttime", "weight", F.col("urineoutput").alias("uo"), "urineoutput_6hr", "urineoutput_12hr", "urineoutput_24hr",
                    *rates, *hours)


BUILDERS = {f.__name__: f for f in (
    age, icustay_times, icustay_hourly, icustay_detail, weight_durations, height, cardiac_marker, chemistry, coagulation, complete_blood_count,
    enzyme, inflammation, blood_differential, bg, creatinine_baseline, gcs, icp, rhythm, ventilator_setting, vitalsign, oxygen_delivery,
    urine_output, urine_output_rate)}
