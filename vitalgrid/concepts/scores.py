"""Organ failure, severity scores and sepsis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DAY, HOUR, datetime_diff, logistic, micros, round_dec, shift, trunc_to
from ..operators.joins import Alternative, anchored, interval_join, match_first, overlaps, star_join
from ..operators.reshape import grid_bounds, hour_index
from ..operators.scoring import RuleScore, add_scores, bands, code_flags, total, worst_of
from ..operators.windows import Agg, Order, neighbours, range_window, row_numbers, top1
from ..sources.catalog import Catalog
from . import definitions as D
from .firstday import mark_ventilated, invasive_episodes


def _stays(cat: Catalog) -> DataFrame:
    return cat.table("icustays").select("subject_id", "hadm_id", "stay_id", "intime", "outtime")


# --- kidney ----------------------------------------------------------------------------------------
def kdigo_creatinine(cat: Catalog) -> DataFrame:
    """Mean creatinine per time from a week before the stay, with the lowest of the 48 h and 7 d before."""
    stays = _stays(cat)
    v = F.col("valuenum")
    lab = cat.table("labevents").filter((F.col("itemid") == D.CREATININE) & v.isNotNull() & (v <= 150)).select("subject_id", "charttime", "valuenum")
    near = anchored(lab, stays, ["subject_id"], "charttime", "intime", shift("intime", -7, "day"), F.col("outtime"), stay_cols=["hadm_id", "stay_id"])
    cr = near.groupBy("hadm_id", "stay_id", "charttime").agg(F.avg("valuenum").alias("creat"))
    cr = range_window(cr, ["stay_id"], "charttime", {
        "creat_low_past_48hr": Agg("min", "creat", -48 * HOUR, -1), "creat_low_past_7day": Agg("min", "creat", -7 * DAY, -1)})
    return stays.select("hadm_id", "stay_id").join(cr.drop("hadm_id"), "stay_id", "left").select(
        "hadm_id", "stay_id", "charttime", "creat", "creat_low_past_48hr", "creat_low_past_7day")


def kdigo_uo(cat: Catalog) -> DataFrame:
    uo = cat.concept("urine_output").join(cat.table("icustays").select("stay_id"), "stay_id")
    uo = neighbours(uo, ["stay_id"], "charttime", lag={"prev": "charttime"})
    # whole microseconds add up exactly, so a time that just suffices does
    uo = uo.withColumn("since", F.coalesce(micros("charttime") - micros("prev"), F.lit(HOUR)))
    frames = {}
    for h in (6, 12, 24):
        frames[f"urineoutput_{h}hr"] = Agg("sum", "urineoutput", -h * HOUR)
        frames[f"uo_tm_{h}hr"] = Agg("sum", "since", -h * HOUR)
    uo = range_window(uo, ["stay_id"], "charttime", frames).withColumns({f"uo_tm_{h}hr": F.col(f"uo_tm_{h}hr") / F.lit(float(HOUR)) for h in (6, 12, 24)})
    weight = cat.concept("weight_durations").select("stay_id", "starttime", "endtime", "weight")
    d = interval_join(uo, weight, ["stay_id"], "charttime", "starttime", "endtime", "[)", "left")

    def rate(h: int, enough: Column) -> Column:
        return F.when(enough, round_dec(F.col(f"urineoutput_{h}hr") / F.col("weight") / F.col(f"uo_tm_{h}hr"), 4)).alias(f"uo_rt_{h}hr")
    t6, t12, t24 = (F.col(f"uo_tm_{h}hr") for h in (6, 12, 24))
    return d.select("stay_id", "charttime", "weight", "urineoutput_6hr", "urineoutput_12hr", "urineoutput_24hr",
                    rate(6, (t6 >= 6) & (t6 < 12)), rate(12, t12 >= 12), rate(24, t24 >= 24), "uo_tm_6hr", "uo_tm_12hr", "uo_tm_24hr")


def kdigo_stages(cat: Catalog) -> DataFrame:
    stays = _stays(cat)
    cr = add_scores(cat.concept("kdigo_creatinine").drop("hadm_id"), [D.KDIGO_CREATININE])
    uo = cat.concept("kdigo_uo").join(stays.select("stay_id", "intime"), "stay_id")
    uo = add_scores(uo, [D.KDIGO_URINE]).select("stay_id", "charttime", "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr", "aki_stage_uo")
    crrt = cat.concept("crrt").filter(F.col("crrt_mode").isNotNull()).select("stay_id", "charttime", F.lit(3).alias("aki_stage_crrt"))
    times = reduce(lambda a, b: a.union(b), [x.select("stay_id", "charttime") for x in (cr, uo, crrt)]).distinct()
    at = ["stay_id", "charttime"]
    d = stays.join(times, "stay_id", "left").join(cr, at, "left").join(uo, at, "left").join(crrt, at, "left")
    stage = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in ("aki_stage_creat", "aki_stage_uo", "aki_stage_crrt")])
    d = d.withColumn("aki_stage", stage).withColumn("since_us", micros("charttime") - micros("intime"))
    d = range_window(d, ["subject_id"], "since_us", {"aki_stage_smoothed": Agg("max", "aki_stage", -6 * HOUR)})
    return d.select("subject_id", "hadm_id", "stay_id", "charttime", "creat_low_past_7day", "creat_low_past_48hr", "creat", "aki_stage_creat",
                    "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr", "aki_stage_uo", "aki_stage_crrt", "aki_stage", "aki_stage_smoothed")


def meld(cat: Catalog) -> DataFrame:
    """Liver score: logs floored at 1, dialysis counts as creatinine 4, sodium correction above 11."""
    d = star_join(_stays(cat), [
        cat.concept("first_day_lab").select("stay_id", "creatinine_max", "bilirubin_total_max", "inr_max", "sodium_min"),
        cat.concept("first_day_rrt").select("stay_id", F.col("dialysis_present").alias("rrt"))], "stay_id")
    na = F.col("sodium_min")
    sodium = F.when(na.isNull() | (na > 137), 0.0).when(na < 125, 12.0).otherwise(F.lit(137.0) - na)

    def log_part(c: str) -> Column:
        return F.log(F.greatest(F.coalesce(F.col(c), F.lit(1.0)), F.lit(1.0)))
    dialysed = (F.col("rrt") == 1) | (F.col("creatinine_max") > 4.0)
    score = (F.when(dialysed, 0.957 * F.log(F.lit(4.0))).otherwise(0.957 * log_part("creatinine_max"))
             + 0.378 * log_part("bilirubin_total_max") + (1.120 * log_part("inr_max") + 0.643))
    d = d.withColumn("meld_initial", F.when(score > 4, 40.0).otherwise(round_dec(score, 1) * 10))
    m = F.col("meld_initial")
    return d.select("subject_id", "hadm_id", "stay_id", "meld_initial",
                    F.when(m > 11, m + 1.32 * sodium - 0.033 * m * sodium).otherwise(m).alias("meld"), "rrt", "creatinine_max",
                    "bilirubin_total_max", "inr_max", "sodium_min")


# --- hourly organ failure ----------------------------------------------------------------------------
def sofa(cat: Catalog) -> DataFrame:
    """Hourly score with the 24-hour maximum of every component.

    Points find their hour by arithmetic; all sources are stacked and reduced by one aggregate per
    (stay, hour), which is joined once to the grid.
    """
    bounds = grid_bounds(cat.concept("icustay_times"), ["stay_id"], "intime_hr", "outtime_hr")
    stays = cat.table("icustays").select("subject_id", "hadm_id", "stay_id")
    span = stays.join(bounds, "stay_id").select(
        "subject_id", "hadm_id", "stay_id", "anchor", "last_hr", shift("anchor", -25, "hour").alias("g_start"),
        shift("anchor", F.col("last_hr"), "hour").alias("g_end"))

    def hourly(points: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        cols = list(dict.fromkeys([key, "stay_id"]))
        p = points.select(key, "charttime", value.alias(name)).filter(F.col(name).isNotNull())
        inside = interval_join(p, span.select(*cols, "anchor", "g_start", "g_end"), [key], "charttime", "g_start", "g_end", "(]")
        return inside.select("stay_id", hour_index("charttime", "anchor").alias("hr"), name)

    gas = cat.concept("bg").filter((F.col("specimen") == "ART.") & F.col("pao2fio2ratio").isNotNull()).select("subject_id", "charttime", "pao2fio2ratio")
    gas = interval_join(gas, span.select("subject_id", "stay_id", "anchor", "g_start", "g_end"), ["subject_id"], "charttime", "g_start", "g_end", "(]")
    gas = mark_ventilated(cat, gas.select("stay_id", "charttime", "anchor", "pao2fio2ratio"))
    gas = gas.select("stay_id", hour_index("charttime", "anchor").alias("hr"),
                     F.when(F.col("vent") == 0, F.col("pao2fio2ratio")).alias("pao2fio2ratio_novent"),
                     F.when(F.col("vent") == 1, F.col("pao2fio2ratio")).alias("pao2fio2ratio_vent"))

    def infused(name: str) -> DataFrame:
        runs = cat.concept(name).select("stay_id", "starttime", "endtime", F.col("vaso_rate").alias(f"rate_{name}")).filter(F.col(f"rate_{name}").isNotNull())
        d = runs.join(span.select("stay_id", "anchor", "last_hr"), "stay_id")
        lo = F.greatest(F.floor((micros("starttime") - micros("anchor")) / F.lit(float(HOUR))) + 1, F.lit(-24))
        hi = F.least(F.floor((micros("endtime") - micros("anchor")) / F.lit(float(HOUR))), F.col("last_hr"))
        d = d.withColumn("lo", lo.cast("long")).withColumn("hi", hi.cast("long")).filter(F.col("lo") <= F.col("hi"))
        return d.select("stay_id", F.explode(F.sequence("lo", "hi")).alias("hr"), f"rate_{name}")

    covered = F.when((F.col("uo_tm_24hr") >= 22) & (F.col("uo_tm_24hr") <= 30), F.col("urineoutput_24hr") / F.col("uo_tm_24hr") * 24)
    drugs = ("epinephrine", "norepinephrine", "dopamine", "dobutamine")
    parts = [
        hourly(cat.concept("vitalsign"), "stay_id", F.col("mbp"), "meanbp_min"),
        hourly(cat.concept("gcs"), "stay_id", F.col("gcs"), "gcs_min"),
        hourly(cat.concept("enzyme"), "hadm_id", F.col("bilirubin_total"), "bilirubin_max"),
        hourly(cat.concept("chemistry"), "hadm_id", F.col("creatinine"), "creatinine_max"),
        hourly(cat.concept("complete_blood_count"), "hadm_id", F.col("platelet"), "platelet_min"),
        hourly(cat.concept("urine_output_rate"), "stay_id", covered, "uo_24hr"), gas, *[infused(n) for n in drugs]]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    low = ("pao2fio2ratio_novent", "pao2fio2ratio_vent", "meanbp_min", "gcs_min", "platelet_min")
    high = (*(f"rate_{n}" for n in drugs), "uo_24hr", "bilirubin_max", "creatinine_max")
    per_hour = stacked.groupBy("stay_id", "hr").agg(*[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])
    grid = cat.concept("icustay_hourly").join(stays.select("stay_id"), "stay_id")
    grid = grid.select("stay_id", "hr", shift("endtime", -1, "hour").alias("starttime"), "endtime")
    d = add_scores(grid.join(per_hour, ["stay_id", "hr"], "left"), D.SOFA)
    d = range_window(d, ["stay_id"], "hr", {f"{c}_24hours": Agg("max", c, -23) for c in D.SOFA_PARTS})
    day = [F.coalesce(F.col(f"{c}_24hours"), F.lit(0)).alias(f"{c}_24hours") for c in D.SOFA_PARTS]
    return d.filter(F.col("hr") >= 0).select(
        "stay_id", "hr", "starttime", "endtime", "pao2fio2ratio_novent", "pao2fio2ratio_vent", *[f"rate_{n}" for n in drugs], "meanbp_min",
        "gcs_min", "uo_24hr", "bilirubin_max", "creatinine_max", "platelet_min", *D.SOFA_PARTS, *day,
        total([f"{c}_24hours" for c in D.SOFA_PARTS]).alias("sofa_24hours"))


# --- admission scores --------------------------------------------------------------------------------
def sirs(cat: Catalog) -> DataFrame:
    d = star_join(_stays(cat), [
        cat.concept("first_day_bg_art").select("stay_id", F.col("pco2_min").alias("paco2_min")),
        cat.concept("first_day_vitalsign").select("stay_id", "temperature_min", "temperature_max", "heart_rate_max", "resp_rate_max"),
        cat.concept("first_day_lab").select("stay_id", "wbc_min", "wbc_max", "bands_max")], "stay_id")
    d = add_scores(d, D.SIRS)
    names = [s.name for s in D.SIRS]
    return d.select("subject_id", "hadm_id", "stay_id", total(names).alias("sirs"), *names)


def _gases_in_stay(cat: Catalog, *cols: str) -> DataFrame:
    """Blood gases of the admission taken during the stay."""
    stays = _stays(cat).select("hadm_id", "stay_id", "intime", "outtime")
    gas = cat.concept("bg").select("hadm_id", "charttime", *cols)
    return interval_join(gas, stays, ["hadm_id"], "charttime", "intime", "outtime", "[)").select("stay_id", "charttime", *cols)


def _known_patients(cat: Catalog) -> DataFrame:
    """Stays whose admission and patient exist."""
    return (_stays(cat).join(cat.table("admissions").select("hadm_id").distinct(), "hadm_id", "left_semi")
            .join(cat.table("patients").select("subject_id").distinct(), "subject_id", "left_semi"))


def lods(cat: Catalog) -> DataFrame:
    stays = _stays(cat)
    text = F.lower("value")
    mask = cat.table("chartevents").filter((F.col("itemid") == D.O2_DEVICE) & (text.contains("cpap") | text.contains("bipap mask"))).select("stay_id", "charttime")
    mask = anchored(mask, stays.select("stay_id", "intime"), ["stay_id"], "charttime", "intime", F.col("intime"), shift("intime", 1, "day"))
    cpap = mask.groupBy("stay_id").agg(shift(F.min("charttime"), -1, "hour").alias("c_start"), shift(F.max("charttime"), 4, "hour").alias("c_end"))
    gas = mark_ventilated(cat, _gases_in_stay(cat, "pao2fio2ratio").filter(F.col("pao2fio2ratio").isNotNull()))
    gas = gas.join(cpap, "stay_id", "left")
    helped = (F.col("vent") == 1) | F.coalesce((F.col("charttime") >= F.col("c_start")) & (F.col("charttime") <= F.col("c_end")), F.lit(False))
    pf = gas.filter(helped).groupBy("stay_id").agg(F.min("pao2fio2ratio").alias("pao2fio2_vent_min"))
    d = star_join(_known_patients(cat), [
        pf, cat.concept("first_day_gcs").select("stay_id", "gcs_min"),
        cat.concept("first_day_vitalsign").select("stay_id", "heart_rate_max", "heart_rate_min", "sbp_max", "sbp_min"),
        cat.concept("first_day_urine_output").select("stay_id", "urineoutput"),
        cat.concept("first_day_lab").select("stay_id", "bun_max", "wbc_max", "wbc_min", F.col("bilirubin_total_max").alias("bilirubin_max"),
                                            "creatinine_max", "pt_min", "pt_max", F.col("platelets_min").alias("platelet_min"))], "stay_id")
    names = [s.name for s in D.LODS]
    scored = add_scores(d, D.LODS).select("stay_id", *names)
    return stays.join(scored, "stay_id", "left").select("subject_id", "hadm_id", "stay_id", total(names).alias("lods"), *names)


def _first_day_ventilation(cat: Catalog, name: str) -> DataFrame:
    hit = overlaps(invasive_episodes(cat), _stays(cat), "stay_id", "v_start", "v_end", F.col("intime"), shift("intime", 1, "day"))
    return hit.select("stay_id", F.lit(1).alias(name))


def oasis(cat: Catalog) -> DataFrame:
    stays = _stays(cat)
    adm = cat.table("admissions").select("hadm_id", "admittime", "admission_type")
    service = F.coalesce(F.lower("curr_service").contains("surg") | (F.col("curr_service") == "ORTHO"), F.lit(False)).cast("int")
    surgical = (cat.table("services").join(stays.select("hadm_id", "stay_id", "intime"), "hadm_id")
                .filter(F.col("transfertime") < shift("intime", 1, "day")).groupBy("stay_id").agg(F.max(service).alias("surgical")))
    d = star_join(_known_patients(cat).join(adm, "hadm_id"), [
        surgical, _first_day_ventilation(cat, "mechvent"), cat.concept("first_day_gcs").select("stay_id", "gcs_min"),
        cat.concept("first_day_vitalsign").select("stay_id", *[f"{v}_{m}" for v in D.OASIS_VITALS for m in ("min", "max")]),
        cat.concept("first_day_urine_output").select("stay_id", "urineoutput")], "stay_id")
    d = d.join(cat.concept("age").select("hadm_id", "age"), "hadm_id", "left").fillna(0, ["surgical", "mechvent"])
    elective = F.when(F.col("admission_type").isNull(), None).when((F.col("admission_type") == "ELECTIVE") & (F.col("surgical") == 1), 1).otherwise(0)
    d = d.withColumn("preiculos", datetime_diff("intime", "admittime", "minute")).withColumn("electivesurgery", elective)
    for vital, rules in D.OASIS_VITALS.items():
        extreme, value_name, _ = D.OASIS_NAMES[vital]
        shown = F.when(F.col(f"{vital}_{extreme}").isNull(), None)
        for test, _points, side in rules:
            shown = shown.when(F.expr(test), F.col(f"{vital}_{side}"))
        d = d.withColumn(value_name, shown.otherwise((F.col(f"{vital}_min") + F.col(f"{vital}_max")) / 2))
    names = [s.name for s in D.OASIS]
    d = add_scores(d, D.OASIS).withColumn("oasis", total(names))
    return d.select("subject_id", "hadm_id", "stay_id", "oasis", logistic(-6.1746 + 0.1275 * F.col("oasis")).alias("oasis_prob"),
                    "age", "age_score", "preiculos", "preiculos_score", F.col("gcs_min").alias("gcs"), "gcs_score", "heartrate", "heart_rate_score",
                    "meanbp", "mbp_score", "resprate", "resp_rate_score", "temp", "temp_score", "urineoutput", "urineoutput_score",
                    "mechvent", "mechvent_score", "electivesurgery", "electivesurgery_score")


def sapsii(cat: Catalog) -> DataFrame:
    """First 24 hours, window (start, start+24h]."""
    stays = _stays(cat).withColumn("endtime", shift("intime", 24, "hour"))
    lo, hi = F.col("intime"), F.col("endtime")
    masks = cat.table("chartevents").filter((F.col("itemid") == D.O2_DEVICE) & F.lower("value").rlike("(cpap mask|bipap)")).select("stay_id", "charttime")
    masks = anchored(masks, stays.select("stay_id", "subject_id", "intime", "endtime"), ["stay_id"], "charttime", "intime", lo, hi, "(]",
                     stay_cols=["subject_id", "intime", "endtime"])
    cpap = masks.groupBy("subject_id", "stay_id").agg(
        F.greatest(shift(F.min("charttime"), -1, "hour"), F.min("intime")).alias("c_start"),
        F.least(shift(F.max("charttime"), 4, "hour"), F.max("endtime")).alias("c_end")).drop("stay_id")
    gas = cat.concept("bg").filter((F.col("specimen") == "ART.") & F.col("pao2fio2ratio").isNotNull()).select("subject_id", "charttime", "pao2fio2ratio")
    gas = anchored(gas, stays, ["subject_id"], "charttime", "intime", lo, hi, "(]", stay_cols=["stay_id"])
    gas = mark_ventilated(cat, gas, "(]")
    gas = interval_join(gas, cpap, ["subject_id"], "charttime", "c_start", "c_end", "(]", "left")
    pf = gas.filter((F.col("vent") == 1) | F.col("c_start").isNotNull()).groupBy("stay_id").agg(F.min("pao2fio2ratio").alias("pao2fio2_vent_min"))

    by_patient = {"vitalsign": {"heart_rate": "heartrate", "sbp": "sysbp", "temperature": "tempc"},
                  "chemistry": {c: c for c in ("bun", "potassium", "sodium", "bicarbonate")},
                  "complete_blood_count": {"wbc": "wbc"}, "enzyme": {"bilirubin_total": "bilirubin"}}
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        cat.concept(t).select("subject_id", "charttime", *[F.col(c).alias(n) for c, n in cols.items()]) for t, cols in by_patient.items()])
    stems = [n for cols in by_patient.values() for n in cols.values()]
    labs = anchored(stacked, stays, ["subject_id"], "charttime", "intime", lo, hi, "(]", stay_cols=["stay_id"])
    labs = labs.groupBy("stay_id").agg(*[f(n).alias(f"{n}_{m}") for n in stems for m, f in (("min", F.min), ("max", F.max))])
    own = cat.concept("gcs").select("stay_id", "charttime", "gcs").unionByName(cat.concept("urine_output"), allowMissingColumns=True)
    own = anchored(own, stays.select("stay_id", "intime", "endtime"), ["stay_id"], "charttime", "intime", lo, hi, "(]")
    own = own.groupBy("stay_id").agg(F.min("gcs").alias("mingcs"), F.sum("urineoutput").alias("urineoutput"))

    services = top1(cat.table("services").select("hadm_id", "transfertime", "curr_service"), ["hadm_id"],
                    [Order("transfertime", nulls_first=True), Order("curr_service")])
    surgical = services.select("hadm_id", F.coalesce(F.lower("curr_service").contains("surg"), F.lit(False)).cast("int").alias("surgical"))
    comorbid = code_flags(cat.table("diagnoses_icd"), ["hadm_id"], D.SAPS_COMORBIDITY)
    d = star_join(stays.join(cat.table("admissions").select("hadm_id", "admission_type"), "hadm_id"), [pf, labs, own], "stay_id")
    d = star_join(d, [cat.concept("age").select("hadm_id", "age"), surgical, comorbid], "hadm_id").fillna(0, ["surgical"])
    cut = F.col("surgical") == 1
    d = d.withColumn("admissiontype", F.when(cut & (F.col("admission_type") == "ELECTIVE"), "ScheduledSurgical")
                     .when(cut & (F.col("admission_type") != "ELECTIVE"), "UnscheduledSurgical").otherwise("Medical"))
    names = [s.name for s in D.SAPS2]
    d = add_scores(d, D.SAPS2).withColumn("sapsii", total(names))
    s = F.col("sapsii")
    return d.select("subject_id", "hadm_id", "stay_id", F.col("intime").alias("starttime"), "endtime", "sapsii",
                    logistic(-7.7631 + 0.0737 * s + 0.9971 * F.log(s + F.lit(1.0))).alias("sapsii_prob"), *names)


def _aps_side(side: str) -> list[RuleScore]:
    """Points of every banded component for the minimum or the maximum."""
    out = []
    for name, (stem, steps, above) in D.APS_BANDS.items():
        c = f"{stem}_{side}"
        rules = list(bands(c, steps, above))
        special = {"resp_rate": [(f"vent = 1 AND {c} < 14", 0)],
                   "creatinine": [(f"arf = 1 AND {c} < 1.5", 0), (f"arf = 1 AND {c} >= 1.5", 10)]}.get(name, [])
        out.append(RuleScore(f"{name}_{side}_pts", tuple(rules[:1] + special + rules[1:])))
    return out


def apsiii(cat: Catalog) -> DataFrame:
    stays = _stays(cat)
    gas = _gases_in_stay(cat, "specimen", "po2", "aado2", "fio2", "fio2_chartevents", "ph", "pco2").filter(F.col("specimen") == "ART.")
    gas = add_scores(mark_ventilated(cat, gas), [D.APS_ACID])
    share = F.coalesce("fio2", "fio2_chartevents")
    room_air = (F.col("vent") == 0) & (F.coalesce(share, F.lit(21)) < 50)
    both = F.col("ph").isNotNull() & F.col("pco2").isNotNull()
    gases = gas.groupBy("stay_id").agg(
        F.max(F.when(room_air, F.col("po2"))).alias("pao2"), F.max(F.when((F.col("vent") == 1) & (share >= 50), F.col("aado2"))).alias("aado2"),
        F.max(F.when(both, F.col("acidbase_score"))).alias("acidbase_score"))
    late = code_flags(cat.table("diagnoses_icd"), ["hadm_id"], {"ckd": D.LATE_KIDNEY_DISEASE})
    lab_cols = [f"{c}_{m}" for c in ("hematocrit", "wbc", "creatinine", "bun", "sodium", "albumin") for m in ("min", "max")]
    labs = cat.concept("first_day_lab").select(
        "stay_id", *lab_cols, F.col("bilirubin_total_min").alias("bilirubin_min"), F.col("bilirubin_total_max").alias("bilirubin_max"),
        F.col("glucose_min").alias("l_glucose_min"), F.col("glucose_max").alias("l_glucose_max"))
    vital = cat.concept("first_day_vitalsign").select(
        "stay_id", *[f"{v}_{m}" for v in ("heart_rate", "mbp", "temperature", "resp_rate") for m in ("min", "max")],
        F.col("glucose_min").alias("v_glucose_min"), F.col("glucose_max").alias("v_glucose_max"))
    d = star_join(_known_patients(cat), [
        gases, _first_day_ventilation(cat, "vent"), cat.concept("first_day_gcs").drop("subject_id"), vital,
        cat.concept("first_day_urine_output").select("stay_id", "urineoutput"), labs], "stay_id")
    d = d.join(late, "hadm_id", "left").fillna(0, ["vent"])
    failing = (F.col("creatinine_max") >= 1.5) & (F.col("urineoutput") < 410) & (F.col("ckd") == 0)
    d = (d.withColumn("arf", F.coalesce(failing, F.lit(False)).cast("int"))
         .withColumn("glucose_max", F.greatest("l_glucose_max", "v_glucose_max")).withColumn("glucose_min", F.least("l_glucose_min", "v_glucose_min")))
    d = add_scores(d, [*_aps_side("min"), *_aps_side("max"), D.APS_URINE, D.APS_GCS, D.APS_OXYGEN])
    for name, (stem, _, _) in D.APS_BANDS.items():
        low_pts, high_pts = f"{name}_min_pts", f"{name}_max_pts"
        if name in D.APS_NORMAL:
            points = worst_of(f"{stem}_min", f"{stem}_max", D.APS_NORMAL[name], low_pts, high_pts).column()
            if name == "creatinine":
                points = F.when(F.col("arf") == 1, F.col(high_pts)).otherwise(points)
        else:
            points = F.col(high_pts)
        d = d.withColumn(f"{name}_score", points)
    d = d.select("stay_id", *D.APS_PARTS)
    out = stays.join(d.withColumn("apsiii", total(D.APS_PARTS)), "stay_id", "left")
    return out.select("subject_id", "hadm_id", "stay_id", "apsiii", logistic(-4.4360 + 0.04726 * F.col("apsiii")).alias("apsiii_prob"), *D.APS_PARTS)


# --- sepsis ----------------------------------------------------------------------------------------
def suspicion_of_infection(cat: Catalog) -> DataFrame:
    """Each antibiotic with the first culture up to 72 h before and up to 24 h after it.

    Cultures with a time are matched by time, cultures with a date only by day; the first culture counts on either side.
    """
    ab = cat.concept("antibiotic").select("subject_id", "hadm_id", "stay_id", "antibiotic", F.col("starttime").alias("antibiotic_time"), "stoptime")
    ab = row_numbers(ab, ["subject_id"], "antibiotic_time", "ab_id", tie=["stoptime", "antibiotic", "stay_id"])
    ab = ab.withColumn("antibiotic_date", trunc_to("antibiotic_time", "DAY"))
    grown = F.col("org_name").isNotNull() & (F.col("org_itemid") != D.NO_GROWTH_ORGANISM) & (F.col("org_name") != "")
    me = cat.table("microbiologyevents").groupBy("micro_specimen_id").agg(
        F.max("subject_id").alias("subject_id"), trunc_to(F.max("chartdate"), "DAY").alias("chartdate"), F.max("charttime").alias("culturetime"),
        F.max("spec_type_desc").alias("specimen"), F.max(F.when(grown, 1).otherwise(0)).alias("positive"))
    me = me.withColumn("at", F.coalesce("culturetime", "chartdate"))
    timed, dated = me.filter(F.col("culturetime").isNotNull()), me.filter(F.col("culturetime").isNull())
    c, d = F.col("culturetime"), F.col("chartdate")
    windows = [
        Alternative(timed, "antibiotic_time", c, shift(c, 72, "hour"), "(]", "before"), Alternative(dated, "antibiotic_date", d, shift(d, 3, "day"), "[]", "before"),
        Alternative(timed, "antibiotic_time", shift(c, -24, "hour"), c, "[)", "after"), Alternative(dated, "antibiotic_date", shift(d, -1, "day"), d, "[]", "after")]
    order = [Order("chartdate", nulls_first=True), Order("culturetime"), Order("micro_specimen_id")]
    out = match_first(ab, ["subject_id", "ab_id"], ["subject_id"], windows, order, {x: x for x in ("at", "specimen", "positive")})
    none = F.col("before_specimen").isNull() & F.col("after_specimen").isNull()
    return out.select(
        "subject_id", "stay_id", "hadm_id", "ab_id", "antibiotic", "antibiotic_time", F.when(none, 0).otherwise(1).alias("suspected_infection"),
        F.when(~none, F.coalesce("before_at", "antibiotic_time")).alias("suspected_infection_time"),
        F.coalesce("before_at", "after_at").alias("culture_time"), F.coalesce("before_specimen", "after_specimen").alias("specimen"),
        F.coalesce("before_positive", "after_positive").alias("positive_culture"))


def sepsis3(cat: Catalog) -> DataFrame:
    """First suspicion of a stay with a score of two or more within 48 h before to 24 h after."""
    parts = {f"{c}_24hours": c for c in D.SOFA_PARTS}
    s = cat.concept("sofa").filter(F.col("sofa_24hours") >= 2).select(
        "stay_id", F.col("endtime").alias("sofa_time"), F.col("sofa_24hours").alias("sofa_score"), *[F.col(k).alias(v) for k, v in parts.items()])
    soi = cat.concept("suspicion_of_infection").filter(F.col("stay_id").isNotNull() & F.col("suspected_infection_time").isNotNull())
    soi = soi.select("subject_id", "stay_id", "antibiotic_time", "culture_time", "suspected_infection_time", "suspected_infection",
                     shift("suspected_infection_time", -48, "hour").alias("w_lo"), shift("suspected_infection_time", 24, "hour").alias("w_hi"))
    hits = interval_join(s, soi, ["stay_id"], "sofa_time", "w_lo", "w_hi").drop("w_lo", "w_hi")
    best = top1(hits, ["stay_id"], [Order(c, nulls_first=True) for c in ("suspected_infection_time", "antibiotic_time", "culture_time", "sofa_time")])
    return best.select("subject_id", "stay_id", "antibiotic_time", "culture_time", "suspected_infection_time", "sofa_time", "sofa_score",
                       *D.SOFA_PARTS, ((F.col("sofa_score") >= 2) & (F.col("suspected_infection") == 1)).alias("sepsis3"))


BUILDERS = {f.__name__: f for f in (
    kdigo_creatinine, kdigo_uo, kdigo_stages, meld, sofa, sirs, lods, oasis, sapsii, apsiii, suspicion_of_infection, sepsis3)}
