"""First-day summaries: one row per stay over a window around its start."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import join_distinct, round_dec, shift
from ..operators.joins import anchored, star_join
from ..operators.scoring import add_scores, total
from ..operators.sums import BINADE, binade, exact_count, exact_sum, partial_sums
from ..operators.windows import Order, top1
from ..sources.catalog import Catalog
from . import definitions as D

GAS_COLUMNS = ("lactate", "ph", "so2", "po2", "pco2", "aado2", "aado2_calc", "pao2fio2ratio", "baseexcess", "bicarbonate", "totalco2",
               "hematocrit", "hemoglobin", "carboxyhemoglobin", "methemoglobin", "temperature", "chloride", "calcium", "glucose",
               "potassium", "sodium")
VITAL_COLUMNS = ("heart_rate", "sbp", "dbp", "mbp", "resp_rate", "temperature", "spo2", "glucose")
# source table -> (output stem, source column)
LAB_COLUMNS: dict[str, tuple[tuple[str, str], ...]] = {
    "complete_blood_count": (("hematocrit", "hematocrit"), ("hemoglobin", "hemoglobin"), ("platelets", "platelet"), ("wbc", "wbc")),
    "chemistry": tuple((c, c) for c in ("albumin", "globulin", "total_protein", "aniongap", "bicarbonate", "bun", "calcium", "chloride",
                                        "creatinine", "glucose", "sodium", "potassium")),
    "blood_differential": (
        ("abs_basophils", "basophils_abs"), ("abs_eosinophils", "eosinophils_abs"), ("abs_lymphocytes", "lymphocytes_abs"),
        ("abs_monocytes", "monocytes_abs"), ("abs_neutrophils", "neutrophils_abs"), ("atyps", "atypical_lymphocytes"), ("bands", "bands"),
        ("imm_granulocytes", "immature_granulocytes"), ("metas", "metamyelocytes"), ("nrbc", "nrbc")),
    "coagulation": tuple((c, c) for c in ("d_dimer", "fibrinogen", "thrombin", "inr", "pt", "ptt")),
    "enzyme": tuple((c, c) for c in ("alt", "alp", "ast", "amylase", "bilirubin_total", "bilirubin_direct", "bilirubin_indirect", "ck_cpk",
                                     "ck_mb", "ggt", "ld_ldh")),
}
LAB_STEMS = tuple(stem for cols in LAB_COLUMNS.values() for stem, _ in cols)


def anchored_summary(cat: Catalog, points: DataFrame, key: Sequence[str], aggs: Sequence[Column], ts: str = "charttime",
                     low: Column | None = None, high: Column | None = None, bounds: str = "[]") -> DataFrame:
    """Aggregates of the points in each stay's window, joined to all stays.

    Default window: six hours before to one day after the start of the stay.
    """
    stays = cat.table("icustays").select("subject_id", "hadm_id", "stay_id", "intime", "outtime")
    low = shift("intime", -6, "hour") if low is None else low
    high = shift("intime", 1, "day") if high is None else high
    inside = anchored(points, stays, key, ts, "intime", low, high, bounds, stay_cols=["stay_id"])
    return stays.select("subject_id", "stay_id").join(inside.groupBy("stay_id").agg(*aggs), "stay_id", "left")


def extremes(cols: Sequence[str], fns: Sequence[str] = ("min", "max")) -> list[Column]:
    f = {"min": F.min, "max": F.max, "mean": F.avg}
    return [f[fn](c).alias(f"{c}_{fn}") for c in cols for fn in fns]


def first_day_bg(cat: Catalog) -> DataFrame:
    return anchored_summary(cat, cat.concept("bg").select("subject_id", "charttime", *GAS_COLUMNS), ["subject_id"], extremes(GAS_COLUMNS))


def first_day_bg_art(cat: Catalog) -> DataFrame:
    art = cat.concept("bg").filter(F.col("specimen") == "ART.").select("subject_id", "charttime", *GAS_COLUMNS)
    return anchored_summary(cat, art, ["subject_id"], extremes(GAS_COLUMNS))


def first_day_gcs(cat: Catalog) -> DataFrame:
    """The row of the lowest score; equal scores take the earliest."""
    stays = cat.table("icustays").select("subject_id", "stay_id", "intime")
    g = anchored(cat.concept("gcs").drop("subject_id"), stays.drop("subject_id"), ["stay_id"], "charttime", "intime",
                 shift("intime", -6, "hour"), shift("intime", 1, "day"))
    low = top1(g, ["stay_id"], [Order("gcs", nulls_first=True), Order("charttime")])
    return stays.select("subject_id", "stay_id").join(
        low.select("stay_id", F.col("gcs").alias("gcs_min"), "gcs_motor", "gcs_verbal", "gcs_eyes", "gcs_unable"), "stay_id", "left")


def first_day_height(cat: Catalog) -> DataFrame:
    h = cat.concept("height").filter(F.col("stay_id").isNotNull()).select("stay_id", "charttime", "height")
    return anchored_summary(cat, h, ["stay_id"], [round_dec(F.avg("height"), 2).alias("height")])


def first_day_weight(cat: Catalog) -> DataFrame:
    """Weights that start before the end of the first day; there is no lower bound."""
    w = cat.concept("weight_durations").select("stay_id", "starttime", "weight", "weight_type")
    stays = cat.table("icustays").select("subject_id", "stay_id", "intime")
    inside = w.join(stays.select("stay_id", "intime"), "stay_id").filter(F.col("starttime") <= shift("intime", 1, "day"))
    # the means become decimal text downstream, where the last bit of a plain sum shows
    parts = inside.withColumn(BINADE, binade("weight")).groupBy("stay_id", "weight_type", BINADE).agg(
        *partial_sums("weight"), F.min("weight").alias("low"), F.max("weight").alias("high"))
    admit = F.col("weight_type") == "admit"
    agg = parts.groupBy("stay_id").agg(
        (exact_sum(admit) / exact_count(admit)).alias("weight_admit"), (exact_sum() / exact_count()).alias("weight"),
        F.min("low").alias("weight_min"), F.max("high").alias("weight_max"))
    return stays.select("subject_id", "stay_id").join(agg, "stay_id", "left")


def first_day_lab(cat: Catalog) -> DataFrame:
    """Extremes of five laboratory tables, each reduced to a row a stay by itself.

    One aggregate of all 76 extremes over the stacked rows gives code too long for the JVM to compile.
    """
    stays = cat.table("icustays").select("subject_id", "stay_id", "intime")
    low, high = shift("intime", -6, "hour"), shift("intime", 1, "day")
    parts = []
    for table, cols in LAB_COLUMNS.items():
        points = cat.concept(table).select("subject_id", "charttime", *[F.col(c).alias(stem) for stem, c in cols])
        inside = anchored(points, stays, ["subject_id"], "charttime", "intime", low, high, stay_cols=["stay_id"])
        parts.append(inside.groupBy("stay_id").agg(*extremes([stem for stem, _ in cols])))
    return star_join(stays.select("subject_id", "stay_id"), parts, "stay_id").select("subject_id", "stay_id", *[f"{c}_{m}" for c in LAB_STEMS for m in ("min", "max")])


def first_day_rrt(cat: Catalog) -> DataFrame:
    return anchored_summary(cat, cat.concept("rrt"), ["stay_id"], [
        F.max("dialysis_present").alias("dialysis_present"), F.max("dialysis_active").alias("dialysis_active"),
        join_distinct("dialysis_type").alias("dialysis_type")])


def first_day_urine_output(cat: Catalog) -> DataFrame:
    return anchored_summary(cat, cat.concept("urine_output"), ["stay_id"], [F.sum("urineoutput").alias("urineoutput")], low=F.col("intime"))


def first_day_vitalsign(cat: Catalog) -> DataFrame:
    v = cat.concept("vitalsign").select("stay_id", "charttime", *VITAL_COLUMNS)
    return anchored_summary(cat, v, ["stay_id"], extremes(VITAL_COLUMNS, ("min", "max", "mean")))


def invasive_episodes(cat: Catalog) -> DataFrame:
    return cat.concept("ventilation").filter(F.col("ventilation_status") == "InvasiveVent").select(
        "stay_id", F.col("starttime").alias("v_start"), F.col("endtime").alias("v_end"))


def mark_ventilated(cat: Catalog, points: DataFrame, bounds: str = "[]") -> DataFrame:
    """0/1 column `vent`: the point lies in an invasive ventilation episode of its stay."""
    from ..operators.joins import interval_join
    eps = invasive_episodes(cat)
    hit = interval_join(points, eps, ["stay_id"], "charttime", "v_start", "v_end", bounds, "left")
    keys = list(points.columns)
    return hit.select(*keys, F.col("v_start").isNotNull().cast("int").alias("vent"))


def first_day_sofa(cat: Catalog) -> DataFrame:
    stays = cat.table("icustays").select("subject_id", "hadm_id", "stay_id", "intime")
    drugs = ("norepinephrine", "epinephrine", "dopamine", "dobutamine")
    runs = reduce(DataFrame.unionByName, [
        cat.concept(d).select("stay_id", "starttime", F.lit(d).alias("drug"), "vaso_rate") for d in drugs])
    lo, hi = shift("intime", -6, "hour"), shift("intime", 1, "day")
    near = anchored(runs, stays.select("stay_id", "intime"), ["stay_id"], "starttime", "intime", lo, hi)
    rates = near.groupBy("stay_id").agg(*[F.max(F.when(F.col("drug") == d, F.col("vaso_rate"))).alias(f"rate_{d}") for d in drugs])
    gas = cat.concept("bg").filter(F.col("pao2fio2ratio").isNotNull()).select("subject_id", "charttime", "pao2fio2ratio")
    gas = anchored(gas, stays, ["subject_id"], "charttime", "intime", lo, hi, stay_cols=["stay_id"])
    gas = mark_ventilated(cat, gas).groupBy("stay_id").agg(
        F.min(F.when(F.col("vent") == 0, F.col("pao2fio2ratio"))).alias("pao2fio2ratio_novent"),
        F.min(F.when(F.col("vent") == 1, F.col("pao2fio2ratio"))).alias("pao2fio2ratio_vent"))
    d = star_join(stays.drop("intime"), [
        rates, gas,
        cat.concept("first_day_vitalsign").select("stay_id", F.col("mbp_min").alias("meanbp_min")),
        cat.concept("first_day_lab").select("stay_id", "creatinine_max", F.col("bilirubin_total_max").alias("bilirubin_max"),
                                            F.col("platelets_min").alias("platelet_min")),
        cat.concept("first_day_urine_output").select("stay_id", F.col("urineoutput").alias("uo_24hr")),
        cat.concept("first_day_gcs").select("stay_id", "gcs_min")], "stay_id")
    d = add_scores(d, D.FIRST_DAY_SOFA)
    return d.select("subject_id", "hadm_id", "stay_id", total(D.SOFA_PARTS).alias("sofa"), *D.SOFA_PARTS)


BUILDERS = {f.__name__: f for f in (
    first_day_bg, first_day_bg_art, first_day_gcs, first_day_height, first_day_weight, first_day_lab, first_day_rrt, first_day_urine_output,
    first_day_vitalsign, first_day_sofa)}
