"""One query per derived table."""

from __future__ import annotations

from ..concepts.firstday import VITAL_COLUMNS
from .dag import CONCEPTS
from .registry import catalog, query

# columns with a floating sum, a logarithm or a power behind them
ROUNDED: dict[str, dict[str, int]] = {
    "age": {"age": 6},
    "icustay_detail": {"los_hospital": 6, "admission_age": 6},
    "bg": {"aado2_calc": 6, "pao2fio2ratio": 6},
    "creatinine_baseline": {"age": 6, "mdrd_est": 6, "scr_baseline": 6},
    "vitalsign": {c: 6 for c in ("heart_rate", "sbp", "dbp", "mbp", "sbp_ni", "dbp_ni", "mbp_ni", "resp_rate", "spo2", "glucose")},
    "urine_output": {"urineoutput": 6},
    "urine_output_rate": {c: 6 for c in ("uo", "urineoutput_6hr", "urineoutput_12hr", "urineoutput_24hr")},
    "kdigo_uo": {c: 6 for c in ("urineoutput_6hr", "urineoutput_12hr", "urineoutput_24hr", "uo_tm_6hr", "uo_tm_12hr", "uo_tm_24hr")},
    "kdigo_creatinine": {c: 6 for c in ("creat", "creat_low_past_48hr", "creat_low_past_7day")},
    "kdigo_stages": {c: 6 for c in ("creat", "creat_low_past_48hr", "creat_low_past_7day")},
    "first_day_bg": {f"{c}_{m}": 6 for c in ("aado2_calc", "pao2fio2ratio") for m in ("min", "max")},
    "first_day_bg_art": {f"{c}_{m}": 6 for c in ("aado2_calc", "pao2fio2ratio") for m in ("min", "max")},
    "first_day_weight": {"weight_admit": 6, "weight": 6},
    "first_day_urine_output": {"urineoutput": 6},
    "first_day_vitalsign": {f"{c}_{m}": 6 for c in VITAL_COLUMNS for m in ("min", "max", "mean")},
    "phenylephrine": {"vaso_rate": 6},
    "vasoactive_agent": {"phenylephrine": 6, "norepinephrine": 6, "vasopressin": 6},
    "meld": {"meld_initial": 6, "meld": 6},
    "sofa": {c: 6 for c in ("pao2fio2ratio_novent", "pao2fio2ratio_vent", "meanbp_min", "uo_24hr", "rate_norepinephrine")},
    "oasis": {c: 6 for c in ("oasis_prob", "age", "preiculos", "heartrate", "meanbp", "resprate", "temp", "urineoutput")},
    "sapsii": {"sapsii_prob": 6},
    "apsiii": {"apsiii_prob": 6},
}


def _register(name: str) -> None:
    @query(name, f"SELECT * FROM v_{name}", ROUNDED.get(name))
    def build(spark, folder):
        return catalog(spark, folder).concept(name)


for _name in CONCEPTS:
    _register(_name)
