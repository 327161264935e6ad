"""Scores of made-up patients, worked out by hand from the published rules and not from the library's tables of rules."""
import datetime as dt

import pytest

from vitalgrid.concepts import scores, treatments
from vitalgrid.sources.catalog import Catalog

T0 = dt.datetime(2024, 1, 1)


def h(n):
    return T0 + dt.timedelta(hours=n)


@pytest.fixture
def world(spark):
    """world(base tables, derived tables) -> catalog; tables are (rows, schema)."""
    def make(base, derived):
        frames = {n: spark.createDataFrame(rows, kind) for n, (rows, kind) in {**base, **derived}.items()}
        return Catalog(spark, lambda n: frames[n], {}, prebuilt=lambda n: frames.get(n) if n in derived else None)
    return make


def test_charlson_by_hand(spark, world):
    codes = {
        # no codes at all; age 50, 51, 71, 81
        1: (50.0, [], 0), 2: (51.0, [], 1), 3: (71.0, [], 3), 4: (81.0, [], 4),
        # old infarction 1, heart failure 1, age 61 gives 2
        5: (61.0, [("I252", 10), ("42822", 9)], 4),
        # diabetes with complications counts 2 and hides the one without
        6: (40.0, [("E1121", 10), ("E119", 10)], 2), 7: (40.0, [("25000", 9)], 1),
        # severe liver disease 3 hides the mild one; renal 2
        8: (40.0, [("K7210", 10), ("K703", 10), ("N186", 10)], 5), 9: (40.0, [("5712", 9)], 1),
        # metastases 6 hide the tumour; AIDS 6; the same code in the other version is another disease or none
        10: (40.0, [("C780", 10), ("C50", 10)], 6), 11: (40.0, [("C500", 10)], 2), 12: (40.0, [("042", 9)], 6), 13: (40.0, [("042", 10), ("C780", 9)], 0),
        # hemiplegia 2, dementia 1, ulcer 1, rheumatic 1, lung 1, stroke 1, vessels 1, repeated codes count once
        14: (40.0, [("G811", 10), ("F03", 10), ("K250", 10), ("M05", 10), ("J44", 10), ("I63", 10), ("I70", 10), ("I63", 10)], 8)}
    cat = world({"admissions": ([(i, i * 10) for i in codes], "subject_id long, hadm_id long"),
                 "diagnoses_icd": ([(i, i * 10, c, v) for i, (_, found, _) in codes.items() for c, v in found], "subject_id long, hadm_id long, icd_code string, icd_version int")},
                {"age": ([(i * 10, a) for i, (a, _, _) in codes.items()], "hadm_id long, age double")})
    got = {r["subject_id"]: r["charlson_comorbidity_index"] for r in treatments.charlson(cat).collect()}
    assert got == {i: want for i, (_, _, want) in codes.items()}


STAYS = ([(s, s, s, T0, h(72)) for s in range(1, 8)], "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz")


def test_sirs_by_hand(world):
    # temperature below 36 or above 38, pulse above 90, breaths above 20 or carbon dioxide below 32, white cells below 4, above 12 or bands above 10
    vital = [(1, 36.0, 38.0, 90.0, 20.0), (2, 35.9, 37.0, 91.0, 21.0), (3, 36.5, 38.1, 80.0, 18.0), (4, 36.5, 37.0, 80.0, 18.0), (5, 35.0, 39.0, 140.0, 40.0), (6, None, None, None, None)]
    gas = [(1, 32.0), (4, 31.9), (5, 50.0)]
    lab = [(1, 4.0, 12.0, 10.0), (2, 3.9, 8.0, None), (3, 5.0, 12.1, None), (4, 5.0, 9.0, 11.0), (5, 2.0, 30.0, 20.0)]
    cat = world({"icustays": STAYS}, {"first_day_bg_art": (gas, "stay_id long, pco2_min double"), "first_day_vitalsign": (vital, "stay_id long, temperature_min double, temperature_max double, heart_rate_max double, resp_rate_max double"),
                                      "first_day_lab": (lab, "stay_id long, wbc_min double, wbc_max double, bands_max double")})
    assert {r["stay_id"]: r["sirs"] for r in scores.sirs(cat).collect()} == {1: 0, 2: 4, 3: 2, 4: 2, 5: 4, 6: 0, 7: 0}


def test_kidney_stages_by_hand(world):
    # creatinine against the lowest of 7 days: 1.5 times is stage 1, twice 2, three times 3; 0.3 above that of 48 hours 1; 4.0 with either of the small rises 3
    creat = [(1, h(1), 1.0, 1.0, 1.0), (2, h(1), 1.5, 1.4, 1.0), (3, h(1), 2.0, 2.0, 1.0), (4, h(1), 3.0, 3.0, 1.0), (5, h(1), 1.3, 1.0, 1.2), (6, h(1), 4.0, 3.5, 3.5), (7, h(1), 4.0, 3.9, 3.9)]
    uo = "stay_id long, charttime timestamp_ntz, weight double, uo_rt_6hr double, uo_rt_12hr double, uo_rt_24hr double, uo_tm_6hr double, uo_tm_12hr double, uo_tm_24hr double"
    cat = world({"icustays": STAYS}, {"kdigo_creatinine": ([(s, s, t, c, two, seven) for s, t, c, two, seven in creat], "hadm_id long, stay_id long, charttime timestamp_ntz, creat double, creat_low_past_48hr double, creat_low_past_7day double"),
                                      "kdigo_uo": ([], uo), "crrt": ([(1, h(9), "CVVH")], "stay_id long, charttime timestamp_ntz, crrt_mode string")})
    got = {(r["stay_id"], r["charttime"]): (r["aki_stage"], r["aki_stage_smoothed"]) for r in scores.kdigo_stages(cat).collect()}
    assert {s: got[s, h(1)][0] for s in range(1, 8)} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 1, 6: 3, 7: 0}
    assert got[1, h(9)] == (3, 3)  # dialysis
