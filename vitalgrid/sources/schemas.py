"""Schemas of the base tables and the registry of event tables.

Keys are long, times are timestamps without zone. Fixed values: names and types of the published tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "double": T.DoubleType(), "float": T.FloatType(),
          "string": T.StringType(), "ts": T.TimestampNTZType(), "date": T.DateType()}


def _schema(text: str) -> T.StructType:
    """`type: name name …; type: name …` in column order groups."""
    fields = []
    for group in text.split(";"):
        kind, names = group.split(":")
        fields += [T.StructField(n, _TYPES[kind.strip()]) for n in names.split()]
    return T.StructType(fields)


HOSP = {
    "admissions": "long: subject_id hadm_id; ts: admittime dischtime deathtime; string: admission_type admit_provider_id admission_location "
                  "discharge_location insurance language marital_status race; ts: edregtime edouttime; short: hospital_expire_flag",
    "d_hcpcs": "string: code; short: category; string: long_description short_description",
    "diagnoses_icd": "long: subject_id hadm_id; int: seq_num; string: icd_code; short: icd_version",
    "d_icd_diagnoses": "string: icd_code; short: icd_version; string: long_title",
    "d_icd_procedures": "string: icd_code; short: icd_version; string: long_title",
    "d_labitems": "long: itemid; string: label fluid category",
    "drgcodes": "long: subject_id hadm_id; string: drg_type drg_code description; short: drg_severity drg_mortality",
    "emar_detail": "long: subject_id; string: emar_id; int: emar_seq; string: parent_field_ordinal administration_type; long: pharmacy_id; "
                   "string: barcode_type reason_for_no_barcode complete_dose_not_given dose_due dose_due_unit dose_given dose_given_unit "
                   "will_remainder_of_dose_be_given product_amount_given product_unit product_code product_description product_description_other "
                   "prior_infusion_rate infusion_rate infusion_rate_adjustment infusion_rate_adjustment_amount infusion_rate_unit route "
                   "infusion_complete completion_interval new_iv_bag_hung continued_infusion_in_other_location restart_interval side site "
                   "non_formulary_visual_verification",
    "emar": "long: subject_id hadm_id; string: emar_id; int: emar_seq; string: poe_id; long: pharmacy_id; string: enter_provider_id; ts: charttime; "
            "string: medication event_txt; ts: scheduletime storetime",
    "hcpcsevents": "long: subject_id hadm_id; date: chartdate; string: hcpcs_cd; int: seq_num; string: short_description",
    "labevents": "long: labevent_id subject_id hadm_id specimen_id itemid; string: order_provider_id; ts: charttime storetime; string: value; "
                 "double: valuenum; string: valueuom; double: ref_range_lower ref_range_upper; string: flag priority comments",
    "microbiologyevents": "long: microevent_id subject_id hadm_id micro_specimen_id; string: order_provider_id; ts: chartdate charttime; "
                          "long: spec_itemid; string: spec_type_desc; int: test_seq; ts: storedate storetime; long: test_itemid; string: test_name; "
                          "long: org_itemid; string: org_name; short: isolate_num; string: quantity; long: ab_itemid; "
                          "string: ab_name dilution_text dilution_comparison; double: dilution_value; string: interpretation comments",
    "omr": "long: subject_id; date: chartdate; int: seq_num; string: result_name result_value",
    "patients": "long: subject_id; string: gender; short: anchor_age anchor_year; string: anchor_year_group; date: dod",
    "pharmacy": "long: subject_id hadm_id pharmacy_id; string: poe_id; ts: starttime stoptime; string: medication proc_type status; "
                "ts: entertime verifiedtime; string: route frequency disp_sched infusion_type sliding_scale lockout_interval; float: basal_rate; "
                "string: one_hr_max; float: doses_per_24_hrs duration; string: duration_interval; int: expiration_value; string: expiration_unit; "
                "ts: expirationdate; string: dispensation fill_quantity",
    "poe_detail": "string: poe_id; int: poe_seq; long: subject_id; string: field_name field_value",
    "poe": "string: poe_id; int: poe_seq; long: subject_id hadm_id; ts: ordertime; string: order_type order_subtype transaction_type "
           "discontinue_of_poe_id discontinued_by_poe_id order_provider_id order_status",
    "prescriptions": "long: subject_id hadm_id pharmacy_id; string: poe_id; int: poe_seq; string: order_provider_id; ts: starttime stoptime; "
                     "string: drug_type drug formulary_drug_cd gsn ndc prod_strength form_rx dose_val_rx dose_unit_rx form_val_disp form_unit_disp; "
                     "float: doses_per_24_hrs; string: route",
    "procedures_icd": "long: subject_id hadm_id; int: seq_num; date: chartdate; string: icd_code; short: icd_version",
    "provider": "string: provider_id",
    "services": "long: subject_id hadm_id; ts: transfertime; string: prev_service curr_service",
    "transfers": "long: subject_id hadm_id transfer_id; string: eventtype careunit; ts: intime outtime",
}
ICU = {
    "caregiver": "long: caregiver_id",
    "chartevents": "long: subject_id hadm_id stay_id caregiver_id; ts: charttime storetime; long: itemid; string: value; double: valuenum; "
                   "string: valueuom; short: warning",
    "datetimeevents": "long: subject_id hadm_id stay_id caregiver_id; ts: charttime storetime; long: itemid; ts: value; string: valueuom; short: warning",
    "d_items": "long: itemid; string: label abbreviation linksto category unitname param_type; double: lownormalvalue highnormalvalue",
    "icustays": "long: subject_id hadm_id stay_id; string: first_careunit last_careunit; ts: intime outtime; double: los",
    "ingredientevents": "long: subject_id hadm_id stay_id caregiver_id; ts: starttime endtime storetime; long: itemid; double: amount; string: amountuom; "
                        "double: rate; string: rateuom; long: orderid linkorderid; string: statusdescription; double: originalamount originalrate",
    "inputevents": "long: subject_id hadm_id stay_id caregiver_id; ts: starttime endtime storetime; long: itemid; double: amount; string: amountuom; "
                   "double: rate; string: rateuom; long: orderid linkorderid; string: ordercategoryname secondaryordercategoryname "
                   "ordercomponenttypedescription ordercategorydescription; double: patientweight totalamount; string: totalamountuom; "
                   "short: isopenbag continueinnextdept; string: statusdescription; double: originalamount originalrate",
    "outputevents": "long: subject_id hadm_id stay_id caregiver_id; ts: charttime storetime; long: itemid; double: value; string: valueuom",
    "procedureevents": "long: subject_id hadm_id stay_id caregiver_id; ts: starttime endtime storetime; long: itemid; double: value; "
                       "string: valueuom location locationcategory; long: orderid linkorderid; string: ordercategoryname ordercategorydescription; "
                       "double: patientweight; short: isopenbag continueinnextdept; string: statusdescription; double: ORIGINALAMOUNT ORIGINALRATE",
}
ED = {
    "triage": "long: subject_id stay_id; double: temperature heartrate resprate o2sat sbp dbp; string: pain; double: acuity; string: chiefcomplaint",
}
NOTE = {
    "discharge": "string: note_id; long: subject_id hadm_id; string: note_type; int: note_seq; ts: charttime storetime; string: text",
}
APP = {
    "cohort": "long: cohort_id subject_id hadm_id stay_id",
    "d_cohorts": "long: cohort_id; string: cohort_name cohort_description",
    "customevents": "long: subject_id hadm_id stay_id itemid; ts: charttime; string: value valueuom",
    "d_customevents": "long: itemid; string: label abbreviation author; long: total_row",
    "infection_type": "string: label value; long: count; string: infection_type",
    # optional modules of the database
    **ED, **NOTE,
}
SCHEMAS: dict[str, T.StructType] = {name: _schema(text) for group in (HOSP, ICU, APP) for name, text in group.items()}


@dataclass(frozen=True)
class EventSpec:
    """How one event table is queried: its scope, time and value columns, units, dictionary and usable fields."""

    table: str
    scope: str
    time: str
    value: str
    fields: tuple[str, ...]
    uom: dict[str, str] = field(default_factory=dict)
    dictionary: str | None = None
    end: str | None = None

    def check(self, schema: T.StructType) -> None:
        """Columns named here must exist."""
        missing = [c for c in {self.time, self.value, *self.fields} - {"doses_per_24_hrs"} if c not in schema.names]
        if missing:
            raise ValueError(f"{self.table} lacks {missing}")


_AMOUNT = {"amount": "amountuom", "rate": "rateuom"}
_VALUE = {"value": "valueuom", "valuenum": "valueuom"}
EVENTS: dict[str, EventSpec] = {s.table: s for s in (
    EventSpec("inputevents", "icu", "starttime", "amount", ("amount", "rate"), _AMOUNT, "d_items", "endtime"),
    EventSpec("chartevents", "icu", "charttime", "valuenum", ("value", "valuenum"), _VALUE, "d_items"),
    EventSpec("labevents", "hosp", "charttime", "valuenum", ("value", "valuenum"), _VALUE, "d_labitems"),
    EventSpec("ingredientevents", "icu", "starttime", "amount", ("amount", "rate"), _AMOUNT, "d_items", "endtime"),
    EventSpec("outputevents", "icu", "charttime", "value", ("value",), _VALUE, "d_items"),
    EventSpec("datetimeevents", "icu", "charttime", "value", ("value",), _VALUE, "d_items"),
    EventSpec("procedureevents", "icu", "starttime", "value", ("value", "location"), _VALUE, "d_items", "endtime"),
    EventSpec("microbiologyevents", "hosp", "charttime", "org_name", (), {}, None),
    EventSpec("microbiologyresultsevents", "public", "charttime", "value", ("value", "valuenum"), _VALUE, None),
    EventSpec("prescriptions", "hosp", "starttime", "dose_val_rx", ("dose_val_rx", "doses_per_24_hrs"), {"dose_val_rx": "dose_unit_rx"}, "d_prescriptions", "stoptime"),
    EventSpec("customevents", "public", "charttime", "value", ("value",), _VALUE, "d_customevents"),
    EventSpec("demographics", "public", "charttime", "value", ("value",), _VALUE, None),
)}
