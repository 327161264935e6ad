"""Derived tables: builders, what each one reads, and a build in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from ..concepts import firstday, measurements, scores, treatments
from ..operators import cohort, events
from ..sources.catalog import Catalog

CONCEPTS: dict[str, Callable[[Catalog], DataFrame]] = {
    **measurements.BUILDERS, **treatments.BUILDERS, **firstday.BUILDERS, **scores.BUILDERS}


def event_source(cat: Catalog, subject: int | None = None) -> Callable[[str], DataFrame]:
    """Tables by name for the event operators: the stored views where there is one, else the base table.

    For one patient the demographics, which rest on all scores, are built from that patient's rows unless they are there already.
    """
    own = cat if subject is None or cat.built("demographics") else cat.of_patient(subject)
    return lambda name: (own if name == "demographics" else cat).concept(name) if name in VIEWS else cat.table(name)


# stored views of the event layer
VIEWS: dict[str, Callable[[Catalog], DataFrame]] = {
    "d_prescriptions": lambda cat: events.d_prescriptions(cat.table("prescriptions")),
    "microbiologyresultsevents": lambda cat: events.microbiology_results(cat.table("microbiologyevents")),
    "positive_microbiology": lambda cat: events.positive_microbiology(cat.concept("microbiologyresultsevents"), cat.table("infection_type")),
    "demographics": lambda cat: events.demographics(cat.table, cat.concept),
    "uid_list": lambda cat: events.uid_list(cat.table("patients"), cat.table("admissions"), cat.table("icustays")),
    "distinct_events": lambda cat: events.distinct_events(
        cat.table("d_items"), cat.table("d_labitems"), cat.concept("microbiologyresultsevents"), cat.concept("d_prescriptions"),
        cat.concept("demographics"), cat.table("d_customevents")),
    "event_catalogue": lambda cat: cohort.event_catalogue(events.unify_events(event_source(cat), ordered=False)),
}
BUILDERS: dict[str, Callable[[Catalog], DataFrame]] = {**CONCEPTS, **VIEWS}

_VASO = ("norepinephrine", "epinephrine", "dobutamine", "dopamine")
_LABS = ("complete_blood_count", "chemistry", "blood_differential", "coagulation", "enzyme")

# derived tables read by each derived table
DEPENDENCIES: dict[str, tuple[str, ...]] = {
    "icustay_hourly": ("icustay_times",),
    "creatinine_baseline": ("age", "chemistry"),
    "urine_output_rate": ("urine_output", "weight_durations"),
    "kdigo_uo": ("urine_output", "weight_durations"),
    "charlson": ("age",),
    "norepinephrine_equivalent_dose": ("vasoactive_agent",),
    "ventilation": ("ventilator_setting", "oxygen_delivery"),
    "first_day_bg": ("bg",),
    "first_day_bg_art": ("bg",),
    "first_day_gcs": ("gcs",),
    "first_day_height": ("height",),
    "first_day_weight": ("weight_durations",),
    "first_day_lab": _LABS,
    "first_day_rrt": ("rrt",),
    "first_day_urine_output": ("urine_output",),
    "first_day_vitalsign": ("vitalsign",),
    "first_day_sofa": (*_VASO, "bg", "ventilation", "first_day_vitalsign", "first_day_lab", "first_day_urine_output", "first_day_gcs"),
    "kdigo_stages": ("kdigo_creatinine", "kdigo_uo", "crrt"),
    "meld": ("first_day_lab", "first_day_rrt"),
    "sofa": ("icustay_times", "icustay_hourly", "bg", "ventilation", "vitalsign", "gcs", "enzyme", "chemistry", "complete_blood_count",
             "urine_output_rate", *_VASO),
    "sirs": ("first_day_bg_art", "first_day_vitalsign", "first_day_lab"),
    "lods": ("bg", "ventilation", "first_day_gcs", "first_day_vitalsign", "first_day_urine_output", "first_day_lab"),
    "oasis": ("ventilation", "age", "first_day_gcs", "first_day_vitalsign", "first_day_urine_output"),
    "sapsii": ("bg", "ventilation", "gcs", "vitalsign", "urine_output", "chemistry", "complete_blood_count", "enzyme", "age"),
    "apsiii": ("bg", "ventilation", "first_day_urine_output", "first_day_lab", "first_day_gcs", "first_day_vitalsign"),
    "suspicion_of_infection": ("antibiotic",),
    "sepsis3": ("sofa", "suspicion_of_infection"),
    "positive_microbiology": ("microbiologyresultsevents",),
    "demographics": ("age", "charlson", "height", "first_day_weight", "sapsii", "sofa"),
    "distinct_events": ("microbiologyresultsevents", "d_prescriptions", "demographics"),
    "event_catalogue": ("d_prescriptions", "demographics"),
}

# read by three or more tables, or expensive: written once by a catalog that shares them
SHARED = ("bg", "ventilation", "vitalsign", "gcs", "urine_output", "weight_durations", "chemistry", "complete_blood_count", "enzyme",
          "first_day_lab", "first_day_vitalsign", "first_day_gcs", "first_day_urine_output", "urine_output_rate", "sofa", "antibiotic", "demographics", "d_prescriptions", "sapsii", "charlson", "age")

# column a stored table is clustered by, so that star joins and stay filters touch few files
CLUSTER = ("stay_id", "hadm_id", "subject_id", "specimen_id")


def build_order(names: Iterable[str]) -> list[str]:
    """The named tables and all they need, every table after its inputs."""
    needed: dict[str, tuple[str, ...]] = {}
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in BUILDERS:
            raise KeyError(name)
        if name not in needed:
            needed[name] = DEPENDENCIES.get(name, ())
            todo += needed[name]
    return list(TopologicalSorter(needed).static_order())


def build_concepts(spark: SparkSession, base: Callable[[str], DataFrame], out: str, names: Iterable[str] | None = None,
                   builders: Mapping[str, Callable[[Catalog], DataFrame]] | None = None) -> dict[str, str]:
    """Write the named derived tables (all by default) under `out`, each read back by its dependants.

    Returns the path of every table. A table is clustered by its most specific key.
    """
    builders = dict(builders or BUILDERS)
    paths: dict[str, str] = {}

    def stored(name: str) -> DataFrame | None:
        return spark.read.parquet(paths[name]) if name in paths else None
    cat = Catalog(spark, base, builders, prebuilt=stored)
    for name in build_order(names or builders):
        df = builders[name](cat)
        key = next((c for c in CLUSTER if c in df.columns), None)
        path = f"{out.rstrip('/')}/{name}"
        # ranges, not hashes, of (key, time): a heavy key is spread over several files
        order = [c for c in (key, "charttime", "starttime", "hr") if c and c in df.columns]
        (df.repartitionByRange(*order) if order else df).write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths
