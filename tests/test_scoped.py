"""Results for one patient, or for names alone, do not build the scores of all patients."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import events as E
from vitalgrid.plans.dag import BUILDERS, SHARED, event_source
from vitalgrid.sources.catalog import Catalog
from vitalgrid.sources.fixtures import StayFixture


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve stays of three patients with four events a day."""
    path = str(tmp_path_factory.mktemp("scoped"))
    start = dt.datetime(2024, 1, 1)
    rows = [(u * 1000 + i, start + dt.timedelta(hours=6 * i, seconds=37 * u), u, "view", float(i % 90), '{"k": %d}' % ((i * 7 + u) % 100)) for u in range(12) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def refuse(name):
    def build(cat):
        raise AssertionError(f"{name} of all patients")
    return build


def test_item_names_need_no_scores(spark, folder):
    scores = ("sofa", "sapsii", "charlson", "first_day_weight", "demographics")
    cat = Catalog(spark, StayFixture(spark, folder), {**BUILDERS, **{n: refuse(n) for n in scores}}, SHARED)
    got = {tuple(r) for r in E.demographic_items(cat.table, cat.concept).collect()}
    whole = Catalog(spark, StayFixture(spark, folder), BUILDERS, SHARED).concept("demographics").select("itemid", "label", "valueuom").distinct()
    assert got == {tuple(r) for r in whole.collect()} and len(got) == 14


def test_one_admission_builds_one_patient(spark, folder):
    cat = Catalog(spark, StayFixture(spark, folder), BUILDERS, SHARED)
    got = E.unify_events(event_source(cat, 2), subject=2, hadm=5, stay=10).filter(F.col("linksto") == "demographics").collect()
    assert not cat.built("demographics") and not cat.built("sofa")
    want = E.unify_events(event_source(cat), subject=2, hadm=5, stay=10).filter(F.col("linksto") == "demographics").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_merged_partitions_stay_small(spark, folder):
    """Registered queries merge shuffled partitions to 16 MB at most, also in sessions built elsewhere."""
    from vitalgrid.plans.registry import all_queries
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64MB")
        all_queries()["icustay_times"](spark, folder)
        assert spark.conf.get(key) == "16MB"
    finally:
        spark.conf.set(key, before)
