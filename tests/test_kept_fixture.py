"""Tables that most clinical queries rest on are parsed once, and aggregates stay narrow enough to be compiled."""

from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from vitalgrid.plans.dag import BUILDERS, SHARED
from vitalgrid.plans.registry import all_queries, catalog
from vitalgrid.sources.catalog import Catalog
from vitalgrid.sources.fixtures import StayFixture


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    start = datetime.datetime(2024, 1, 3)
    # more events a user than slots, a user without number, an event without properties
    rows = [(i, start + datetime.timedelta(minutes=97 * (i % 40)), None if i == 11 else i % 9, "x", float(i), None if i == 23 else f'{{"k": {i * 7 % 100}}}') for i in range(240)]
    root = str(tmp_path_factory.mktemp("kept"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{root}/events.parquet")
    return root


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", ["patients", "admissions", "icustays", "chartevents", "labevents", "inputevents", "outputevents", "procedureevents", "datetimeevents",
                                  "microbiologyevents", "prescriptions", "diagnoses_icd", "services", "transfers", "customevents"])
def test_kept_tables_equal_those_from_the_source(spark, folder, name):
    kept, direct = catalog(spark, folder).table(name), StayFixture(spark, folder)(name)
    assert not any("events.parquet" in f for f in kept.inputFiles())
    assert kept.columns == direct.columns and plain(kept) == plain(direct)


def test_first_day_labs_are_reduced_by_narrow_aggregates(spark, folder):
    cat = Catalog(spark, StayFixture(spark, folder), BUILDERS, SHARED)
    df = cat.concept("first_day_lab")
    plan = BUILDERS["first_day_lab"](cat)._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(re.findall(r"\b(?:min|max)\(", line)) for line in plan.splitlines() if "Aggregate" in line) <= 24
    labs, stays = StayFixture(spark, folder)("labevents"), StayFixture(spark, folder)("icustays")
    day = F.make_dt_interval(F.lit(1))
    near = labs.filter("itemid = 50912 AND valuenum <= 150").select("subject_id", "charttime", "valuenum").join(stays, "subject_id")
    want = near.filter((F.col("charttime") >= F.col("intime") - day / 4) & (F.col("charttime") <= F.col("intime") + day)).groupBy("stay_id").agg(F.max("valuenum").alias("most"))
    want = {r["stay_id"]: r["most"] for r in want.collect()}
    got = {r["stay_id"]: r["creatinine_max"] for r in df.filter("stay_id IS NOT NULL").collect()}
    assert len(got) == 9 and any(want.values()) and got == {s: want.get(s) for s in got}


def test_tables_above_a_small_bound_are_not_sent_through_the_driver(spark, folder):
    all_queries()["uid_list"](spark, folder)
    # 400,000 points are about 3 MB stored: by the default threshold they are broadcast
    spark.range(400_000).select("id", F.xxhash64("id").alias("x")).write.mode("overwrite").parquet(f"{folder}/points")
    spark.range(4_000_000).select("id").write.mode("overwrite").parquet(f"{folder}/others")
    joined = spark.read.parquet(f"{folder}/others").join(spark.read.parquet(f"{folder}/points"), "id")
    assert joined.count() == 400_000 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
