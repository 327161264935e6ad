import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitalgrid.plans.dag import BUILDERS, DEPENDENCIES, build_concepts, build_order
from vitalgrid.sources import io
from vitalgrid.sources.catalog import Catalog
from vitalgrid.sources.fixtures import StayFixture
from vitalgrid.sources.schemas import APP, EVENTS, HOSP, ICU, SCHEMAS

SMALL = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def test_schema_registry():
    assert len(HOSP) == 22 and len(ICU) == 9 and len(SCHEMAS) == 31 + len(APP)
    assert SCHEMAS["icustays"]["stay_id"].dataType.typeName() == "long" and SCHEMAS["chartevents"]["charttime"].dataType.typeName() == "timestamp_ntz"
    for name in ("chartevents", "labevents", "inputevents", "procedureevents", "outputevents", "customevents", "prescriptions"):
        EVENTS[name].check(SCHEMAS[name])


def test_csv_folder(spark, tmp_path):
    (tmp_path / "hosp").mkdir()
    (tmp_path / "hosp" / "diagnoses_icd.csv").write_text("hadm_id,subject_id,seq_num,icd_code,icd_version\n2,1,1,4280   ,9\n")
    (tmp_path / "hosp" / "notes.txt").write_text("x")
    (tmp_path / "icu").mkdir()
    (tmp_path / "icu" / "outputevents.csv").write_text("subject_id,hadm_id,stay_id,charttime,itemid,value,valueuom\n1,2,3,2024-01-01 05:00:00,226559,10.5,mL\n")
    t = io.load_csv_dir(spark, str(tmp_path))
    assert set(t) == {"diagnoses_icd", "outputevents"}
    dx = t["diagnoses_icd"].first()
    assert (dx.subject_id, dx.hadm_id, dx.icd_code, dx.icd_version) == (1, 2, "4280", 9)
    row = t["outputevents"].first()
    assert row.charttime == dt.datetime(2024, 1, 1, 5) and row.value == 10.5 and row.caregiver_id is None
    io.store_tables(t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "outputevents")).count() == 1


def test_csv_quotes_and_broken_records(spark, tmp_path):
    (tmp_path / "hosp").mkdir()
    path = tmp_path / "hosp" / "labevents.csv"
    head = "labevent_id,charttime,valuenum,comments,extra\n"
    path.write_text(head + '1,2024-01-01 05:00:00,1.5,"a ""b, c"" d",x\n2,,,"two\nlines",\n')
    rows = {r.labevent_id: r for r in io.load_csv_dir(spark, str(tmp_path))["labevents"].collect()}
    assert len(rows) == 2 and rows[1].comments == 'a "b, c" d' and rows[1].valuenum == 1.5 and rows[1].itemid is None
    assert rows[2].comments == "two\nlines" and rows[2].valuenum is None and rows[2].charttime is None
    for bad in ("3,not a time,1,c,x\n", "3,2024-01-01 05:00:00,one,c,x\n", "3,2024-01-01 05:00:00,1,c,x,more\n"):
        path.write_text(head + "1,2024-01-01 05:00:00,1.5,c,x\n" + bad)
        with pytest.raises(ValueError, match="1 broken"):
            io.load_csv_dir(spark, str(tmp_path))
        assert io.load_csv_dir(spark, str(tmp_path), on_error="null")["labevents"].count() == 2
    (tmp_path / "hosp" / "unknown_table.csv").write_text("a,b\n1,2\n")
    path.write_text(head)
    with pytest.raises(ValueError, match="no schema"):
        io.load_csv_dir(spark, str(tmp_path))
    assert io.load_csv_dir(spark, str(tmp_path), on_error="null")["unknown_table"].first().b == "2"


def test_coerce_timestamps_keeps_hopeless_columns(spark):
    d = spark.createDataFrame([("2024-01-01 00:00:00", "abc"), ("bad", "def")], "a string, b string")
    out = io.coerce_timestamps(d, ["a", "b"])
    assert out.schema["a"].dataType.typeName() == "timestamp_ntz" and out.schema["b"].dataType.typeName() == "string"
    assert out.filter("a is null").count() == 1


def events(spark):
    return spark.createDataFrame([(1, 1, None, T0, "5", "u"), (2, 2, 3, T0, "6", None)], "subject_id long, hadm_id long, stay_id long, charttime timestamp_ntz, value string, valueuom string")


def test_custom_events(spark, tmp_path):
    root = str(tmp_path)
    first = io.import_custom_events(spark, root, events(spark), "score", "SC", "me")
    second = io.import_custom_events(spark, root, events(spark).drop("stay_id"), "other", "OT", "me")
    assert (first, second) == (10000, 10001)
    stored = spark.read.parquet(f"{root}/customevents")
    assert stored.count() == 4 and stored.filter(F.col("itemid") == second).filter("stay_id is null").count() == 2
    assert {r.total_row for r in spark.read.parquet(f"{root}/d_customevents").collect()} == {2}
    with pytest.raises(ValueError, match="exists"):
        io.import_custom_events(spark, root, events(spark), "score", "SC", "me")
    with pytest.raises(ValueError, match="required"):
        io.import_custom_events(spark, root, events(spark), "", "SC", "me")
    with pytest.raises(ValueError, match="unknown"):
        io.import_custom_events(spark, root, events(spark).withColumn("z", F.lit(1)), "z", "Z", "me")
    with pytest.raises(ValueError, match="empty"):
        io.import_custom_events(spark, root, events(spark).withColumn("value", F.lit(None).cast("string")), "z", "Z", "me")


def test_custom_events_from_table(spark):
    stays = spark.createDataFrame([(1, 10, 100), (1, 10, 101), (2, 20, 200)], "subject_id long, hadm_id long, stay_id long")
    src = spark.createDataFrame([(100, T0, "x" * 30), (200, T0, "y")], "stay_id long, at timestamp_ntz, text string")
    out = io.custom_events_from_table(src, {"charttime": "at", "value": "text", "stay_id": "stay_id"}, stays)
    rows = sorted((r.subject_id, r.hadm_id, r.stay_id, r.value, r.valueuom) for r in out.collect())
    assert rows == [(1, 10, 100, "x" * 30, None), (2, 20, 200, "y", None)]
    short = io.custom_events_from_table(src, {"charttime": "at", "value": "text", "stay_id": "stay_id"}, stays, cut=20)
    assert {r.value for r in short.collect()} == {"x" * 20, "y"}
    with pytest.raises(ValueError):
        io.custom_events_from_table(src.drop("stay_id"), {"charttime": "at", "value": "text", "subject_id": "text"}, stays)


def test_cohort_store_and_export(spark, tmp_path):
    root = str(tmp_path)
    keys = spark.createDataFrame([(1, 1, 1), (2, 2, None)], "subject_id long, hadm_id long, stay_id long")
    assert io.persist_cohort(spark, root, keys, "a", "first") == 1 and io.persist_cohort(spark, root, keys.limit(1), "b", "second") == 2
    assert io.read_cohort(spark, root, 1).count() == 2 and io.read_cohort(spark, root, 2).count() == 1
    with pytest.raises(ValueError):
        io.persist_cohort(spark, root, keys, "a", "again")
    with pytest.raises(ValueError):
        io.persist_cohort(spark, root, keys, "c", "")
    io.export_csv(keys, f"{root}/csv")
    assert spark.read.option("header", True).csv(f"{root}/csv").count() == 2


class Tracing(Catalog):
    """Records which derived tables each builder asks for."""

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        self.stack, self.seen = [], {}

    def concept(self, name):
        if self.stack:
            self.seen.setdefault(self.stack[-1], set()).add(name)
        if name in self._memo:
            return self._memo[name]
        self.stack.append(name)
        try:
            return super().concept(name)
        finally:
            self.stack.pop()


def test_declared_dependencies_are_the_ones_read(spark):
    cat = Tracing(spark, StayFixture(spark, SMALL), BUILDERS)
    for name in BUILDERS:
        cat.concept(name)
    for name in BUILDERS:
        assert cat.seen.get(name, set()) == set(DEPENDENCIES.get(name, ())), name


def test_build_order_puts_inputs_first():
    order = build_order(["sepsis3", "meld"])
    for name in order:
        assert all(order.index(x) < order.index(name) for x in DEPENDENCIES.get(name, ()))
    with pytest.raises(KeyError):
        build_order(["nothing"])


def test_build_concepts_writes_and_reads_back(spark, tmp_path):
    paths = build_concepts(spark, StayFixture(spark, SMALL), str(tmp_path), ["first_day_urine_output", "icustay_hourly"])
    assert set(paths) == {"urine_output", "first_day_urine_output", "icustay_times", "icustay_hourly"}
    direct = Catalog(spark, StayFixture(spark, SMALL), BUILDERS).concept("first_day_urine_output")
    r = lambda df: df.select("stay_id", F.round("urineoutput", 6).alias("u"))
    assert r(spark.read.parquet(paths["first_day_urine_output"])).exceptAll(r(direct)).count() == 0
