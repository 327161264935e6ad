"""Queries that write given tables in the shared folder and read them back: CSV load, custom events, cohorts, export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import Condition
from ..operators.shared_scan import SharedScan
from ..sources import io
from ..sources.catalog import shared_folder
from ..sources.schemas import SCHEMAS
from .dag import build_concepts
from .refresh import read_refreshed, refresh_concepts
from .registry import catalog, query, read


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/vitalgrid-{uuid.uuid4().hex}"


# quotes, commas, line breaks and empty text in turn
_TEXT = "CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN 'a \"b, c\" ' || p_name WHEN 1 THEN p_name || chr(10) || '\"' WHEN 2 THEN p_name || ',' ELSE NULL END"
_PARTS = T.StructType([T.StructField("p_retailprice", T.DoubleType()), T.StructField("p_partkey", T.LongType()), T.StructField("p_comment", T.StringType()), T.StructField("p_absent", T.StringType())])


@query("csv_quoted_load", f"SELECT p_retailprice, p_partkey, {_TEXT} AS p_comment, CAST(NULL AS VARCHAR) AS p_absent FROM part")
def csv_quoted(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark)
    rows = read(spark, d, "part").select(F.col("p_partkey").cast("long"), F.expr(_TEXT.replace("chr(10)", "char(10)")).alias("p_comment"), F.col("p_retailprice").cast("double"))
    rows.write.options(header=True, escape='"', quoteAll=True, emptyValue="", nullValue=None).csv(f"{root}/hosp/part.csv")
    return io.load_csv_dir(spark, root, {"part": _PARTS}, ("hosp",))["part"]


# quotes, commas, line breaks, blanks at the ends, empty and missing text in turn
_HARD = """CASE CAST(p_partkey % 8 AS INTEGER) WHEN 0 THEN 'a "b, c" ' || p_name WHEN 1 THEN p_name || chr(10) || '"' WHEN 2 THEN p_name || ',' WHEN 3 THEN '  ' || p_name || '  ' WHEN 4 THEN ''
    WHEN 5 THEN '"' WHEN 6 THEN chr(92) || '"' || p_name ELSE NULL END"""


@query("csv_export_hard", f"SELECT p_partkey, nullif({_HARD}, '') AS p_comment, p_retailprice FROM part")
def csv_export_hard(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/part.csv"
    rows = read(spark, d, "part").select(F.col("p_partkey").cast("long"), F.expr(_HARD.replace("chr(10)", "char(10)").replace("chr(92)", "char(92)")).alias("p_comment"), F.col("p_retailprice").cast("double"))
    io.export_csv(rows, path)
    return io.read_csv_table(spark, path, rows.schema)


@query("csv_split_load", "SELECT event_id, user_id, ts, event_type, value FROM events")
def csv_split(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark)
    rows = read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    io.export_csv(rows, f"{root}/hosp/events.csv")
    return io.load_csv_dir(spark, root, {"events": rows.schema}, ("hosp",))["events"]


@query("csv_export", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/supplier.csv"
    suppliers = read(spark, d, "supplier").select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_acctbal").cast("double"))
    io.export_csv(suppliers, path)
    return io.read_csv_table(spark, path, suppliers.schema)


@query("custom_event_import", """SELECT subject_id, hadm_id, stay_id, CAST(10000 AS BIGINT) AS itemid, charttime, value, valueuom, 'heart rate' AS label, 'HR' AS abbreviation, 'me' AS author,
    count(*) OVER () AS total_row FROM v_chartevents WHERE itemid = 220045""")
def custom_import(spark: SparkSession, d: str) -> DataFrame:
    root, cat = _folder(spark), catalog(spark, d)
    source = cat.table("chartevents").filter(F.col("itemid") == 220045).select(F.col("subject_id").alias("who"), "hadm_id", "stay_id", F.col("charttime").alias("at"), "value", "valueuom")
    bound = io.custom_events_from_table(source, {"subject_id": "who", "hadm_id": "hadm_id", "stay_id": "stay_id", "charttime": "at", "value": "value", "valueuom": "valueuom"})
    io.import_custom_events(spark, root, bound, "heart rate", "HR", "me")
    return spark.read.parquet(f"{root}/customevents").join(spark.read.parquet(f"{root}/d_customevents"), "itemid")


def _without_some(base):
    """The base tables as they were before some patients had events and others had been charted at all."""
    def table(name: str) -> DataFrame:
        df = base(name)
        if name == "chartevents":
            return df.filter((F.col("subject_id") % 5 != 0) | (F.col("itemid") % 2 == 0))
        return df.filter(F.col("subject_id") % 7 != 3) if name in ("icustays", "admissions") else df
    return table


for _name in ("icustay_hourly", "gcs", "charlson", "vitalsign"):
    def _refreshed(name):
        @query(f"refresh_{name}", f"SELECT * FROM v_{name}", {} if name != "vitalsign" else {c: 6 for c in ("heart_rate", "sbp", "dbp", "mbp", "sbp_ni", "dbp_ni", "mbp_ni", "resp_rate", "temperature", "spo2", "glucose")})
        def build(spark: SparkSession, d: str) -> DataFrame:
            out, base = _folder(spark), catalog(spark, d).table
            refresh_concepts(spark, _without_some(base), out, [name])
            refresh_concepts(spark, base, out, [name])
            return read_refreshed(spark, out, name)
    _refreshed(_name)


@query("build_concepts_store", "SELECT stay_id, hadm_id, icu_intime, icu_outtime FROM v_icustay_detail")
def concepts_store(spark: SparkSession, d: str) -> DataFrame:
    out = _folder(spark)
    paths = build_concepts(spark, catalog(spark, d).table, out, ["icustay_detail"])
    return spark.read.parquet(paths["icustay_detail"]).select("stay_id", "hadm_id", "icu_intime", "icu_outtime")


@query("schema_conform", """SELECT 'outputevents' AS name, count(*) AS n, count(value) AS n_value, 9 AS n_columns FROM v_outputevents
    UNION ALL SELECT 'labevents', count(*), count(value), 16 FROM v_labevents UNION ALL SELECT 'triage', count(*), count(acuity), 11 FROM v_triage""")
def schema_conform(spark: SparkSession, d: str) -> DataFrame:
    cat, parts = catalog(spark, d), []
    for name, value in (("outputevents", "value"), ("labevents", "value"), ("triage", "acuity")):
        df = io.conform(cat.table(name), SCHEMAS[name])
        parts.append(df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count(value).alias("n_value"), F.lit(len(df.columns)).alias("n_columns")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filter_validation", f"""SELECT 0 AS condition, true AS valid, (SELECT count(*) FROM (SELECT DISTINCT subject_id, hadm_id, stay_id FROM v_chartevents WHERE itemid = 220045 AND valuenum >= 150)) AS stays
    UNION ALL SELECT unnest([1, 2, 3, 4, 5]), false, 0""")
def filter_validation(spark: SparkSession, d: str) -> DataFrame:
    cat, rows, good = catalog(spark, d), [], []
    asked = [Condition("chartevents", 220045, "valuenum", ">=", 150), Condition("nothing", 1, "value", "Exist"), Condition("chartevents", "1 OR 1=1", "value", "Exist"),
             Condition("chartevents", 1, "stay_id", "Exist"), Condition("chartevents", 1, "value", "Near"), Condition("chartevents", 1, "value", "=", 1, "mode")]
    for i, c in enumerate(asked):
        try:
            c.check()
            good.append(c)
            rows.append((i, True))
        except ValueError:
            rows.append((i, False))
    found = SharedScan(cat.table, cat.table("icustays"), cat.concept("icustay_times")).many(good).groupBy("__leaf").agg(F.count(F.lit(1)).alias("stays"))
    tried = spark.createDataFrame(rows, "condition int, valid boolean")
    return tried.join(found, tried["condition"] == found["__leaf"], "left").select("condition", "valid", F.when(F.col("valid"), F.coalesce("stays", F.lit(0))).otherwise(0).alias("stays"))


@query("cohort_store", "SELECT subject_id, hadm_id, stay_id FROM v_icustays")
def cohort_store(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark)
    number = io.persist_cohort(spark, root, catalog(spark, d).table("icustays"), "all stays", "every stay")
    return io.read_cohort(spark, root, number)


@query("text_timestamps", "SELECT event_id, ts AS at, event_type AS kind FROM events", None)
def text_timestamps(spark: SparkSession, d: str) -> DataFrame:
    texts = read(spark, d, "events").select("event_id", F.col("ts").cast("string").alias("at"), F.col("event_type").alias("kind"))
    return io.coerce_timestamps(texts, ["at", "kind"])


@query("infection_types", "SELECT label, value, \"count\", infection_type FROM v_infection_type")
def infection_types(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/infection_type.csv"
    io.export_csv(catalog(spark, d).table("infection_type").select("label", "value", F.col("count").cast("long"), "infection_type"), path)
    return io.load_infection_types(spark, path)
