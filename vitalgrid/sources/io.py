"""Loading CSV folders, storing cohorts and custom events, exporting results."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SCHEMAS

CUSTOM_COLUMNS = ("subject_id", "hadm_id", "stay_id", "charttime", "value", "valueuom")
FIRST_CUSTOM_ITEM = 10000


# --- CSV load ---------------------------------------------------------------------------------------
def _list(spark: SparkSession, folder: str) -> list[str]:
    """Files of a folder on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []


def table_name(path: str) -> str | None:
    name = os.path.basename(path)
    for suffix in (".csv.gz", ".csv"):
        if name.endswith(suffix):
            return name[: -len(suffix)]
    return None


_BROKEN = "__broken_record"


def _quotes_close(spark: SparkSession, path: str) -> bool:
    """Whether all lines have an even number of quotes: a text that goes on in the next line leaves its first line odd."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    return spark.read.text(path).filter(odd == 1).isEmpty()


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, on_error: str = "raise") -> DataFrame:
    """A CSV with header: columns are taken by name, absent ones become NULL; padded text is trimmed.

    Quotes inside quoted text are doubled, and quoted text may hold line breaks. A record with the wrong number of
    fields or an unreadable value is broken: `on_error` "raise" counts such records and raises if there are any,
    "null" keeps what can be read. Where every line has an even number of quotes no text holds a line break, and the file
    is read in splits; otherwise it is read by one task and its rows are dealt out right after.
    """
    whole_lines = _quotes_close(spark, path)
    options = {"header": True, "escape": '"', "multiLine": not whole_lines, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    reader = spark.read.options(**options)
    header = reader.csv(path).columns
    known = {f.name.lower(): f for f in schema.fields}
    fields = [T.StructField(h, known[h.lower()].dataType if h.lower() in known else T.StringType()) for h in header]
    full = T.StructType([*fields, T.StructField(_BROKEN, T.StringType())])
    df = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN, enforceSchema=False).schema(full).csv(path)
    if on_error == "raise":
        # a hash of all columns, so that every one of them is parsed
        broken = df.agg(F.sum(F.when(F.col(_BROKEN).isNotNull(), F.pmod(F.hash(*header), F.lit(1)) + 1))).first()[0]
        if broken:
            raise ValueError(f"{broken} broken records in {path}")
    df = df.drop(_BROKEN)
    if not whole_lines or path.endswith(".gz"):
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    have = {h.lower(): h for h in header}
    cols = []
    for f in schema.fields:
        if f.name.lower() not in have:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and f.name.startswith("icd"):
            cols.append(F.trim(have[f.name.lower()]).alias(f.name))
        else:
            cols.append(F.col(have[f.name.lower()]).alias(f.name))
    return df.select(*cols)


def load_csv_dir(spark: SparkSession, folder: str, registry: Mapping[str, T.StructType] | None = None,
                 modules: Sequence[str] = ("hosp", "icu"), on_error: str = "raise") -> dict[str, DataFrame]:
    """Every *.csv or *.csv.gz below the module folders, read with its registered schema.

    A file without a schema is an error unless `on_error` is "null"; then its columns are read as text.
    """
    registry = registry or SCHEMAS
    out: dict[str, DataFrame] = {}
    for module in modules:
        for path in _list(spark, f"{folder.rstrip('/')}/{module}"):
            name = table_name(path)
            if name and name in registry:
                out[name] = read_csv_table(spark, path, registry[name], on_error)
            elif name and on_error == "raise":
                raise ValueError(f"no schema for {path}")
            elif name:
                header = spark.read.options(header=True, escape='"', multiLine=True).csv(path).columns
                out[name] = read_csv_table(spark, path, T.StructType([T.StructField(h, T.StringType()) for h in header]), on_error)
    return out


# file order of the large event tables: row groups of one item or stay lie together
LAYOUT = {"chartevents": ("itemid", "stay_id"), "labevents": ("itemid", "subject_id"), "inputevents": ("itemid", "stay_id"),
          "outputevents": ("itemid", "stay_id"), "procedureevents": ("itemid", "stay_id"), "datetimeevents": ("itemid", "stay_id"),
          "ingredientevents": ("itemid", "stay_id"), "prescriptions": ("drug", "subject_id")}


def store_tables(tables: Mapping[str, DataFrame], out: str) -> None:
    """Parquet per table; event tables are range-clustered so that item and stay filters skip row groups."""
    for name, df in tables.items():
        keys = [k for k in LAYOUT.get(name, ()) if k in df.columns]
        if keys:
            df = df.repartitionByRange(*keys, *[c for c in ("charttime", "starttime") if c in df.columns]).sortWithinPartitions(*keys)
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")


def coerce_timestamps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns to timestamps; a column none of whose values parses keeps its text."""
    parsed = {c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") for c in cols}
    hits = df.agg(*[F.count(p).alias(c) for c, p in parsed.items()]).first()
    return df.withColumns({c: p for c, p in parsed.items() if hits[c] > 0})


# --- custom events ----------------------------------------------------------------------------------
def check_custom_events(df: DataFrame) -> None:
    """Only the six known columns, and patient, admission, time and value not entirely empty."""
    unknown = [c for c in df.columns if c not in CUSTOM_COLUMNS]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    needed = ("subject_id", "hadm_id", "charttime", "value")
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}")
    filled = df.agg(*[F.count(c).alias(c) for c in needed]).first()
    empty = [c for c in needed if filled[c] == 0]
    if empty:
        raise ValueError(f"empty columns {empty}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its types and order; absent ones are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _name_taken(dictionary: DataFrame, col: str, name: str) -> bool:
    return not dictionary.filter(F.col(col) == name).isEmpty()


def next_id(dictionary: DataFrame, col: str, first: int) -> int:
    """The largest id plus one, or the first id."""
    top = dictionary.agg(F.max(col)).first()[0]
    return first if top is None else int(top) + 1


def import_custom_events(spark: SparkSession, root: str, df: DataFrame, label: str, abbreviation: str, author: str) -> int:
    """Append user events under a new item id; the label must be new. Returns the id."""
    if not (label and abbreviation and author):
        raise ValueError("label, abbreviation and author are required")
    check_custom_events(df)
    d_path, e_path = f"{root.rstrip('/')}/d_customevents", f"{root.rstrip('/')}/customevents"
    dictionary = _read_or_empty(spark, d_path, SCHEMAS["d_customevents"])
    if _name_taken(dictionary, "label", label):
        raise ValueError(f"label {label!r} exists")
    itemid = next_id(dictionary, "itemid", FIRST_CUSTOM_ITEM)
    # events first: a label is only taken once its rows are there
    conform(df.withColumn("itemid", F.lit(itemid)), SCHEMAS["customevents"]).write.mode("append").parquet(e_path)
    rows = spark.read.parquet(e_path).filter(F.col("itemid") == itemid).count()
    entry = spark.createDataFrame([(itemid, label, abbreviation, author, rows)], SCHEMAS["d_customevents"])
    entry.write.mode("append").parquet(d_path)
    return itemid


def custom_events_from_table(df: DataFrame, bind: Mapping[str, str], stays: DataFrame | None = None, cut: int | None = None) -> DataFrame:
    """Bind a table's columns to the event columns.

    `bind` maps event columns to table columns. Unbound subject or admission is filled from the stays by the
    key columns both tables share; unbound stay and unit become NULL. The value is kept whole unless
    `cut` gives a number of characters.
    """
    if "charttime" not in bind or "value" not in bind:
        raise ValueError("charttime and value must be bound")
    d = df
    need_subject, need_hadm = "subject_id" not in bind, "hadm_id" not in bind
    if need_subject or need_hadm:
        if stays is None:
            raise ValueError("stays are needed to fill missing keys")
        if need_hadm and not need_subject and "stay_id" not in df.columns:
            raise ValueError("the admission can only be filled from a stay_id column")
        on = [k for k in ("subject_id", "hadm_id", "stay_id") if k in df.columns]
        if not on:
            raise ValueError("no key column to join the stays on")
        d = df.join(stays.select("subject_id", "hadm_id", "stay_id").dropDuplicates(on), on)

    def bound(name: str):
        if name in bind:
            return F.col(bind[name])
        if name in ("subject_id", "hadm_id"):
            return F.col(name)
        return F.lit(None)
    return d.select(bound("subject_id").cast("long").alias("subject_id"), bound("hadm_id").cast("long").alias("hadm_id"),
                    bound("stay_id").cast("long").alias("stay_id"), bound("charttime").cast("timestamp_ntz").alias("charttime"),
                    (bound("value").cast("string") if cut is None else F.substring(bound("value").cast("string"), 1, cut)).alias("value"), bound("valueuom").cast("string").alias("valueuom"))


# --- cohorts and exports --------------------------------------------------------------------------------
def persist_cohort(spark: SparkSession, root: str, df: DataFrame, name: str, description: str) -> int:
    """Store a cohort's keys under a new id; name and description are required, the name must be new."""
    if not (name and description):
        raise ValueError("name and description are required")
    d_path, c_path = f"{root.rstrip('/')}/d_cohorts", f"{root.rstrip('/')}/cohort"
    dictionary = _read_or_empty(spark, d_path, SCHEMAS["d_cohorts"])
    if _name_taken(dictionary, "cohort_name", name):
        raise ValueError(f"cohort {name!r} exists")
    cohort_id = next_id(dictionary, "cohort_id", 1)
    keys = df.select(*[F.col(c).cast("long").alias(c) for c in ("subject_id", "hadm_id", "stay_id")])
    keys.withColumn("cohort_id", F.lit(cohort_id).cast("long")).write.mode("append").partitionBy("cohort_id").parquet(c_path)
    spark.createDataFrame([(cohort_id, name, description)], SCHEMAS["d_cohorts"]).write.mode("append").parquet(d_path)
    return cohort_id


def read_cohort(spark: SparkSession, root: str, cohort_id: int) -> DataFrame:
    """Keys of one stored cohort; only its partition is read."""
    return spark.read.parquet(f"{root.rstrip('/')}/cohort").filter(F.col("cohort_id") == cohort_id).drop("cohort_id")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header, written in parallel (one file per partition); what `read_csv_table` reads back is what was given.

    Quotes are doubled, blanks at either end and microseconds stay. Empty text reads back as NULL, like any empty field.
    """
    times = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **times).csv(path)


def load_infection_types(spark: SparkSession, path: str) -> DataFrame:
    """User-supplied dictionary of results and their infection type."""
    return read_csv_table(spark, path, SCHEMAS["infection_type"])
