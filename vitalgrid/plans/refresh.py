"""Incremental rebuild of stored derived tables.

Patients are dealt into buckets by a hash of subject_id. A manifest keeps, for every base table and bucket, the number
of rows and an order-free digest of their contents, and for every derived table the base tables it was built from. A
refresh compares the digests, builds a derived table from the changed buckets of its inputs only and overwrites
only these partitions; files of unchanged buckets stay as they are. A derived table is refreshed by buckets if it has a
key that leads to the patient; one without (a dictionary, a catalogue) is rebuilt whole once an input changed, and so
are its dependants. A changed base table without patients changes all buckets.

The manifest is written last: a refresh that dies is repeated by the next one. Only the manifest (base tables times
buckets, a few rows each) reaches the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.catalog import Catalog
from .dag import BUILDERS, DEPENDENCIES, build_order

BUCKET, WHOLE = "__bucket", -1
STAMP = "kind string, name string, input string, bucket int, n long, digest decimal(38,0)"


def bucket_of(subject: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(subject), F.lit(buckets)).cast("int")


def stamps(df: DataFrame, buckets: int) -> dict[int, tuple]:
    """Rows and digest per bucket; one entry, WHOLE, for a table without patients."""
    bucket = bucket_of(F.col("subject_id"), buckets) if "subject_id" in df.columns else F.lit(WHOLE)
    digest = F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))
    rows = df.groupBy(bucket.alias(BUCKET)).agg(F.count(F.lit(1)).alias("n"), digest.alias("digest")).collect()
    return {r[BUCKET]: (r["n"], r["digest"]) for r in rows}


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Refresh:
    """One refresh of the tables below `out`; `changed` holds the rebuilt buckets of each table afterwards (WHOLE: all of it)."""

    def __init__(self, spark: SparkSession, base: Callable[[str], DataFrame], out: str, buckets: int = 64,
                 builders: Mapping[str, Callable[[Catalog], DataFrame]] | None = None, dependencies: Mapping[str, Iterable[str]] | None = None) -> None:
        self.spark, self.base, self.out, self.buckets = spark, base, out.rstrip("/"), buckets
        self.builders, self.dependencies = dict(builders or BUILDERS), DEPENDENCIES if dependencies is None else dependencies
        self.changed: dict[str, set[int]] = {}
        self.seen: dict[str, dict[int, tuple]] = {}
        self.old: dict[str, dict[int, tuple]] = {}
        self.inputs: dict[str, set[str]] = {}
        self.schemas: dict[str, StructType] = {}
        if _exists(spark, f"{self.out}/_manifest"):
            for r in spark.read.schema(STAMP).parquet(f"{self.out}/_manifest").collect():
                if r["kind"] == "stamp":
                    self.old.setdefault(r["name"], {})[r["bucket"]] = (r["n"], r["digest"])
                elif r["kind"] == "input":
                    self.inputs.setdefault(r["name"], set()).add(r["input"])
                elif r["kind"] == "schema":
                    self.schemas[r["name"]] = StructType.fromJson(json.loads(r["input"]))
                elif r["n"] != buckets:
                    raise ValueError(f"the tables were stored with {r['n']} buckets")

    def stamp(self, name: str) -> dict[int, tuple]:
        if name not in self.seen:
            self.seen[name] = stamps(self.base(name), self.buckets)
        return self.seen[name]

    def _stale(self, name: str) -> set[int]:
        """Buckets of a derived table whose inputs changed; WHOLE if all of it is to be built."""
        if name not in self.schemas or not _exists(self.spark, f"{self.out}/{name}"):
            return {WHOLE}
        out: set[int] = set()
        for one in self.inputs.get(name, ()):
            now, before = self.stamp(one), self.old.get(one, {})
            out |= {b for b in now.keys() | before.keys() if now.get(b) != before.get(b)}
        for one in self.dependencies.get(name, ()):
            out |= self.changed.get(one, set())
        return {WHOLE} if WHOLE in out else out

    def _bucketed(self, df: DataFrame) -> DataFrame | None:
        """The rows with their bucket, by the patient or by a stay or admission that has one; None without such a key."""
        if "subject_id" in df.columns:
            return df.withColumn(BUCKET, bucket_of(F.col("subject_id"), self.buckets))
        for key, source in (("hadm_id", "admissions"), ("stay_id", "icustays")):
            if key in df.columns:
                who = self.base(source).select(F.col(key).alias("__key"), bucket_of(F.col("subject_id"), self.buckets).alias(BUCKET)).distinct()
                return df.join(who, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn(BUCKET, F.coalesce(BUCKET, F.lit(0)))
        return None

    def _build(self, name: str, buckets: set[int]) -> tuple[DataFrame, set[str]]:
        """The derived table from the given buckets of its inputs, and the base tables it asked for."""
        used: set[str] = set()

        def cut(df: DataFrame, by: Column) -> DataFrame:
            return df if WHOLE in buckets else df.filter(by.isin(sorted(buckets)))

        def base(table: str) -> DataFrame:
            used.add(table)
            df = self.base(table)
            return cut(df, bucket_of(F.col("subject_id"), self.buckets)) if "subject_id" in df.columns else df

        def stored(table: str) -> DataFrame | None:
            if table == name or table not in self.changed:
                return None
            df = self.spark.read.schema(self.schemas[table]).parquet(f"{self.out}/{table}")
            return cut(df, F.col(BUCKET)).drop(BUCKET) if BUCKET in df.columns else df
        return self.builders[name](Catalog(self.spark, base, self.builders, prebuilt=stored)), used

    def _store(self, name: str, buckets: set[int]) -> None:
        path = f"{self.out}/{name}"
        df, used = self._build(name, buckets)
        rows = self._bucketed(df)
        if rows is None and WHOLE not in buckets:
            buckets = {WHOLE}
            df, used = self._build(name, buckets)
        if rows is None:
            df.write.mode("overwrite").parquet(path)
        else:
            whole = WHOLE in buckets
            rows = rows if whole else rows.filter(F.col(BUCKET).isin(sorted(buckets)))
            rows = rows.repartition(BUCKET, F.pmod(F.xxhash64(*df.columns), F.lit(8)))  # up to eight files a bucket
            if not whole:
                for b in buckets:  # also those that have no rows any more
                    _remove(self.spark, f"{path}/{BUCKET}={b}")
            rows.write.mode("overwrite" if whole else "append").partitionBy(BUCKET).parquet(path)
        self.changed[name] = buckets
        self.inputs[name] = used
        self.schemas[name] = (df if rows is None else rows.select(*df.columns, BUCKET)).schema

    def run(self, names: Iterable[str] | None = None) -> dict[str, set[int]]:
        for name in build_order(names or self.builders) if self.dependencies is DEPENDENCIES else list(names or self.builders):
            stale = self._stale(name)
            if stale:
                self._store(name, stale)
            else:
                self.changed[name] = set()
        for one in {t for used in self.inputs.values() for t in used}:
            self.stamp(one)
        rows = [("stamp", t, None, b, n, d) for t, found in self.seen.items() for b, (n, d) in found.items()]
        rows += [("input", name, t, None, None, None) for name, used in self.inputs.items() for t in used] + [("buckets", None, None, None, self.buckets, None)]
        rows += [("schema", name, schema.json(), None, None, None) for name, schema in self.schemas.items()]
        self.spark.createDataFrame(rows, STAMP).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/_manifest")
        return self.changed


def refresh_concepts(spark: SparkSession, base: Callable[[str], DataFrame], out: str, names: Iterable[str] | None = None, buckets: int = 64, **kw) -> dict[str, set[int]]:
    """Bring the named derived tables (all by default) below `out` up to date; returns the rebuilt buckets of each."""
    return Refresh(spark, base, out, buckets, **kw).run(names)


def read_refreshed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A stored derived table without its bucket."""
    out = out.rstrip("/")
    known = spark.read.schema(STAMP).parquet(f"{out}/_manifest").filter((F.col("kind") == "schema") & (F.col("name") == name)).first()
    df = spark.read.schema(StructType.fromJson(json.loads(known["input"]))).parquet(f"{out}/{name}")
    return df.drop(BUCKET) if BUCKET in df.columns else df
