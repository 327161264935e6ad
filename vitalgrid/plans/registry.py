"""Runnable queries with an SQL counterpart.

A query is a function of (session, data folder). Its SQL may use the fixture and derived views by their
`v_` names; `sql_text` puts the needed ones in front as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import MERGED, prepare
from ..sources.catalog import Catalog
from ..sources.fixtures import AdmissionFixture, StayFixture, fixture_sql
from .concept_sql import concept_views
from .dag import BUILDERS, SHARED

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    rounded: dict[str, int] = field(default_factory=dict)


QUERIES: dict[str, Query] = {}


def rounded_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round columns whose last bits depend on the order of a floating sum."""
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]) if digits else df


def query(name: str, sql: str | None = None, rounded: dict[str, int] | None = None) -> Callable[[Build], Build]:
    """Register a query; `rounded` columns are rounded alike in both engines."""
    digits = rounded or {}

    def wrap(fn: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark, **MERGED)
            return rounded_columns(fn(spark, folder), digits)
        QUERIES[name] = Query(name, run, sql, digits)
        return fn
    return wrap


_CATALOGS: dict[tuple, Catalog] = {}


def stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder, on any file system Spark can reach."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def catalog(spark: SparkSession, folder: str, share: bool = True) -> Catalog:
    """Catalog over the stay fixture of one folder; shared tables are written once while its files stay the same."""
    if not share:
        return Catalog(spark, StayFixture(spark, folder), BUILDERS)
    key = (spark.sparkContext.applicationId, id(spark), folder, stamp(spark, folder))
    if key not in _CATALOGS:
        fixture = StayFixture(spark, folder)
        _CATALOGS[key] = Catalog(spark, fixture, BUILDERS, SHARED)
        fixture.keep_with(_CATALOGS[key].keep)
    return _CATALOGS[key]


def admissions(spark: SparkSession, folder: str) -> AdmissionFixture:
    return AdmissionFixture(spark, folder)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@lru_cache(maxsize=1)
def views() -> dict[str, str]:
    return {**fixture_sql(), **concept_views()}


_NAME = re.compile(r"\bv_[a-z0-9_]+\b")


def sql_text(body: str, rounded: dict[str, int] | None = None) -> str:
    """The body with its views as leading common table expressions."""
    known, order = views(), []

    def need(text: str, path: tuple[str, ...]) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in known and name not in order and name not in path:
                need(known[name], (*path, name))
                order.append(name)
    need(body, ())
    if rounded:
        replaced = ", ".join(f"round({c}, {n}) AS {c}" for c, n in rounded.items())
        body = f"SELECT * REPLACE ({replaced}) FROM ({body})"
    if not order:
        return body
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + f"\n{body}"


def all_queries() -> dict[str, Build]:
    load()
    return {name: q.build for name, q in QUERIES.items()}


def all_sql() -> dict[str, str]:
    load()
    return {name: sql_text(q.sql, q.rounded) for name, q in QUERIES.items() if q.sql}


def load() -> None:
    """Import the modules that register queries."""
    from . import queries_analytics, queries_cohort, queries_concepts, queries_events, queries_operators, queries_storage  # noqa: F401
