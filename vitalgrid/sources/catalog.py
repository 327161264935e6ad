"""Resolves base and derived tables by name; shared derived tables are written once and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="vitalgrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Catalog:
    """Base tables come from `base(name)`; derived ones are built on demand from `builders`.

    Names in `shared` are consumed by many other tables. They are written to the shared folder and read
    back, which cuts the plan, survives the loss of executors and lets later scans prune columns.
    """

    def __init__(self, spark: SparkSession, base: Callable[[str], DataFrame],
                 builders: Mapping[str, Callable[["Catalog"], DataFrame]], shared: Iterable[str] = (),
                 prebuilt: Callable[[str], DataFrame | None] | None = None):
        prepare(spark)
        self.spark, self._base, self._builders = spark, base, builders
        self._shared, self._prebuilt = set(shared), prebuilt
        self._memo: dict[str, DataFrame] = {}
        self._run: str | None = None

    def table(self, name: str) -> DataFrame:
        """A base table."""
        key = f"base:{name}"
        if key not in self._memo:
            self._memo[key] = self._base(name)
        return self._memo[key]

    def concept(self, name: str) -> DataFrame:
        """A derived table."""
        if name not in self._memo:
            ready = self._prebuilt(name) if self._prebuilt else None
            df = ready if ready is not None else self._builders[name](self)
            if ready is None and name in self._shared:
                df = self.keep(name, df)
            self._memo[name] = df
        return self._memo[name]

    def built(self, name: str) -> bool:
        """Whether a derived table is there already."""
        return name in self._memo or (self._prebuilt is not None and self._prebuilt(name) is not None)

    def of_patient(self, subject: int) -> "Catalog":
        """The same tables over the base rows of one patient."""
        def base(name: str) -> DataFrame:
            df = self.table(name)
            return df.filter(F.col("subject_id") == subject) if "subject_id" in df.columns else df
        return Catalog(self.spark, base, self._builders, self._shared)

    def keep(self, name: str, df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
        """Write a table to the shared folder, in a folder for each value of `by`, and read it back."""
        if self._run is None:
            self._run = f"{shared_folder(self.spark).rstrip('/')}/vitalgrid-{uuid.uuid4().hex}"
        path = f"{self._run}/{name}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def parquet_base(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    """Base tables stored as one Parquet folder per table."""
    return lambda name: spark.read.parquet(f"{root.rstrip('/')}/{name}")
