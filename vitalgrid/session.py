"""Session settings the library expects; used by the bench, the tests and the examples."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Only settings that change correctness (time zone) or the handling of size and skew.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a join on the key followed by an aggregate on the same key must still be split when skewed
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Compressed keys take up to thirty times their shuffled size in a hash table: the clinical queries merge small partitions up to this only.
# What a join broadcasts goes through the driver, a table for each of up to a hundred joins, several times its stored size: larger sides are shuffled.
MERGED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB", "spark.sql.autoBroadcastJoinThreshold": "1MB",
          "spark.sql.adaptive.autoBroadcastJoinThreshold": "1MB"}


def build_session(app: str = "vitalgrid", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; `extra` adds or overrides Spark settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(app: str = "vitalgrid", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Small local session for tests and the bench."""
    spark = build_session(
        app,
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.driver.memory": os.environ.get("VITALGRID_DRIVER_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.debug.maxToStringFields": "200",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession, **extra: str) -> None:
    """Runtime settings the plans rely on, for sessions built elsewhere.

    Timestamps carry no zone, so positions are taken in UTC; skewed joins are split even when the next
    operator could have reused their partitioning. `extra` adds settings.
    """
    for key, value in {**CONF, **extra}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
