"""Shared pieces of the text operators: working tables, packed exchanges, bounded bitmaps."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "row"
KEY = "key struct<a:bigint,b:bigint>"


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id has no fold and counts as training data."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="vitalgrid-llm-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The same rows read back from a table in the shared folder; it goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vitalgrid-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt(df: DataFrame, key: str = "part") -> DataFrame:
    """Rows with the same key in one partition."""
    return df.repartition(tasks_of(df.sparkSession), key)


BITMAP_BITS = 26


def hash_bitmap(df: DataFrame, column: str, bits: int = BITMAP_BITS) -> Broadcast:
    """A broadcast bitmap of 2**bits bits (8 MB) with the top bits of the 64-bit hashes in `column` set.

    The size does not depend on the rows. A value that was never added may look present, so users must only
    let it decide how much work is done, never what the result is.
    """
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = (df.select((place + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect())
    size = 1 << max(0, bits - 3)
    out = np.zeros(size + 4096, np.uint8)
    for r in rows:  # at most 2**bits / 32768 rows of 4 KB; bucket numbers start with 1
        data = np.frombuffer(r["bits"], np.uint8)
        at = (r["bucket"] - 1) * 4096
        out[at:at + len(data)] |= data
    return df.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def row_key(id_col: str, text_col: str, of: str = "") -> Column:
    """A 128-bit name of a row's id and text; `of` is the struct column that carries them, if any."""
    both = [F.col(f"{of}.`{c}`" if of else f"`{c}`") for c in (id_col, text_col)]
    return F.struct(F.xxhash64(*both).alias("a"), F.xxhash64(F.lit(7), *both).alias("b"))


def marked(rows: DataFrame, keys: DataFrame, bits: int = 24) -> DataFrame:
    """The rows with `maybe`: false only where the struct column `key` is surely none of those in `keys`.

    The test is one bit of a bitmap of 2**bits bits, joined as a broadcast table of at most 2**bits / 32768 rows of
    4 KB; neither the rows nor their texts leave the JVM.
    """
    place = F.shiftrightunsigned(F.xxhash64("key"), 64 - bits) + 1
    table = (keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("at", at).join(F.broadcast(table), "bucket", "left")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, CAST(at % 8 AS INT))")) != 0
    return found.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("bucket", "at", "bits")


def rows_without(docs: DataFrame, out: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents whose `row_key` is not in `out` (key). Only rows that may be meant are moved to be joined."""
    rows = marked(rows_of(docs).withColumn("key", row_key(id_col, text_col, ROW)), out)
    unsure = rows.where("maybe").join(out, "key", "left_anti").select(ROW)
    return unpacked(rows.where("NOT maybe").select(ROW).union(unsure))


def rows_of(docs: DataFrame) -> DataFrame:
    """One struct column that carries every input column untouched, whatever the names are."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def row_schema(rows: DataFrame, results: str) -> str:
    return f"{ROW} {rows.schema[ROW].dataType.simpleString()}, {results}"


def flat(rows: DataFrame) -> DataFrame:
    """The carried columns and the results; a carried column with the name of a result gives way."""
    results = [c for c in rows.columns if c != ROW]
    carried = [c for c in rows.schema[ROW].dataType.names if c not in results]
    return rows.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in carried], *results)


def unpacked(rows: DataFrame) -> DataFrame:
    """The carried columns alone."""
    return rows.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in rows.schema[ROW].dataType.names])


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once per context."""
    context = spark.sparkContext
    if getattr(context, "_vitalgrid_llm_sent", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="vitalgrid-"), "vitalgrid_llm.zip")
    with zipfile.ZipFile(path, "w") as out:
        for name in ("__init__.py", *(f"llm/{f}" for f in sorted(os.listdir(os.path.join(top, "llm"))) if f.endswith(".py"))):
            out.write(os.path.join(top, name), f"vitalgrid/{name}")
    context.addPyFile(path)
    context._vitalgrid_llm_sent = True


def lean(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of at most `size`, where the session still has the default of 64 MB: whole texts pass in fewer MB a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64m", "67108864", "67108864b"):
        spark.conf.set(name, size)
