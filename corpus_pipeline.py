"""From raw documents to packed token sequences.

Toxic documents go, one document of each near-duplicate class stays, documents with benchmark passages go, secrets
are overwritten in place, and what is left is packed. Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.llm.decontaminate import without_contaminated
from vitalgrid.llm.jaccard import one_of_each
from vitalgrid.llm.packing import pack
from vitalgrid.llm.secret_scan import redacted
from vitalgrid.llm.toxicity import fifth, without_toxic
from vitalgrid.llm.work import lean, ship, stored


def prepare(spark: SparkSession) -> None:
    """The package on the executors, and small batches, since the stages follow each other in the same executors."""
    ship(spark)
    lean(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fifth())
    return without_toxic(docs, labels)


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    prepare(spark)
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    prepare(spark)
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def overwrite_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; every document stays."""
    prepare(spark)
    return redacted(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_per_class),
    ("decontamination", drop_contaminated),
    ("secrets", overwrite_secrets),
    ("packing", packed_sequences),
]

# tokenisation and learned scores have no counterpart in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
