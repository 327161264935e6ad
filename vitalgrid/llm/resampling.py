"""Quality by importance resampling of hashed n-gram models.

Two generative models share BUCKETS hashed buckets of lower-cased words and word pairs: the target model is
counted over all texts that are labelled good, the raw model over all texts. A text's log importance weight is the
sum over its n-grams of log(p_target / p_raw). Gumbel top-k draws the sample: each row's key is its weight
divided by `temperature` and its number of n-grams to the power `length_power`, plus Gumbel noise that depends on
the row's id and text only, and the rows with the largest keys are selected (a draw without replacement).

With length_power 1 the weight is a mean per n-gram, so long texts are neither favoured nor punished; 0 gives the
plain sum. `share` of the rows are selected, rounded down; equal keys go to the smaller id, then the
smaller text hash. Rows that agree in both get the same noise and are told apart at random.

Null and empty texts have no n-grams, weight 0 and still a key. Labels other than 1 teach nothing about the
target, several label rows of one id count once. Without good rows all weights are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import ALPHANUMERIC, Words, field, mixed, small_batches
from .work import hash_bitmap, in_bitmap, stored

BUCKETS, SHARE, TEMPERATURE, LENGTH_POWER, PRIOR = 10_000, 0.5, 0.05, 1.0, 10
CUT_ROWS = 10_000


def buckets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair of each text, and the text of each."""
    words = Words(column, ALPHANUMERIC)
    one, text = words.hashes(), words.text_index()
    same = text[1:] == text[:-1]
    two = mixed(one[:-1] * np.uint64(3) + one[1:])[same]
    return (np.concatenate((one, two)) % np.uint64(size)).astype(np.int64), np.concatenate((text, text[1:][same]))


def _counted(text_col: str, size: int) -> Callable:
    """Bucket counts of one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in small_batches(batches, text_col):
            n += np.bincount(buckets(field(batch, text_col), size)[0], minlength=size)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], ["bucket", "n"])
    return run


def _maybe(text_col: str, bitmap) -> Callable:
    """Rows whose id the bitmap has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap.value, field(batch, "id_hash").to_numpy().view(np.uint64))))
    return run


def _weighed(id_col: str, text_col: str, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in small_batches(batches, text_col):
            bucket, text = buckets(field(batch, text_col), len(ratio))
            n = np.bincount(text, minlength=batch.num_rows)
            weight = np.bincount(text, ratio[bucket], batch.num_rows)
            yield pa.record_batch([field(batch, id_col), field(batch, "noise"), pa.array(n), pa.array(weight)], [id_col, "noise", "n_grams", "log_weight"])
    return run


def _totals(texts: DataFrame, text_col: str, size: int) -> np.ndarray:
    rows = texts.select(text_col).mapInArrow(_counted(text_col, size), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most `size`
    out = np.zeros(size)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(docs: DataFrame, good_ids: DataFrame, id_col: str, text_col: str, size: int) -> np.ndarray:
    """log(p_target / p_raw) of each bucket; the target counts are drawn towards the raw shares by PRIOR n-grams a bucket."""
    good = good_ids.select(F.col(id_col).alias("good_id")).where("good_id IS NOT NULL").distinct()
    # a bitmap of fixed size keeps most other texts out of the shuffle; the join decides
    bitmap = hash_bitmap(good.select(F.xxhash64("good_id").alias("h")), "h")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("id_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    some = rows.mapInArrow(_maybe("text", bitmap), f"id {kind}, id_hash long, text string")
    target = _totals(some.join(good, some["id"] == good["good_id"], "left_semi"), "text", size)
    if not target.sum():
        return np.zeros(size)
    raw = _totals(rows, "text", size)
    raw = (raw + 0.5) / (raw.sum() + 0.5 * size)
    return np.log((target + PRIOR * size * raw) / (target.sum() + PRIOR * size)) - np.log(raw)


def top_rows(rows: DataFrame, key: str, ties: list[str], k: int) -> tuple[float, DataFrame]:
    """The rows' selection by the k largest keys: (floor, rows with `selected`).

    The k-th key is found by counting in ever narrower ranges until at most CUT_ROWS rows or one key value lie in
    the range; only the rows of that range are ordered.
    """
    low, high, above = (*rows.agg(F.min(key), F.max(key)).first(), 0)
    if low is None or k <= 0:
        return float("inf"), rows.withColumn("selected", F.lit(False))
    while low < high:
        step = (high - low) / 4096
        if not step or low + step == low:
            break
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        bins = {r["bin"]: r["n"] for r in inside.groupBy(F.least(F.floor((F.col(key) - low) / step), F.lit(4095)).alias("bin")).agg(F.count("*").alias("n")).collect()}
        if sum(bins.values()) <= CUT_ROWS:
            break
        for b in sorted(bins, reverse=True):
            if above + bins[b] >= k:
                break
            above += bins[b]
        edges = rows.where((F.col(key) >= low) & (F.col(key) <= high) & (F.least(F.floor((F.col(key) - low) / step), F.lit(4095)) == b)).agg(F.min(key), F.max(key)).first()
        if tuple(edges) == (low, high):
            break
        low, high = edges
    edge = rows.where((F.col(key) >= low) & (F.col(key) <= high))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(key), *ties))
    border = edge.withColumn("place", place).withColumn("selected", F.col("place") <= k - above).drop("place")
    rest = rows.where((F.col(key) < low) | (F.col(key) > high)).withColumn("selected", F.col(key) > high)
    return float(low), rest.unionByName(border)


def resample(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, size: int = BUCKETS,
             temperature: float = TEMPERATURE, length_power: float = LENGTH_POWER, seed: int = 1) -> DataFrame:
    """Per document: the id, n_grams, log_weight, sample_key, selected."""
    ratio = log_ratios(docs, good_ids, id_col, text_col, size)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = docs.schema[id_col].dataType.simpleString()
    noise = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    weighed = docs.select(id_col, text_col, noise.alias("noise")).mapInArrow(_weighed(id_col, text_col, shared), f"`{id_col}` {kind}, noise long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned("noise", 11).cast("double") + 0.5) / float(1 << 53)
    scaled = F.col("log_weight") / (temperature * F.pow(F.greatest(F.col("n_grams"), F.lit(1)).cast("double"), F.lit(length_power)))
    keyed = stored(weighed.withColumn("sample_key", scaled - F.log(-F.log(uniform))))
    _, chosen = top_rows(keyed, "sample_key", [id_col, "noise"], int(keyed.count() * share))
    return chosen.drop("noise")
