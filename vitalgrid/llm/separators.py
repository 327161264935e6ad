"""Token counts of documents in flat token streams that have no index, by a scan for the end identifier.

A stream is a sequence of unsigned little-endian identifiers in which every document ends with one end identifier.
It comes as blocks (stream, block number, bytes), cut anywhere between two bytes: an identifier may lie across a
border. Each block is searched by itself, once for each byte at which its first identifier may begin; what it tells is
small: the tokens before each end and after the last, and the bytes at its borders. The sizes of earlier blocks say which
search holds, and bytes of an identifier that begins in an earlier block go back to it. A prefix scan over these summaries (within groups of GROUP blocks, over the groups, and back)
gives each block the number of documents that ended before it and the tokens open at its start, which makes the
document borders exact.

Tokens after a stream's last end are a document without an end (`closed` false). Empty documents (two ends on end)
count 0 tokens. Empty streams have no documents. Bytes left over at the end of a stream that do not fill an
identifier are an error. Blocks must be numbered from 0; repeated blocks are an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import encoder
from .words import field, small_batches
from .work import stored

GROUP, BLOCK_BYTES, WIDTH = 256, 1 << 20, 2
PART_BYTES = 64 << 20


SUMMARY = "stream {}, block long, size long, shift int, n long, ends long, tail long, counts binary, head binary, rest binary"
NUMBERS = ("n", "ends", "tail")


def _summaries(width: int, end: int, shifts: int) -> Callable:
    """Per block and number of leading bytes passed over: tokens, ends, tokens after the last end, and those before each
    end (32 bits each), of the whole identifiers; the block's first bytes and those left over at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            rows = []
            for i, data in enumerate(field(batch, "data").to_pylist()):
                for shift in range(shifts):
                    n = max(0, len(data) - shift) // width
                    at = np.flatnonzero(np.frombuffer(data, kind, n, shift) == end) if n else np.zeros(0, np.int64)
                    rows.append((i, len(data), shift, n, len(at), n - 1 - int(at[-1]) if len(at) else n, (np.diff(at, prepend=-1) - 1).astype(np.uint32).tobytes(), data[:width - 1], data[shift + n * width:]))
            at, *rest = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 3))]
            yield pa.record_batch([field(batch, "stream").take(at), field(batch, "block").take(at), *rest], ["stream", "block", "size", "shift", *NUMBERS, "counts", "head", "rest"])
    return run


def _crossed(width: int, end: int) -> Callable:
    """Summaries with the identifier that begins in the block's last bytes and ends in later blocks (`more`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, tail = (field(batch, c).to_numpy().copy() for c in NUMBERS)
            counts = field(batch, "counts").to_pylist()
            for i, (rest, more) in enumerate(zip(field(batch, "rest").to_pylist(), field(batch, "more").to_pylist(), strict=True)):
                if not rest:
                    continue
                data = (rest + (more or b""))[:width]
                if len(data) < width:
                    raise ValueError(f"{len(data)} bytes at the end of a stream do not fill an identifier")
                n[i] += 1
                if int.from_bytes(data, "little") == end:
                    counts[i] += int(tail[i]).to_bytes(4, "little")
                    ends[i], tail[i] = ends[i] + 1, 0
                else:
                    tail[i] += 1
            yield pa.record_batch([field(batch, "stream"), field(batch, "block"), pa.array(n), pa.array(ends), pa.array(tail), pa.array(counts, pa.binary())], ["stream", "block", *NUMBERS, "counts"])
    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that end in a block: their number in the stream and their tokens."""
    for batch in batches:
        ends = field(batch, "ends").to_numpy()
        counts = [np.frombuffer(data, np.uint32).astype(np.int64) for data in field(batch, "counts").to_pylist()]
        for own, open_ in zip(counts, field(batch, "open").to_pylist(), strict=True):
            own[0] += open_
        at = np.repeat(np.arange(len(ends)), ends)
        place = field(batch, "before").to_numpy()[at] + np.arange(len(at)) - np.repeat(np.cumsum(ends) - ends, ends)
        yield pa.record_batch([field(batch, "stream").take(pa.array(at)), pa.array(place), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)])), pa.array(np.ones(len(at), bool))],
                              ["stream", "place", "n_tokens", "closed"])


def _whole(summaries: DataFrame, width: int) -> DataFrame:
    """The summary of each block that begins with its first own identifier, and the bytes that follow the block (`more`).

    Only summaries move, never the blocks: which shift is right follows from the sizes of all earlier blocks.
    """
    if width == 1:
        return summaries.withColumn("more", F.lit(None).cast("binary"))
    line = Window.partitionBy("stream", "group").orderBy("block")
    sized = summaries.where("shift = 0").select("stream", "block", "size", F.floor(F.col("block") / GROUP).alias("group"))
    starts = _scan(sized, lambda: F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size")
    starts = starts.select("stream", "block", F.pmod(-F.col("start"), F.lit(width)).cast("int").alias("shift"))
    # an identifier may reach over the next width - 1 blocks
    after = F.explode(F.sequence(F.lit(1), F.lit(width - 1))).alias("step")
    heads = summaries.where("shift = 0").select("stream", "block", "head", after).select("stream", (F.col("block") - F.col("step")).alias("block"), "step", "head")
    follow = heads.groupBy("stream", "block").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("step", "head"))), F.lit(b""), lambda acc, x: F.concat(acc, x["head"])).alias("more"))
    return summaries.join(starts, ["stream", "block", "shift"]).join(follow, ["stream", "block"], "left")


def _scan(rows: DataFrame, within, size: str) -> DataFrame:
    """Sum of `size` over all earlier blocks of the stream: inside the group, plus the groups before."""
    inside = rows.withColumn("inside", within())
    groups = rows.groupBy("stream", "group").agg(F.sum(size).alias("total"))
    before = groups.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("stream").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(before, ["stream", "group"]).select("stream", "block", (F.col("inside") + F.col("base")).alias("start"))


def count_tokens(blocks: DataFrame, end: int, width: int = WIDTH, aligned: bool = False) -> DataFrame:
    """stream, place (of the document in it), n_tokens (without the end), closed; blocks: stream, block, data.

    `aligned` says that no identifier lies across two blocks.
    """
    blocks = blocks.select("stream", F.col("block").cast("long").alias("block"), "data")
    kind = blocks.schema["stream"].dataType.simpleString()
    summaries = stored(blocks.mapInArrow(_summaries(width, end, 1 if aligned else width), SUMMARY.format(kind)))
    own = _whole(summaries, 1 if aligned else width).select("stream", "block", *NUMBERS, "counts", "rest", "more")
    marks = stored(own.mapInArrow(_crossed(width, end), f"stream {kind}, block long, n long, ends long, tail long, counts binary").withColumn("group", F.floor(F.col("block") / GROUP)))
    # open tokens at the start of a block: all tokens since the last block with an end, and that block's tail
    since = F.struct("block", "tail", "sum")
    line = Window.partitionBy("stream", "group").orderBy("block")
    upto, prior = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    inner = marks.withColumn("sum", F.sum("n").over(upto)).withColumn("last", F.max(F.when(F.col("ends") > 0, since)).over(prior)).withColumn("ended", F.coalesce(F.sum("ends").over(prior), F.lit(0)))
    groups = inner.groupBy("stream", "group").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"), F.max(F.when(F.col("ends") > 0, since)).alias("last"))
    # what a group leaves open: after its last end, or all of it
    groups = groups.withColumn("left", F.when(F.col("last").isNull(), F.col("n")).otherwise(F.col("last.tail") + F.col("n") - F.col("last.sum")))
    wide = Window.partitionBy("stream").orderBy("group")
    earlier, through = wide.rowsBetween(Window.unboundedPreceding, -1), wide.rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("total", F.sum("n").over(through)).withColumn("mark", F.max(F.when(F.col("last").isNotNull(), F.struct("group", "left", "total"))).over(earlier))
    before_group = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    groups = groups.select("stream", "group", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("base"),
                           F.when(F.col("mark").isNull(), before_group).otherwise(F.col("mark.left") + before_group - F.col("mark.total")).alias("carried"))
    done = inner.join(groups, ["stream", "group"]).select(
        "stream", "block", (F.col("ended") + F.col("base")).alias("before"), "ends", "tail", "n", "counts",
        F.when(F.col("last").isNull(), F.col("carried") + F.col("sum") - F.col("n")).otherwise(F.col("last.tail") + F.col("sum") - F.col("n") - F.col("last.sum")).alias("open"))
    closed = done.where("ends > 0").select("stream", "before", "ends", "open", "counts").mapInArrow(_documents, f"stream {kind}, place long, n_tokens long, closed boolean")
    finish = done.groupBy("stream").agg(F.max(F.struct("block", "before", "ends", "tail", "n", "open")).alias("x"))
    rest = finish.select("stream", (F.col("x.before") + F.col("x.ends")).alias("place"), F.when(F.col("x.ends") > 0, F.col("x.tail")).otherwise(F.col("x.open") + F.col("x.n")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest.where("n_tokens > 0"))


def _record_length(size: int, most: int) -> int:
    """The largest divisor of a file's length up to `most`: records of it leave no tail."""
    return next(d for d in range(min(size, most), 0, -1) if size % d == 0)


def _grouped(stream: str, per_block: int) -> Callable:
    """Records (number, bytes) of a part of a file as blocks; parts begin at a block's first record."""
    def run(records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[str, int, bytearray]]:
        for block, own in groupby(records, lambda r: r[0] // per_block):
            yield stream, block, bytearray(b"".join([data for _, data in own]))
    return run


def _large_file(spark: SparkSession, path: str, size: int, block_bytes: int, part_bytes: int):
    """One file as an RDD of blocks, read in parts of about `part_bytes` by different tasks."""
    record = _record_length(size, block_bytes)
    per_block = block_bytes // record
    part = str(max(1, part_bytes // (record * per_block)) * record * per_block)
    plain = re.sub(r"([\\*?{}\[\]])", r"\\\1", path)  # no pattern of names
    conf = {"mapreduce.input.fileinputformat.inputdir": spark.sparkContext._jvm.org.apache.hadoop.util.StringUtils.escapeString(plain),
            "mapreduce.input.fileinputformat.split.minsize": part, "mapreduce.input.fileinputformat.split.maxsize": part,
            "org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record)}
    records = spark.sparkContext.newAPIHadoopRDD("org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    return records.mapPartitions(_grouped(path, per_block))


def read_streams(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Flat token files of any size as blocks: stream (file name), block, data.

    Files up to `part_bytes` are read whole, larger ones in parts of about that size by as many tasks. Their blocks
    hold as many records as fit into `block_bytes`, a record being the largest divisor of the file's length up to
    that, so no tail is left. Few and small divisors (twice a prime) only make records short and reading slow.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream"), "length", "content")
    small = files.where(F.col("length") <= part_bytes)
    cut = small.select("stream", "content", F.posexplode(F.sequence(F.lit(1), F.greatest(F.col("length"), F.lit(1)), F.lit(block_bytes))).alias("block", "start"))
    blocks = cut.select("stream", F.col("block").cast("long"), F.substring("content", F.col("start").cast("int"), F.lit(block_bytes)).alias("data"))
    large = [_large_file(spark, r["stream"], r["length"], block_bytes, part_bytes) for r in files.where(F.col("length") > part_bytes).select("stream", "length").collect()]  # names and lengths
    return blocks.union(spark.createDataFrame(spark.sparkContext.union(large), "stream string, block long, data binary")) if large else blocks


def _streams(id_col: str, text_col: str, end: int, block_bytes: int, path: str | None) -> Callable:
    """One stream per partition, in blocks, and the ids of its documents in order (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stream, encode, stop = context.partitionId() if context else 0, encoder(path).encode, np.array([end], "<u2").tobytes()
        held, size, block, place = [], 0, 0, 0
        ids = len(encoder(path).written)
        if ids > 1 << 16:
            raise ValueError(f"{ids} identifiers do not fit into 16 bits")

        def out(data: bytes) -> pa.RecordBatch:
            return pa.record_batch([pa.array([v], t) for v, t in ((0, pa.int32()), (stream, pa.int32()), (block, pa.int64()), (None, pa.int64()), (data, pa.binary()))], ["kind", "stream", "block", "id", "data"])
        for batch in small_batches(batches, text_col):
            for text in field(batch, text_col).to_pylist():
                tokens = np.frombuffer(encode(text or ""), "<u4").astype("<u2")
                if end < ids and (tokens == end).any():
                    raise ValueError(f"a text holds the end identifier {end}; take one outside the vocabulary")
                held += [tokens.tobytes(), stop]
                size += len(held[-2]) + 2
                if size >= block_bytes:
                    data = b"".join(held)
                    for at in range(0, len(data) - block_bytes + 1, block_bytes):
                        yield out(data[at:at + block_bytes])
                        block += 1
                    held = [data[len(data) // block_bytes * block_bytes:]]
                    size = len(held[0])
            n = batch.num_rows
            yield pa.record_batch([pa.array([1] * n, pa.int32()), pa.array([stream] * n, pa.int32()), pa.array(np.arange(place, place + n)), field(batch, id_col).cast(pa.int64()), pa.nulls(n, pa.binary())],
                                  ["kind", "stream", "block", "id", "data"])
            place += n
        if size:
            yield out(b"".join(held))
    return run


def token_streams(docs: DataFrame, end: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents as flat streams of 16-bit identifiers: (blocks, documents in order: stream, place, id).

    A text that yields `end` itself is an error, as its document would fall in two.
    """
    rows = stored(docs.select(id_col, text_col).mapInArrow(_streams(id_col, text_col, end, block_bytes, vocabulary), "kind int, stream int, block long, id long, data binary"))
    return rows.where("kind = 0").select("stream", "block", "data"), rows.where("kind = 1").select("stream", F.col("block").alias("place"), "id")
