"""Ordered-window operators that do not put one key's whole history into one task.

A plain `Window.partitionBy(key)` sends every row of a key to the same task. Here the time axis of
each key is cut into spans and windows run per (key, span):

* bounded frames copy the last `width` of a span into the next one, so every frame is complete;
* neighbours are found inside a span first; only the first and last row of each span look across spans;
* running sums and row numbers work inside a span and add one summary row per (key, span);
* where a key may have more than MOST_SPANS spans (numbers, or spans of seconds), edges and summaries go through a
  hierarchy of coarser spans, 2**STEP_BITS finer ones each, so a sparse key is never ordered in one task either.

Results equal the plain window; only the partitioning differs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalars import DAY, micros

CHUNK = "__span"
POS = "__pos"


def position(df: DataFrame, ts: str) -> Column:
    """Numeric position of the ordering column: microseconds for times, the value itself for numbers."""
    return F.col(ts) if isinstance(df.schema[ts].dataType, NumericType) else micros(ts)


@dataclass(frozen=True)
class Agg:
    """One windowed aggregate: function name, input column and frame [low, high] relative to the row."""

    fn: str
    col: str
    low: int
    high: int = 0


_FRAME_FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count, "last": F.last}


def range_window(df: DataFrame, key: Sequence[str], ts: str, aggs: Mapping[str, Agg], span: int | None = None) -> DataFrame:
    """Aggregates over value-range frames that look back at most a fixed width.

    `low`/`high` are offsets (both <= 0) in units of the position: microseconds for timestamps.
    `high=-1` gives a strictly-earlier frame.
    """
    if any(a.high > 0 or a.low > a.high for a in aggs.values()):
        raise ValueError("frames must end at or before the current row")
    width = max(-a.low for a in aggs.values())
    span = span or max(8 * width, 1)
    d = df.withColumn(POS, position(df, ts).cast("long"))
    home = F.floor(F.col(POS) / F.lit(span)).cast("long")
    needed_next = F.col(POS) + F.lit(width) >= (home + 1) * F.lit(span)
    d = d.withColumn(CHUNK, F.explode(F.when(needed_next, F.array(home, home + 1)).otherwise(F.array(home))))
    base = Window.partitionBy(*key, CHUNK).orderBy(POS)
    for name, a in aggs.items():
        d = d.withColumn(name, _FRAME_FUNCTIONS[a.fn](F.col(a.col)).over(base.rangeBetween(a.low, a.high)))
    return d.filter(F.col(CHUNK).eqNullSafe(home)).drop(CHUNK, POS)


def rolling_range(df: DataFrame, key: Sequence[str], ts: str, col: str, window: int, fn: str, out: str,
                  strict: bool = False) -> DataFrame:
    """One look-back aggregate; `strict` leaves the current instant out."""
    return range_window(df, key, ts, {out: Agg(fn, col, -window, -1 if strict else 0)})


def rolling_rows(df: DataFrame, key: Sequence[str], order: str, n: int, aggs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Aggregates over the current row and the n-1 before it.

    Rows are numbered per key first, which turns the row frame into a bounded range frame.
    """
    numbered = row_numbers(df, key, order, "__row", span=None)
    frames = {out: Agg(fn, col, -(n - 1), 0) for out, (fn, col) in aggs.items()}
    return range_window(numbered, key, "__row", frames, span=max(8 * n, 256)).drop("__row")


#: Spans of one key that are ordered at once, and bits between the levels above.
MOST_SPANS, STEP_BITS = 1 << 22, 20
_TIME_RANGE = 9999 * 366 * DAY


def _width(df: DataFrame, ts: str, span: int | None) -> int:
    return span or (4096 if isinstance(df.schema[ts].dataType, NumericType) else DAY)


def _spanned(df: DataFrame, ts: str, span: int | None) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(position(df, ts) / F.lit(_width(df, ts, span))).cast("long"))


def _levels(df: DataFrame, ts: str, span: int | None) -> int:
    """Coarser levels needed until a key has at most MOST_SPANS spans, from the range of the position's type."""
    spans = (2 ** 64 if isinstance(df.schema[ts].dataType, NumericType) else _TIME_RANGE) // _width(df, ts, span)
    n = 0
    while spans > MOST_SPANS:
        spans, n = spans >> STEP_BITS, n + 1
    return n


def _offsets(spans: DataFrame, key: Sequence[str], value: str, levels: int) -> DataFrame:
    """`spans` (key, span, value) with __offset, the sum of the values of the key's earlier spans (NULL if there are none)."""
    if not levels:
        before = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        return spans.withColumn("__offset", F.sum(value).over(before))
    coarse = F.shiftright(CHUNK, STEP_BITS)
    d = spans.withColumnRenamed(CHUNK, "__fine").withColumn(CHUNK, F.shiftright("__fine", STEP_BITS))
    above = _offsets(spans.groupBy(*key, coarse.alias(CHUNK)).agg(F.sum(value).alias(value)), key, value, levels - 1).drop(value).withColumnRenamed("__offset", "__above")
    inside = Window.partitionBy(*key, CHUNK).orderBy("__fine").rowsBetween(Window.unboundedPreceding, -1)
    d = _join_edges(d.withColumn("__inside", F.sum(value).over(inside)), above, key)
    total = F.when(F.col("__inside").isNotNull() | F.col("__above").isNotNull(), F.coalesce("__inside", F.lit(0)) + F.coalesce("__above", F.lit(0)))
    return d.withColumn("__offset", total).drop("__inside", "__above", CHUNK).withColumnRenamed("__fine", CHUNK)


def _join_edges(d: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach per-(key, span) summaries; keys compare null-safe."""
    on = [*key, CHUNK]
    e = edges.select(*[F.col(k).alias(f"__e_{k}") for k in on], *[c for c in edges.columns if c not in on])
    cond = None
    for k in on:
        test = F.col(k).eqNullSafe(F.col(f"__e_{k}"))
        cond = test if cond is None else cond & test
    return d.join(e, cond, "left").drop(*[f"__e_{k}" for k in on])


def neighbours(df: DataFrame, key: Sequence[str], ts: str, *, lag: Mapping[str, str] | None = None,
               lead: Mapping[str, str] | None = None, tie: Sequence[str] = (), span: int | None = None) -> DataFrame:
    """Columns of the previous (`lag`) and next (`lead`) row in key order; maps output name to input column.

    Rows at the edge of a span are the only ones whose neighbour lies elsewhere: they are taken aside, ordered
    per key (two rows per span) and put back. Both branches read the same shuffle.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    carried = sorted({*lag.values(), *lead.values()})
    d = _spanned(df, ts, span).withColumn("__payload", F.struct(F.lit(True).alias("__hit"), *[F.col(c).alias(c) for c in carried]))
    local = Window.partitionBy(*key, CHUNK).orderBy(ts, *tie)
    d = d.withColumn("__lag", F.lag("__payload").over(local)).withColumn("__lead", F.lead("__payload").over(local))
    first, last = F.col("__lag").isNull(), F.col("__lead").isNull()

    def output(before: Column, after: Column) -> list[Column]:
        return [*[F.col(c) for c in df.columns], *[before.getField(c).alias(n) for n, c in lag.items()],
                *[after.getField(c).alias(n) for n, c in lead.items()]]
    done = [d.filter(~(first | last))]
    edge = d.filter(first | last)

    def looked_up(rows: DataFrame, window: Window) -> DataFrame:
        return rows.withColumns({"__lag": F.coalesce("__lag", F.lag("__payload").over(window)), "__lead": F.coalesce("__lead", F.lead("__payload").over(window))})
    for level in range(1, _levels(df, ts, span) + 1):
        # the first and last rows of 2**STEP_BITS spans; only theirs are open afterwards
        edge = looked_up(edge, Window.partitionBy(*key, F.shiftright(CHUNK, level * STEP_BITS)).orderBy(ts, *tie))
        done.append(edge.filter(~(first | last)))
        edge = edge.filter(first | last)
    done.append(looked_up(edge, Window.partitionBy(*key).orderBy(ts, *tie)))
    return reduce(DataFrame.unionByName, [part.select(*output(F.col("__lag"), F.col("__lead"))) for part in done])


def running_sum(df: DataFrame, key: Sequence[str], ts: str, col: str, out: str, span: int | None = None) -> DataFrame:
    """Running sum in time order; rows at the same instant share one value."""
    d = _spanned(df, ts, span)
    edges = d.groupBy(*key, CHUNK).agg(F.sum(col).alias("__sum"))
    edges = _offsets(edges, key, "__sum", _levels(df, ts, span)).drop("__sum")
    local = Window.partitionBy(*key, CHUNK).orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__local", F.sum(col).over(local))
    d = _join_edges(d, edges, key)
    total = F.when(F.col("__local").isNull() & F.col("__offset").isNull(), None).otherwise(
        F.coalesce("__local", F.lit(0)) + F.coalesce("__offset", F.lit(0)))
    return d.select(*df.columns, total.alias(out))


def row_numbers(df: DataFrame, key: Sequence[str], ts: str, out: str, tie: Sequence[str | Column] = (),
                span: int | None = None) -> DataFrame:
    """1, 2, 3 … per key in time order, `tie` orders rows of one instant."""
    d = _spanned(df, ts, span)
    edges = d.groupBy(*key, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    edges = _offsets(edges, key, "__n", _levels(df, ts, span)).withColumn("__offset", F.coalesce("__offset", F.lit(0))).drop("__n")
    local = Window.partitionBy(*key, CHUNK).orderBy(ts, *tie)
    d = d.withColumn("__local", F.row_number().over(local))
    d = _join_edges(d, edges, key)
    return d.select(*df.columns, (F.col("__local") + F.col("__offset")).cast("long").alias(out))


def carry_previous(df: DataFrame, key: Sequence[str], ts: str, cols: Mapping[str, str], tol: int) -> DataFrame:
    """Columns of the directly preceding row when it is less than `tol` microseconds older, else NULL.

    Rows must be unique per (key, ts). Bounded, so one shuffle and no self join.
    """
    payload = F.struct(*[F.col(c).alias(c) for c in sorted(set(cols.values()))])
    d = df.withColumn("__payload", payload)
    d = range_window(d, key, ts, {"__prev": Agg("last", "__payload", -(tol - 1), -1)})
    return d.select(*df.columns, *[F.col("__prev").getField(src).alias(out) for out, src in cols.items()])


@dataclass(frozen=True)
class Order:
    """One sort key: ascending by default; NULLs last unless told otherwise."""

    col: str
    desc: bool = False
    nulls_first: bool = False

    def column(self) -> Column:
        c = F.col(self.col)
        if self.desc:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def rank_parts(self, df: DataFrame) -> list[Column]:
        """Parts of a struct that sorts ascending like this key."""
        c = F.col(self.col)
        null_flag = F.when(c.isNull(), F.lit(0 if self.nulls_first else 1)).otherwise(F.lit(1 if self.nulls_first else 0))
        if not self.desc:
            return [null_flag, c]
        kind = df.schema[self.col].dataType
        if isinstance(kind, NumericType):
            return [null_flag, -c]
        if kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
            return [null_flag, -micros(self.col)]
        raise ValueError(f"descending order on {self.col} ({kind.typeName()}) is not supported here")


def top1(df: DataFrame, part: Sequence[str], order: Sequence[Order]) -> DataFrame:
    """The first row of every group under `order`.

    An aggregate, not a window: every task keeps one row per group before the shuffle, so a group of
    any size ends as one row per task.
    """
    parts: list[Column] = []
    for o in order:
        parts += o.rank_parts(df)
    rank = F.struct(*[p.alias(f"r{i}") for i, p in enumerate(parts)])
    rest = [c for c in df.columns if c not in part]
    best = df.groupBy(*part).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("__row"))
    return best.select(*[F.col(c) if c in part else F.col("__row").getField(c).alias(c) for c in df.columns])


def top_k(df: DataFrame, by: Sequence[str], n: int, order: Sequence[Order], out: str = "rank") -> DataFrame:
    """The first n rows per group with their position.

    A first cut per (group, salt) keeps at most n rows per salt, the final ranking sees salts x n rows
    per group only.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    cols = [o.column() for o in order]
    first = Window.partitionBy(*by, "__salt").orderBy(*cols)
    cut = salted.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= n).drop("__rn", "__salt")
    final = Window.partitionBy(*by).orderBy(*cols)
    return cut.withColumn(out, F.row_number().over(final)).filter(F.col(out) <= n)


def sequence_flags(df: DataFrame, part: Sequence[str], order: str, seq: str, first: str) -> DataFrame:
    """Dense rank of the ordering value inside a group, and whether it is the first.

    Ranks are taken over the distinct (group, value) pairs and joined back, so repeated values cost
    nothing and long groups are cut in time spans.
    """
    distinct = df.select(*part, order).distinct()
    known = row_numbers(distinct.filter(F.col(order).isNotNull()), part, order, seq)
    holes = distinct.filter(F.col(order).isNull()).select(*part, F.lit(1).alias("__hole"))
    ranked = known.join(holes, list(part), "left").select(
        *part, order, (F.col(seq) + F.coalesce("__hole", F.lit(0))).alias(seq))
    ranked = ranked.unionByName(holes.select(*part, F.lit(None).cast(df.schema[order].dataType).alias(order),
                                             F.lit(1).cast("long").alias(seq)))
    r = ranked.select(*[F.col(c).alias(f"__r_{c}") for c in (*part, order)], seq)
    cond = None
    for c in (*part, order):
        test = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        cond = test if cond is None else cond & test
    out = df.join(r, cond, "left").drop(*[f"__r_{c}" for c in (*part, order)])
    return out.withColumn(first, F.col(seq) == 1)
