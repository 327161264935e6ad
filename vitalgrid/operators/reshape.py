"""Event pivots, hour grids, interval building, segments and episodes."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HOUR, ceil_hour, from_micros, micros
from .windows import neighbours


@dataclass(frozen=True)
class ItemCol:
    """One pivoted column: which items feed it, which field is read and which values are valid.

    gt/lt are exclusive limits, ge/le inclusive ones. `scale` maps an item to a divisor (unit change).
    """

    name: str
    itemids: tuple[int, ...]
    field: str = "valuenum"
    gt: float | None = None
    ge: float | None = None
    lt: float | None = None
    le: float | None = None
    scale: Mapping[int, float] = dataclasses.field(default_factory=dict)

    def value(self) -> Column:
        v = F.col(self.field)
        test = F.col("itemid").isin(list(self.itemids)) if len(self.itemids) > 1 else F.col("itemid") == self.itemids[0]
        for limit, op in ((self.gt, "__gt__"), (self.ge, "__ge__"), (self.lt, "__lt__"), (self.le, "__le__")):
            if limit is not None:
                test = test & getattr(v, op)(F.lit(limit))
        out = v
        for item, divisor in self.scale.items():
            out = F.when(F.col("itemid") == item, v / F.lit(divisor)).otherwise(out)
        return F.when(test, out)


_AGGS: dict[str, Callable] = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}


def pivot_events(df: DataFrame, keys: Sequence[str], items: Sequence[ItemCol], agg: str = "max",
                 extra: Sequence[Column] = ()) -> DataFrame:
    """Long events to one row per key: one pass, one shuffle, aggregated before it.

    The item list is pushed to the scan as an IN filter.
    """
    wanted = sorted({i for c in items for i in c.itemids})
    fn = _AGGS[agg]
    return (df.filter(F.col("itemid").isin(wanted))
            .groupBy(*keys)
            .agg(*extra, *[fn(c.value()).alias(c.name) for c in items]))


def summarise(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str], fns: Sequence[str]) -> DataFrame:
    """min/max/avg of several columns; `cols` maps output stem to input column."""
    suffix = {"avg": "mean"}
    aggs = [_AGGS[fn](F.col(c)).alias(f"{stem}_{suffix.get(fn, fn)}") for stem, c in cols.items() for fn in fns]
    return df.groupBy(*keys).agg(*aggs)


def hourly_grid(df: DataFrame, key: Sequence[str], start: str, end: str, lead: int = 24) -> DataFrame:
    """Hours -lead … ceil(end-start) per key; hour 0 ends at the start rounded up to the hour."""
    bounds = grid_bounds(df, key, start, end)
    grid = bounds.withColumn("hr", F.explode(F.sequence(F.lit(-lead).cast("long"), F.col("last_hr"))))
    return grid.select(*key, "hr", (F.col("anchor") + F.make_dt_interval(F.lit(0), F.col("hr").cast("int"))).alias("endtime"))


def grid_bounds(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Anchor time and last hour of each key's grid, one row per key."""
    last = F.ceil((micros(end) - micros(start)) / F.lit(float(HOUR))).cast("long")
    return (df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
            .select(*key, ceil_hour(start).alias("anchor"), last.alias("last_hr")))


def hour_index(ts: Column | str, anchor: Column | str) -> Column:
    """Grid hour whose (start, end] holds the time: arithmetic instead of a join with the grid."""
    return F.ceil((micros(ts) - micros(anchor)) / F.lit(float(HOUR))).cast("long")


def hours_touching(ts: Column | str, anchor: Column | str) -> Column:
    """Grid hours whose closed [start, end] holds the time: two hours when it is on the hour."""
    gap = micros(ts) - micros(anchor)
    hr = F.ceil(gap / F.lit(float(HOUR))).cast("long")
    return F.when(gap % F.lit(HOUR) == 0, F.array(hr, hr + 1)).otherwise(F.array(hr))


def to_intervals(df: DataFrame, key: Sequence[str], start: str, out: str, last_end: Column, tie: Sequence[str] = ()) -> DataFrame:
    """Start times become intervals ending at the key's next start, the last one at `last_end`."""
    d = neighbours(df, key, start, lead={"__next": start}, tie=tie)
    return d.withColumn(out, F.coalesce(F.col("__next"), last_end)).drop("__next")


def segment_intervals(intervals: Mapping[str, DataFrame], key: str = "stay_id", start: str = "starttime",
                      end: str = "endtime") -> DataFrame:
    """Atomic segments between all neighbouring start and end times of several interval tables."""
    ends = [df.select(key, F.explode(F.array(start, end)).alias("__t")) for df in intervals.values()]
    times = reduce(DataFrame.unionByName, ends).distinct()
    segs = neighbours(times.filter(F.col("__t").isNotNull()), [key], "__t", lead={end: "__t"})
    return segs.withColumnRenamed("__t", start).filter(F.col(end).isNotNull()).select(key, start, end)


def gap_episodes(df: DataFrame, key: Sequence[str], ts: str, state: str, gap: int, out_state: str | None = None,
                 drop_points: bool = True) -> DataFrame:
    """Runs of one state: a new episode on a change of state or when the previous row is >= gap away.

    An episode ends at the next documented time of any state unless that is >= gap away, then at its
    own last time. Episodes with a single time are dropped on request. Rows are unique per (key, ts).
    Only first and last rows of episodes are kept and paired, so no running count is needed.
    """
    name = out_state or state
    d = df.filter(F.col(state).isNotNull()).select(*key, ts, state)
    d = neighbours(d, key, ts, lag={"__ps": state, "__pt": ts}, lead={"__ns": state, "__nt": ts})
    far = F.coalesce(micros("__nt") - micros(ts) >= F.lit(gap), F.lit(True))
    starts = F.col("__ps").isNull() | (F.col("__ps") != F.col(state)) | (micros(ts) - micros("__pt") >= F.lit(gap))
    ends = far | (F.col("__ns") != F.col(state))
    d = d.select(*key, ts, state, starts.alias("__starts"), ends.alias("__ends"), F.when(far, F.col(ts)).otherwise(F.col("__nt")).alias("__end"))
    d = neighbours(d.filter(F.col("__starts") | F.col("__ends")), key, ts, lead={"__l_ts": ts, "__l_end": "__end"})
    point = F.col("__starts") & F.col("__ends")
    d = d.filter(F.col("__starts") & ~point) if drop_points else d.filter(F.col("__starts"))
    return d.select(*key, F.col(ts).alias("starttime"), F.when(point, F.col("__end")).otherwise(F.col("__l_end")).alias("endtime"), F.col(state).alias(name))


def widen(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Names become columns (first value by order of value); the list of names is explicit."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def hour_floor(ts: Column | str) -> Column:
    return from_micros((F.floor(micros(ts) / F.lit(float(HOUR))) * F.lit(HOUR)).cast("long"))
