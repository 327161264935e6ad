"""Join patterns: point-in-interval, as-of, windows around an anchor, full outer with merged keys.

Range conditions always get an equality besides the key: the time axis is cut into buckets, so one
hot key spreads over many tasks and each (point, interval) pair is still produced exactly once,
because a point lies in one bucket only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY, micros
from .windows import Order

_BUCKET = "__bucket"


def _bounds(pos: Column, start: Column, end: Column, bounds: str) -> Column:
    low = pos >= start if bounds[0] == "[" else pos > start
    high = pos <= end if bounds[1] == "]" else pos < end
    return low & high


def interval_join(points: DataFrame, ivals: DataFrame, key: Sequence[str], ts: str, start: str, end: str,
                  bounds: str = "[]", how: str = "inner", span: int = DAY, extra: Column | None = None) -> DataFrame:
    """Points inside intervals of the same key.

    bounds: "[]", "(]", "[)" or "()". how: inner, left, left_semi, left_anti (points are the left side).
    Interval columns other than the key must not clash with point columns. `extra` is a further condition.
    """
    on = list(key)
    right_names = {k: f"__i_{k}" for k in on}
    p = points.withColumn(_BUCKET, F.floor(micros(ts) / F.lit(span)).cast("long"))
    lo = F.floor(micros(start) / F.lit(span)).cast("long")
    hi = F.floor(micros(end) / F.lit(span)).cast("long")
    i = (ivals.filter(F.col(start) <= F.col(end))
         .withColumn("__i_bucket", F.explode(F.sequence(lo, hi)))
         .withColumnsRenamed(right_names))
    cond = F.col(_BUCKET) == F.col("__i_bucket")
    for k in on:
        cond = cond & (F.col(k) == F.col(right_names[k]))
    cond = cond & _bounds(F.col(ts), F.col(start), F.col(end), bounds)
    if extra is not None:
        cond = cond & extra
    joined = p.join(i, cond, how)
    return joined.drop(_BUCKET, "__i_bucket", *right_names.values())


def _dyadic_cells(low: Column, high: Column, levels: int) -> Column:
    """Aligned cells (level, number) of 2**level buckets that together are exactly the buckets low..high: at most two a level."""
    start = F.struct(low.alias("a"), high.alias("z"), F.array().cast("array<struct<level:int,number:bigint>>").alias("cells"))

    def step(s: Column, level: Column) -> Column:
        a, z = s["a"], s["z"]
        cell = lambda n: F.struct(level.alias("level"), n.alias("number"))
        left, right = (a <= z) & (F.pmod(a, F.lit(2)) == 1), (a <= z) & (F.pmod(z, F.lit(2)) == 0)
        more = F.when(left & right, F.array(cell(a), cell(z))).when(left, F.array(cell(a))).when(right, F.array(cell(z)))
        return F.struct(F.when(left, a + 1).otherwise(a).alias("a"), F.when(right, z - 1).otherwise(z).alias("z"), F.concat(s["cells"], F.coalesce(more, F.array().cast("array<struct<level:int,number:bigint>>"))).alias("cells"))

    def climb(s: Column, level: Column) -> Column:
        t = step(s, level)
        open_ = t["a"] <= t["z"]
        return F.struct(F.when(open_, F.shiftright(t["a"], 1)).otherwise(1).alias("a"), F.when(open_, F.shiftright(t["z"], 1)).otherwise(0).alias("z"), t["cells"].alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, climb, lambda s: s["cells"])


def dyadic_join(points: DataFrame, ivals: DataFrame, key: Sequence[str], ts: str, start: str, end: str,
                bounds: str = "[]", how: str = "inner", span: int = DAY) -> DataFrame:
    """`interval_join` for intervals of any length: one of n buckets costs at most 2 log2(n) rows instead of n.

    An interval becomes aligned cells of 1, 2, 4, … buckets of `span` microseconds; a point looks up one cell on each level
    that some interval has (known from one aggregate over the intervals, at most 64 numbers). A pair meets in
    exactly one cell. For the joins that keep or test points, matched points are told by a 128-bit hash of the whole row, so
    repeated rows share their fate, as they must.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how}")
    bucket = lambda c: F.floor(micros(c) / F.lit(span)).cast("long")
    levels = (2 ** 63 // span).bit_length() + 1
    names = {k: f"__i_{k}" for k in key}
    i = ivals.filter(F.col(start) <= F.col(end))
    i = i.select("*", F.explode(_dyadic_cells(bucket(start), bucket(end), levels)).alias("__c"))
    i = i.select(*[c for c in i.columns if c != "__c"], F.col("__c.level").alias("__level"), F.col("__c.number").alias("__number")).withColumnsRenamed(names)
    present = i.agg(F.collect_set("__level").alias("__levels")).select(F.lit(1).alias("__one"), "__levels")  # one row
    content = F.struct(*[F.col(c) for c in points.columns])
    p = points.withColumn("__row", F.struct(F.xxhash64(content).alias("a"), F.xxhash64(F.lit(7), content).alias("b")))
    seeking = p.withColumn("__one", F.lit(1)).join(F.broadcast(present), "__one").drop("__one").withColumn("__at", F.explode("__levels")).drop("__levels")
    seeking = seeking.withColumn("__cell", F.floor(bucket(ts) / F.pow(F.lit(2.0), F.col("__at"))).cast("long"))
    cond = (F.col("__at") == F.col("__level")) & (F.col("__cell") == F.col("__number")) & _bounds(F.col(ts), F.col(start), F.col(end), bounds)
    for k in key:
        cond = cond & (F.col(k) == F.col(names[k]))
    hits = seeking.join(i, cond).drop("__at", "__cell", "__level", "__number", *names.values())
    if how == "inner":
        return hits.drop("__row")
    matched = hits.select(F.col("__row").alias("__hit")).distinct()
    if how in ("left_semi", "left_anti"):
        return p.join(matched, F.col("__row") == F.col("__hit"), how).drop("__row")
    rest = p.join(matched, F.col("__row") == F.col("__hit"), "left_anti")
    return hits.unionByName(rest, allowMissingColumns=True).drop("__row")


@dataclass(frozen=True)
class Alternative:
    """A window from `low` to `high` around each right row, held against the left time `ts`; `name` is the side it belongs to."""

    rows: DataFrame
    ts: str
    low: Column
    high: Column
    bounds: str = "[]"
    name: str = ""


def match_first(left: DataFrame, ident: Sequence[str], key: Sequence[str], alternatives: Sequence[Alternative], order: Sequence[Order],
                take: Mapping[str, str], span: int = DAY) -> DataFrame:
    """Left rows with columns of the first right row that any of several windows gives them, NULL without one.

    The windows are stacked into one interval table and the left times they ask for into one point table, so there is one
    interval join whatever their number. The first hit (by `order` over right columns, then by the position of the alternative) is
    an aggregate, which keeps one row per left row in every task. `ident` names left columns that tell left rows apart, `take`
    maps output names to right columns. Alternatives with a name give a first hit of their own each name, its columns
    prefixed with the name.
    """
    if clash := {o.col for o in order} & set(ident):
        raise ValueError(f"order columns {sorted(clash)} are columns of the left side")
    lines = list(dict.fromkeys(w.ts for w in alternatives))
    names = list(dict.fromkeys(w.name for w in alternatives))
    points = reduce(DataFrame.unionByName, [left.select(*dict.fromkeys([*ident, *key]), F.col(t).alias("__ts"), F.lit(i).alias("__line")) for i, t in enumerate(lines)])
    needed = list(dict.fromkeys([*take.values(), *[o.col for o in order]]))
    windows = [w.rows.select(*key, F.struct(*[F.col(c) for c in needed]).alias("__right"), w.low.alias("__low"), w.high.alias("__high"), F.lit(lines.index(w.ts)).alias("__line"),
                             F.lit(n).alias("__place"), F.lit(w.bounds).alias("__bounds"), F.lit(w.name).alias("__name")) for n, w in enumerate(alternatives)]
    t, low, high, bounds = (F.col(c) for c in ("__ts", "__low", "__high", "__bounds"))
    inside = ((t > low) | bounds.startswith("[")) & ((t < high) | bounds.endswith("]"))
    hits = interval_join(points, reduce(DataFrame.unionByName, windows), [*key, "__line"], "__ts", "__low", "__high", "[]", "inner", span, inside)
    hits = hits.select(*ident, "__name", "__place", "__right", *[F.col("__right").getField(o.col).alias(o.col) for o in order])
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate([*[part for o in order for part in o.rank_parts(hits)], F.col("__place")])])
    first = lambda n: F.min_by("__right", F.when(F.col("__name") == n, rank))
    best = hits.groupBy(*ident).agg(*[first(n).alias(f"__first{i}") for i, n in enumerate(names)])
    best = best.select(*ident, *[F.col(f"__first{i}").getField(src).alias(f"{n}_{out}" if n else out) for i, n in enumerate(names) for out, src in take.items()])
    return null_safe_join(left, best, list(ident), "left")


def contained_join(segs: DataFrame, ivals: DataFrame, key: Sequence[str], seg: tuple[str, str], ival: tuple[str, str],
                   how: str = "left", span: int = DAY) -> DataFrame:
    """Segments that lie fully inside an interval of the same key (bucketed by the segment's start)."""
    return interval_join(segs, ivals, key, seg[0], ival[0], ival[1], "[]", how, span, F.col(seg[1]) <= F.col(ival[1]))


def anchored(points: DataFrame, stays: DataFrame, key: Sequence[str], ts: str, anchor: str, low: Column, high: Column,
             bounds: str = "[]", span: int = DAY, stay_cols: Sequence[str] = ()) -> DataFrame:
    """Points in a window around each stay's anchor time; `low`/`high` are columns built from the stay."""
    cols = list(dict.fromkeys([*key, *stay_cols]))
    windows = stays.select(*cols, low.alias("__low"), high.alias("__high"))
    return interval_join(points, windows, key, ts, "__low", "__high", bounds, "inner", span).drop("__low", "__high")


def attach_stay(events: DataFrame, stays: DataFrame, key: Sequence[str], ts: str, before: Column, after: Column,
                bounds: str = "[)", how: str = "inner", take: Sequence[str] = ("stay_id",)) -> DataFrame:
    """Give each event the stay whose (padded) interval holds its time."""
    windows = stays.select(*key, *take, (F.col("intime") - before).alias("__low"), (F.col("outtime") + after).alias("__high"))
    return interval_join(events, windows, key, ts, "__low", "__high", bounds, how).drop("__low", "__high")


def asof_join(left: DataFrame, right: DataFrame, key: Sequence[str], ts: str, tol: int, cols: Mapping[str, str],
              right_ts: str | None = None) -> DataFrame:
    """Left rows with the columns of the most recent right row not older than `tol` microseconds.

    `cols` maps output names to right columns. Right rows must be unique per (key, time). Both sides are
    laid on one time line per (key, span of 8*tol) and the last right row is carried forward; right rows
    near the end of a span also enter the next span, so no match is lost. A NULL key matches nothing.
    """
    rts = right_ts or ts
    span = 8 * tol
    src = sorted(set(cols.values()))
    payload_type = F.struct(F.col(rts).alias("__at"), *[F.col(c).alias(c) for c in src])
    pos = micros(rts)
    home = F.floor(pos / F.lit(span)).cast("long")
    reach = pos + F.lit(tol) >= (home + 1) * F.lit(span)
    r = right.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).select(
        *key, pos.alias("__pos"), F.lit(0).alias("__side"), payload_type.alias("__payload"),
        F.explode(F.when(reach, F.array(home, home + 1)).otherwise(F.array(home))).alias("__span"),
    )
    keep = [c for c in left.columns if c not in key]
    lpos = micros(ts)
    l = left.select(
        *key, lpos.alias("__pos"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in keep]).alias("__left"),
        F.floor(lpos / F.lit(span)).cast("long").alias("__span"),
    )
    line = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*key, "__span").orderBy("__pos", "__side").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("__hit", F.last("__payload", ignorenulls=True).over(w)).filter(F.col("__side") == 1)
    fresh = F.col("__pos") - micros(F.col("__hit.__at")) <= F.lit(tol)
    hit = F.when(fresh, F.col("__hit"))
    return line.select(
        *[F.col(k) if k in key else F.col("__left").getField(k).alias(k) for k in left.columns],
        *[hit.getField(c).alias(name) for name, c in cols.items()],
    )


def star_join(spine: DataFrame, parts: Sequence[DataFrame], key: Sequence[str] | str) -> DataFrame:
    """Spine left-joined with one row per key from each part."""
    on = [key] if isinstance(key, str) else list(key)
    return reduce(lambda acc, part: acc.join(part, on, "left"), parts, spine)


def full_coalesce(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join whose key columns come from whichever side has them."""
    return a.join(b, list(on), "full")


def with_dictionary(events: DataFrame, dim: DataFrame, on: str = "itemid") -> DataFrame:
    """Attach the item dictionary; Catalyst broadcasts it while it is below the size threshold."""
    return events.join(dim, on)


def overlaps(ivals: DataFrame, stays: DataFrame, key: str, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Keys having an interval that touches the window [low, high] of their stay."""
    windows = stays.select(key, low.alias("__low"), high.alias("__high"))
    hit = (F.col(start) <= F.col("__high")) & (F.col(end) >= F.col("__low"))
    reduced = ivals.select(key, start, end).join(windows, key).filter(hit)
    return reduced.select(key).distinct()


def outside_interval(points: DataFrame, ivals: DataFrame, key: Sequence[str], ts: str, start: str, end: str,
                     bounds: str = "[]") -> DataFrame:
    """Points that no interval of their key holds."""
    return interval_join(points, ivals, key, ts, start, end, bounds, "left_anti")


def with_aggregate(df: DataFrame, agg_df: DataFrame, key: Sequence[str], fill: Mapping[str, int] | None = None) -> DataFrame:
    """Pre-aggregated values joined to every row (the set form of a correlated scalar subquery)."""
    out = df.join(agg_df, list(key), "left")
    return out.fillna(dict(fill)) if fill else out


def null_safe_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other; key columns are kept once, from the left."""
    other = b.withColumnsRenamed({c: f"__b_{c}" for c in on})
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in on])
    return a.join(other, cond, how).drop(*[f"__b_{c}" for c in on])


def explode_hours(df: DataFrame, hours: Column, out: str = "hr") -> DataFrame:
    return df.withColumn(out, F.explode(hours))


def intersect_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(*key).intersect(b.select(*key))
