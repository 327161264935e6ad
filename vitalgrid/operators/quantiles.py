"""Exact quantiles, extremes, moments and ranks by radix refinement, without gathering a group in one task.

Values are counted per (group, value). The number line is cut into outer cells (1024 for each power of two), each of
them into 2**21 inner cells, and an inner cell holds at most 2**21 different doubles. Counts are summed up these levels, and a
wanted rank goes down them: the outer cell that holds it by running counts, then the inner cell, then the value. Only
children of cells that hold a wanted rank are looked at again, and what is ordered at once (the cells of a group, the children
of a cell) has a fixed bound however many values a group has. Groups are hashed with their cells, so one large group spreads
over all tasks. Everything is derived from the one shuffle of the counts; the input is evaluated once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_BITS = 21  # of an inner cell in its outer cell
_OFFSET, _LARGEST = 1100.0, 4000.0


def inner_cell(value: Column) -> Column:
    """Number of the value's cell, in the order of the values: 2**31 cells for each power of two, at most 2**21 doubles in one.

    Rounding and logarithm keep the order; infinite values and NaN share the last cell, NULL stays NULL.
    """
    size = F.least(F.log2(F.abs(value)) + _OFFSET, F.lit(_LARGEST))
    signed = F.when(value == 0, F.lit(0.0)).when(value < 0, -size).otherwise(size)
    return F.when(value.isNotNull(), F.floor(signed * F.lit(float(1 << 31))))


def value_near(outer: Column) -> Column:
    """A value in or next to an outer cell."""
    size = F.pow(F.lit(2.0), F.least(F.abs(outer) / 1024.0 - _OFFSET, F.lit(1023.0)))
    return F.when(outer < 0, -size).otherwise(size)


class Levels:
    """Counts of (group, value) and of its cells; NULL values form a cell of their own.

    `values`: __g, __p2, __v, __n; `inner`: __g, __p1, __p2, __n; `outer`: __g, __p1, __n and the cell's sums.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], col: str, sums: bool = False) -> None:
        # a struct is never NULL, and NULL fields of two structs are equal
        base = df.select(F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)]).alias("__g"), F.col(col).cast("double").alias("__v"))
        counts = base.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n"))
        self.values = counts.withColumn("__p2", inner_cell(F.col("__v"))).withColumn("__p1", F.shiftright("__p2", LOW_BITS))
        more, again = [], []
        if sums:
            # distances from a value near the cell keep the squares small
            gap = F.col("__v") - value_near(F.col("__p1"))
            more = [F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum(F.col("__n") * F.col("__v")).alias("__s"),
                    F.sum(F.col("__n") * gap).alias("__s1"), F.sum(F.col("__n") * gap * gap).alias("__s2")]
            again = [F.min("__low").alias("__low"), F.max("__high").alias("__high"), *[F.sum(c).alias(c) for c in ("__s", "__s1", "__s2")]]
        self.inner = self.values.groupBy("__g", "__p1", "__p2").agg(F.sum("__n").alias("__n"), *more)
        self.outer = self.inner.groupBy("__g", "__p1").agg(F.sum("__n").alias("__n"), *again)


def _before(*parent: str, order: str) -> Column:
    """Values below a cell among the children of its parent."""
    w = Window.partitionBy(*parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.when(F.col(order).isNotNull(), F.col("__n"))).over(w), F.lit(0))


def _descend(cells: DataFrame, wanted: DataFrame, parent: str, order: str, carried: Sequence[str]) -> DataFrame:
    """Children that hold a wanted rank; ranks are counted from the first value of the child."""
    w = wanted.select(F.col("__g").alias("__gw"), F.col(parent).alias("__parent"), "__want", *carried)
    d = cells.join(w, (F.col("__g") == F.col("__gw")) & (F.col(parent) == F.col("__parent"))).drop("__gw", "__parent")
    d = d.withColumn("__below", _before("__g", parent, order=order))
    return _holding(d)


def _holding(d: DataFrame) -> DataFrame:
    inside = F.filter("__want", lambda w: (w["left"] >= F.col("__below")) & (w["left"] < F.col("__below") + F.col("__n")))
    moved = F.transform(inside, lambda w: F.struct(w["rank"].alias("rank"), (w["left"] - F.col("__below")).alias("left")))
    return d.withColumn("__want", moved).filter(F.size("__want") > 0).drop("__below")


STATS = ("rows", "count", "min", "max", "sum", "mean", "sd")


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Mapping[str, float], count: str | None = None,
                    stats: Mapping[str, str] | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per group with the continuous quantiles of `col`; NULL values are left out.

    `probs` maps output column to probability, `count` names an optional column with the number of values. `stats` maps
    further columns to one of STATS from the same counts (`rows` includes NULL values). Groups without any value are absent
    unless `keep_empty`.
    """
    stats = {**({count: "count"} if count else {}), **(stats or {})}
    if unknown := set(stats.values()) - set(STATS):
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    sums = bool(set(stats.values()) - {"rows", "count"})
    levels = Levels(df, by, col, sums)
    whole = Window.partitionBy("__g")
    n = F.when(F.col("__p1").isNotNull(), F.col("__n"))
    top = levels.outer.withColumns({"__below": _before("__g", order="__p1"), "__total": F.coalesce(F.sum(n).over(whole), F.lit(0)), "__rows": F.sum("__n").over(whole)})
    facts = {"rows": F.col("__rows"), "count": F.col("__total")}
    if sums:
        top = top.withColumns({"__min": F.min("__low").over(whole), "__max": F.max("__high").over(whole), "__sum": F.sum("__s").over(whole)})
        mean = F.col("__sum") / F.nullif(F.col("__total"), F.lit(0))
        gap = mean - value_near(F.col("__p1"))
        square = F.col("__s2") - 2 * gap * F.col("__s1") + F.col("__n") * gap * gap
        top = top.withColumn("__squares", F.sum(F.when(F.col("__p1").isNotNull(), square)).over(whole))
        facts |= {"min": F.col("__min"), "max": F.col("__max"), "sum": F.col("__sum"), "mean": mean,
                  "sd": F.sqrt(F.greatest(F.col("__squares"), F.lit(0.0)) / F.nullif(F.col("__total") - 1, F.lit(0)))}
    rank = lambda p, edge: edge(F.lit(float(p)) * (F.col("__total") - 1)).cast("long")
    ranks = F.array_distinct(F.array(*[rank(p, edge) for p in probs.values() for edge in (F.floor, F.ceil)]))
    fact = F.struct(F.col("__total").alias("total"), *[facts[s].alias(s) for s in dict.fromkeys(stats.values())]).alias("__fact")
    top = top.select("__g", "__p1", "__n", "__below", "__total", fact, F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("left"))).alias("__want"))
    wanted = _holding(top.filter(F.col("__p1").isNotNull()))
    wanted = _descend(levels.inner.select("__g", "__p1", "__p2", "__n"), wanted, "__p1", "__p2", ["__fact"])
    found = _descend(levels.values.select("__g", "__p2", "__v", "__n"), wanted, "__p2", "__v", ["__fact"]).select("__g", "__v", "__want", "__fact")
    if keep_empty:
        none = top.filter(F.col("__total") == 0)
        found = found.unionByName(none.select("__g", F.lit(None).cast("double").alias("__v"), "__want", "__fact"))
    total = F.col("__fact.total")
    at = lambda p, edge: F.max(F.when(F.exists("__want", lambda w: w["rank"] == edge(F.lit(float(p)) * (total - 1)).cast("long")), F.col("__v")))
    aggs = [at(p, edge).alias(f"__{tag}_{name}") for name, p in probs.items() for tag, edge in (("lo", F.floor), ("hi", F.ceil))]
    picked = found.groupBy("__g").agg(F.first("__fact").alias("__facts"), *aggs)

    def between(name: str, p: float) -> Column:
        low, high, r = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.lit(float(p)) * (F.col("__facts.total") - 1)
        return F.when(low == high, low).otherwise(low + (high - low) * (r - F.floor(r))).alias(name)
    return picked.select(*[F.col(f"__g.k{i}").alias(b) for i, b in enumerate(by)], *[between(name, p) for name, p in probs.items()],
                         *[F.col(f"__facts.{kind}").alias(name) for name, kind in stats.items()])


def exact_median(df: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    return exact_quantiles(df, by, col, {out: 0.5})


def ranked_values(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Per group and distinct value: `below`, the number of smaller values, and `n`, that of equal ones. NULL values are left out."""
    levels = Levels(df.filter(F.col(col).isNotNull()), by, col)
    outer = levels.outer.select(F.col("__g").alias("__go"), F.col("__p1").alias("__o"), _before("__g", order="__p1").alias("__b1"))
    inner = levels.inner.withColumn("__b2", _before("__g", "__p1", order="__p2")).join(outer, (F.col("__g") == F.col("__go")) & (F.col("__p1") == F.col("__o")))
    inner = inner.select(F.col("__g").alias("__gi"), F.col("__p2").alias("__i"), (F.col("__b1") + F.col("__b2")).alias("__b12"))
    values = levels.values.withColumn("__b3", _before("__g", "__p2", order="__v")).join(inner, (F.col("__g") == F.col("__gi")) & (F.col("__p2") == F.col("__i")))
    return values.select(*[F.col(f"__g.k{i}").alias(b) for i, b in enumerate(by)], F.col("__v").alias(col), (F.col("__b12") + F.col("__b3")).alias("below"), F.col("__n").alias("n"))
