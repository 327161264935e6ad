"""Sums of doubles that do not depend on the order of the rows.

A plain sum of doubles changes in its last bits with the order in which rows meet, so a mean that equals a limit may fall on
either side of it. Here values are summed by binade (values of one exponent) as integers, which is exact, and the few binades
of a group are added from the highest down with the rounding errors carried along. Rows are aggregated twice: by group and
binade with `partial_sums`, then by group with `exact_sum` and `exact_count`.

Values of 2**900 or more, infinite ones and NaN are added plainly; bits below 2**-1013 are lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINADE = "__binade"
_LOW, _HALF = 27, 30


def binade(value: Column | str) -> Column:
    """Exponent of the value (one off at most, beside a power of two); NULL for 0 and for what is added plainly."""
    v = F.col(value) if isinstance(value, str) else value
    size = F.abs(v)
    return F.when((size > 0) & (size < 2.0 ** 900), F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(-960)))


def partial_sums(value: Column | str, times: Column | None = None) -> list[Column]:
    """Aggregates by group and binade; a row counts `times` times."""
    v = F.col(value) if isinstance(value, str) else value
    n = F.lit(1) if times is None else times
    whole = (v * F.pow(F.lit(2.0), F.lit(53) - F.col(BINADE))).cast("long")
    plain = F.when(F.col(BINADE).isNull(), v)
    return [F.sum(F.shiftright(whole, _LOW) * n).alias("__hi"), F.sum(whole.bitwiseAND(F.lit((1 << _LOW) - 1)) * n).alias("__lo"),
            F.sum(plain * n).alias("__plain"), F.sum(F.when(v.isNotNull(), n)).alias("__count")]


def _terms(part: Column) -> Column:
    """A binade's sum as four doubles that hold it exactly."""
    out = []
    for name, shift in (("hi", _LOW), ("lo", 0)):
        n = part[name]
        for m, more in ((F.shiftright(n, _HALF), _HALF), (n.bitwiseAND(F.lit((1 << _HALF) - 1)), 0)):
            out.append(m.cast("double") * F.pow(F.lit(2.0), part["e"] + F.lit(shift + more - 53)))
    return F.array(*out)


def _add(acc: Column, x: Column) -> Column:
    """Sum and carried error after one more term."""
    s = acc["s"] + x
    of_x = s - acc["s"]
    error = (acc["s"] - (s - of_x)) + (x - of_x)
    return F.struct(s.alias("s"), (acc["c"] + error).alias("c"))


def exact_count(only: Column | None = None) -> Column:
    """Values of a group that are not NULL, among the partial sums for which `only` holds; 0 becomes NULL."""
    n = F.col("__count") if only is None else F.when(only, F.col("__count"))
    return F.nullif(F.sum(n), F.lit(0))


def exact_sum(only: Column | None = None) -> Column:
    """Sum of a group from its partial sums; NULL without values."""
    held = F.col(BINADE).isNotNull() if only is None else F.col(BINADE).isNotNull() & only
    # a group has at most 1860 binades
    parts = F.collect_list(F.when(held, F.struct((-F.col(BINADE)).alias("o"), F.col(BINADE).alias("e"), F.col("__hi").alias("hi"), F.col("__lo").alias("lo"))))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    total = F.aggregate(F.flatten(F.transform(F.array_sort(parts), _terms)), zero, _add, lambda acc: acc["s"] + acc["c"])
    plain = F.sum(F.col("__plain") if only is None else F.when(only, F.col("__plain")))
    return F.when(exact_count(only).isNotNull(), total + F.coalesce(plain, F.lit(0.0)))
