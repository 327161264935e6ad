"""Many conditions at once: every event table is read a single time, however many conditions ask about it.

Conditions are compiled to a rule table (item, field, test, operand, aggregate, hours). An event table is cut to the
wanted items, meets the rules by item, and one expression over the rule's columns decides each (event, rule); its size
does not depend on the number of rules. Events outside ICU tables find their stay and hour windows are arithmetic on one grid
row per stay, both once for all rules. One aggregate per (rule, stay) then holds everything any rule needs (a flag, extremes,
weighted sum and count), so a table costs one scan and one shuffle of its rows (sums and means a second one of their parts). Medians are the exception: if a table has rules
with one, their rows go through the exact quantiles in a second reading, again once for all of them.

The results are those of `match_events` for each condition, tagged with the condition's number.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.scalars import guarded_number, shift, upper_trim
from ..sources.schemas import EventSpec
from .joins import attach_stay
from .predicates import KEYS, TEXT_TESTS, TIMES, Condition, number_test, row_test, stay_hours
from .quantiles import exact_median
from .reshape import hours_touching
from .sums import BINADE, binade, exact_count, exact_sum, partial_sums

#: Above this many rules the rule table is joined without a broadcast, and items are no longer listed in the scan's filter.
MOST_BROADCAST, MOST_LISTED = 50_000, 1_000

RULE = "__leaf int, __item long, __field string, __kind string, __op string, __text string, __number double, __moment timestamp_ntz, __agg string, __h0 int, __h1 int"
MULTIPLE = ("sum", "mean", "median")


def compile_rule(leaf: int, cond: Condition, schema: StructType) -> tuple:
    """The rule of one condition; refuses what `match_events` refuses."""
    cond.check()
    kind = schema[cond.field].dataType
    test, number = row_test(cond, kind)
    if test is None:
        number_test(cond, number, kind)
    text = operand = moment = None
    op, agg = cond.constraint, cond.agg
    if op == "Exist":
        what = "exist"
    elif number is None:
        what = "text"
        text = f"%{cond.value}%" if op in ("Contains", "Not Contains") else str(cond.value).strip().upper() if op in TEXT_TESTS else "1" if op == "Is True" else "0"
    elif isinstance(kind, TIMES):
        what, value = "time", cond.value
        moment = value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time()) if isinstance(value, dt.date) else dt.datetime.fromisoformat(str(value))
    else:
        what = "number"
        operand = {"Is True": 1.0, "Is False": 0.0}.get(op)
        operand = float(cond.value) if operand is None else operand
        op = "=" if cond.constraint in ("Is True", "Is False") else op
    if what not in ("number", "time"):
        agg = None
    h0, h1 = cond.hours or (None, None)
    return leaf, cond.itemid, cond.field, what, op, text, operand, moment, agg, h0, h1


def rule_table(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    """The rules as a table; it is broadcast while its known size allows."""
    table = spark.createDataFrame(list(rules), RULE)
    return F.broadcast(table) if len(rules) <= MOST_BROADCAST else table


def _compared(value: Column, operand: Column) -> Column:
    op = F.col("__op")
    return (F.when(op == "=", value == operand).when(op == "<>", value != operand).when(op == "<", value < operand)
            .when(op == ">", value > operand).when(op == "<=", value <= operand).when(op == ">=", value >= operand))


def _field(fields: Sequence[str], reading: Callable[[str], Column], none: str) -> Column:
    """The reading of the field that the rule names."""
    return reduce(lambda c, f: F.when(F.col("__field") == f, reading(f)).otherwise(c), fields, F.lit(None).cast(none))


def _tested(events: DataFrame, rules: Sequence[tuple], spec: EventSpec) -> DataFrame:
    """One row per (event, rule) that counts: keys, time, rule, __num or __at to aggregate."""
    fields = sorted({r[2] for r in rules})
    kinds = {f: events.schema[f].dataType for f in fields}
    texts = [f for f in fields if isinstance(kinds[f], StringType)]
    times = [f for f in fields if isinstance(kinds[f], TIMES)]
    items = sorted({r[1] for r in rules})
    d = events.filter(F.col("itemid").isin(items)) if len(items) <= MOST_LISTED else events
    keys = [k for k in KEYS if k in events.columns] if spec.scope == "icu" else ["subject_id", "hadm_id"]
    d = d.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("itemid").alias("__event"), F.col(spec.time).alias("__ts"), *[F.col(f).alias(f"__v_{f}") for f in fields])
    d = d.join(rule_table(events.sparkSession, rules), F.col("__event") == F.col("__item"))
    value = lambda f: F.col(f"__v_{f}")
    text = _field(texts, value, "string")
    number = _field([f for f in fields if f not in times], lambda f: guarded_number(value(f)) if f in texts else value(f).cast("double"), "double")
    moment = _field(times, lambda f: value(f).cast("timestamp_ntz"), "timestamp_ntz")
    d = d.withColumns({"__num": F.when(F.col("__kind") == "number", number), "__at": F.when(F.col("__kind") == "time", moment)})
    op = F.col("__op")
    like = F.like(text, F.col("__text"))
    by_text = F.when(op == "Contains", like).when(op == "Not Contains", ~like).when(op == "Is", upper_trim(text) == F.col("__text")).when(
        op == "Is Not", upper_trim(text) != F.col("__text")).otherwise(text == F.col("__text"))
    hit = (F.when(F.col("__kind") == "exist", True).when(F.col("__kind") == "text", by_text)
           .when(F.col("__kind") == "number", _compared(F.col("__num"), F.col("__number"))).otherwise(_compared(F.col("__at"), F.col("__moment"))))
    d = d.filter(F.col("__agg").isNotNull() | hit)
    return d.select(*[F.col(f"__{k}").alias(k) for k in keys], "__ts", "__leaf", "__agg", "__num", "__at", "__h0", "__h1")


def _in_hours(d: DataFrame, times: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Rows inside the hours of their rule, with the number of grid hours they count for."""
    if all(r[9] is None for r in rules):
        return d.withColumn("__weight", F.lit(1))
    grid = stay_hours(times).withColumnRenamed("stay_id", "__stay")
    d = d.join(grid, F.col("stay_id") == F.col("__stay"), "left").drop("__stay")
    low, high = F.greatest("__h0", F.lit(-24)).cast("long"), F.least(F.col("__h1").cast("long"), F.col("last_hr"))
    d = d.withColumns({"__low": low, "__high": high})
    inside = (F.col("__low") <= F.col("__high")) & F.col("__ts").between(shift("anchor", F.col("__low") - 1, "hour"), shift("anchor", F.col("__high"), "hour"))
    touched = F.size(F.filter(hours_touching("__ts", "anchor"), lambda h: (h >= F.col("__low")) & (h <= F.col("__high"))))
    d = d.filter(F.col("__h0").isNull() | inside)
    return d.withColumn("__weight", F.when(F.col("__h0").isNotNull() & F.col("__agg").isin(*MULTIPLE), touched).otherwise(1)).drop("anchor", "last_hr", "__low", "__high")


def match_table(events: DataFrame, spec: EventSpec, conds: Sequence[tuple[int, Condition]], stays: DataFrame, times: DataFrame | None = None,
                cohort: DataFrame | None = None, keep_unmatched: bool = False) -> DataFrame:
    """(__leaf, subject_id, hadm_id, stay_id) of all conditions on one event table."""
    rules = [compile_rule(leaf, c, events.schema) for leaf, c in conds]
    if times is None and any(r[9] is not None for r in rules):
        raise ValueError("an hour window needs the heart-rate times of the stays")
    d = _tested(events, rules, spec)
    if spec.scope != "icu":
        how = "left" if keep_unmatched and cohort is None else "inner"
        d = attach_stay(d, stays, ["subject_id", "hadm_id"], "__ts", F.make_dt_interval(F.lit(1)), F.make_dt_interval(F.lit(0), F.lit(1)), "[]", how)
        found = F.col("stay_id").isNotNull()
        d = d.withColumns({k: F.when(found, F.col(k)) for k in KEYS})
    d = _in_hours(d, times, rules)
    if cohort is not None:
        # a key listed several times counts as often in sums, as in a plain join
        d = d.join(cohort.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__listed")), list(KEYS)).withColumn("__weight", F.col("__weight") * F.col("__listed"))
    group = ["__leaf", *KEYS]
    plain = d.filter(F.coalesce(F.col("__agg"), F.lit("")) != "median") if any(r[8] == "median" for r in rules) else d
    extremes = [F.min("__num").alias("__min"), F.max("__num").alias("__max"), F.min("__at").alias("__first"), F.max("__at").alias("__last")]
    if any(r[8] in ("sum", "mean") for r in rules):
        # only sums and means are cut by binade
        parts = plain.withColumn(BINADE, F.when(F.col("__agg").isin("sum", "mean"), binade("__num")))
        parts = parts.groupBy(*group, BINADE).agg(*extremes, *partial_sums("__num", F.col("__weight")))
        per_stay = parts.groupBy(*group).agg(F.min("__min").alias("__min"), F.max("__max").alias("__max"), F.min("__first").alias("__first"), F.max("__last").alias("__last"),
                                             exact_sum().alias("__sum"), exact_count().alias("__n"))
    else:
        none = F.lit(None).cast("double")
        per_stay = plain.groupBy(*group).agg(*extremes).withColumns({"__sum": none, "__n": none})
    grouped = [r for r in rules if r[8] is not None]
    if not grouped:
        return per_stay.select(*group)
    j = per_stay.join(rule_table(events.sparkSession, rules).withColumnRenamed("__leaf", "__rule"), F.col("__leaf") == F.col("__rule"))
    agg = F.col("__agg")
    value = (F.when(agg == "min", F.col("__min")).when(agg == "max", F.col("__max")).when(agg == "sum", F.col("__sum")).when(agg == "mean", F.col("__sum") / F.col("__n")))
    at = F.when(agg == "min", F.col("__first")).when(agg == "max", F.col("__last"))
    ok = agg.isNull() | F.when(F.col("__kind") == "time", _compared(at, F.col("__moment"))).otherwise(_compared(value, F.col("__number")))
    out = j.filter(ok).select(*group)
    middle = [r for r in rules if r[8] == "median"]
    if middle:
        rows = d.filter(agg == "median").withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__weight").cast("long"))))
        m = exact_median(rows, group, "__num", "__value").join(rule_table(events.sparkSession, middle).withColumnRenamed("__leaf", "__rule"), F.col("__leaf") == F.col("__rule"))
        out = out.unionByName(m.filter(_compared(F.col("__value"), F.col("__number"))).select(*group))
    return out


class SharedScan:
    """Matches conditions over the tables that `table` gives by name; `many` reads each of them once for all conditions."""

    def __init__(self, table: Callable[[str], DataFrame], stays: DataFrame, times: DataFrame | None = None, cohort: DataFrame | None = None,
                 keep_unmatched: bool = False) -> None:
        self.table, self.stays, self.times, self.cohort, self.keep_unmatched = table, stays, times, cohort, keep_unmatched

    def __call__(self, cond: Condition) -> DataFrame:
        return self.many([cond]).select(*KEYS)

    def many(self, conds: Sequence[Condition]) -> DataFrame:
        """(__leaf, subject_id, hadm_id, stay_id): the keys that meet condition number __leaf, each once."""
        if not conds:
            raise ValueError("no conditions")
        by_table: dict[str, list[tuple[int, Condition]]] = {}
        for i, c in enumerate(conds):
            c.check()
            by_table.setdefault(c.table, []).append((i, c))
        parts = [match_table(self.table(name), own[0][1].check(), own, self.stays, self.times, self.cohort, self.keep_unmatched) for name, own in by_table.items()]
        return reduce(DataFrame.unionByName, parts)
