"""One cohort condition: which stays have an event of an item that meets a constraint.

Result: distinct (subject_id, hadm_id, stay_id). Text constraints ignore the aggregate; comparisons (and
numeric Is True / Is False) apply to the aggregate per stay when one is given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, TimestampNTZType, TimestampType

from ..functions.scalars import guarded_number, like_contains, shift, upper_trim
from ..sources.schemas import EVENTS, EventSpec
from .joins import attach_stay, interval_join
from .quantiles import exact_median
from .reshape import grid_bounds, hours_touching
from .sums import BINADE, binade, exact_count, exact_sum, partial_sums

KEYS = ("subject_id", "hadm_id", "stay_id")
COMPARISONS = ("=", "<>", "<", ">", "<=", ">=")
TEXT_TESTS = ("Contains", "Not Contains", "Is", "Is Not")
AGGREGATES = ("min", "mean", "max", "sum", "median")


@dataclass(frozen=True)
class Condition:
    """item, field, constraint, value; optional aggregate and window of ICU hours."""

    table: str
    itemid: int
    field: str
    constraint: str
    value: object = None
    agg: str | None = None
    hours: tuple[int, int] | None = None

    def check(self) -> EventSpec:
        if self.table not in EVENTS:
            raise ValueError(f"unknown event table {self.table}")
        spec = EVENTS[self.table]
        if isinstance(self.itemid, bool) or not isinstance(self.itemid, int):
            raise ValueError("itemid must be a number")
        if self.field not in spec.fields:
            raise ValueError(f"{self.field} is not a field of {self.table}")
        if self.constraint not in (*COMPARISONS, *TEXT_TESTS, "Exist", "Is True", "Is False"):
            raise ValueError(f"unknown constraint {self.constraint}")
        if self.agg is not None and self.agg not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.agg}")
        return spec


def compare(c: Column, op: str, value) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return {"=": c == v, "<>": c != v, "<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[op]


TIMES = (TimestampType, TimestampNTZType, DateType)


def row_test(cond: Condition, kind: DataType) -> tuple[Column | None, Column | None]:
    """(test on the row, number or time to aggregate and compare); exactly one may be None."""
    f, is_text = F.col(cond.field), isinstance(kind, StringType)
    c = cond.constraint
    if c == "Exist":
        return F.lit(True), None
    if is_text:
        if c == "Contains":
            return like_contains(f, str(cond.value)), None
        if c == "Not Contains":
            return ~like_contains(f, str(cond.value)), None
        if c == "Is":
            return upper_trim(f) == str(cond.value).strip().upper(), None
        if c == "Is Not":
            return upper_trim(f) != str(cond.value).strip().upper(), None
        if c in ("Is True", "Is False"):
            return f == ("1" if c == "Is True" else "0"), None
        return None, guarded_number(f)
    if c in TEXT_TESTS:
        raise ValueError(f"{c} needs a text field, {cond.field} is none")
    if isinstance(kind, TIMES):
        if c in ("Is True", "Is False"):
            raise ValueError(f"{c} needs a number or text, {cond.field} is a time")
        if cond.agg not in (None, "min", "max"):
            raise ValueError(f"{cond.agg} of a time is not defined")
        return None, f.cast("timestamp_ntz")
    return None, f.cast("double")


def number_test(cond: Condition, number: Column, kind: DataType) -> Column:
    """The comparison; times compare with a datetime, a date or ISO text."""
    if isinstance(kind, TIMES):
        return compare(number, cond.constraint, F.lit(str(cond.value)).cast("timestamp_ntz"))
    if cond.constraint in ("Is True", "Is False"):
        return number == F.lit(1.0 if cond.constraint == "Is True" else 0.0)
    return compare(number, cond.constraint, float(cond.value))


def stay_hours(times: DataFrame) -> DataFrame:
    """Hour-grid anchor and last hour per stay from first and last heart-rate times."""
    return grid_bounds(times, ["stay_id"], "intime_hr", "outtime_hr")


def in_hours(events: DataFrame, times: DataFrame, ts: str, hours: tuple[int, int], per_hour: bool) -> DataFrame:
    """Events inside the grid hours h0..h1, both ends of every hour included.

    With `per_hour` an event on a full hour counts once for each of the two hours it touches.
    """
    b = stay_hours(times).withColumns({
        "__h0": F.greatest(F.lit(hours[0]), F.lit(-24)).cast("long"), "__h1": F.least(F.lit(hours[1]).cast("long"), F.col("last_hr"))})
    b = b.filter(F.col("__h0") <= F.col("__h1")).select(
        "stay_id", "anchor", "__h0", "__h1", shift("anchor", F.col("__h0") - 1, "hour").alias("__from"), shift("anchor", F.col("__h1"), "hour").alias("__to"))
    d = interval_join(events, b, ["stay_id"], ts, "__from", "__to", "[]")
    if per_hour:
        touched = F.filter(hours_touching(ts, "anchor"), lambda h: (h >= F.col("__h0")) & (h <= F.col("__h1")))
        d = d.withColumn("hr", F.explode(touched))
    return d.drop("anchor", "__h0", "__h1", "__from", "__to")


def aggregated(d: DataFrame, agg: str) -> DataFrame:
    """One row per stay with the aggregate of __num; sums and means do not depend on the order of the rows."""
    if agg in ("min", "max"):
        return d.groupBy(*KEYS).agg({"min": F.min, "max": F.max}[agg]("__num").alias("__agg"))
    parts = d.withColumn(BINADE, binade("__num")).groupBy(*KEYS, BINADE).agg(*partial_sums("__num"))
    return parts.groupBy(*KEYS).agg((exact_sum() if agg == "sum" else exact_sum() / exact_count()).alias("__agg"))


def match_events(events: DataFrame, stays: DataFrame, times: DataFrame | None, cond: Condition, cohort: DataFrame | None = None,
                 keep_unmatched: bool = False) -> DataFrame:
    """Keys of the stays that meet the condition.

    `events` is the table named by the condition (with itemid), `times` the heart-rate times of the stays
    (needed for an hour window), `cohort` optional keys the search is limited to. Events outside ICU tables
    take the stay whose padded time range holds them; `keep_unmatched` keeps the all-NULL key of those
    without one.
    """
    spec = cond.check()
    kind = events.schema[cond.field].dataType
    test, number = row_test(cond, kind)
    d = events.filter(F.col("itemid") == cond.itemid)
    if test is not None:
        d = d.filter(test)
    elif cond.agg is None:
        d = d.filter(number_test(cond, number, kind))
    carried = [F.col(spec.time).alias("__ts")] + ([number.alias("__num")] if number is not None else [])
    if spec.scope == "icu":
        d = d.select(*KEYS, *carried)
    else:
        how = "inner" if cond.hours or cohort is not None or not keep_unmatched else "left"
        d = attach_stay(d.select("subject_id", "hadm_id", *carried), stays, ["subject_id", "hadm_id"], "__ts",
                        F.make_dt_interval(F.lit(1)), F.make_dt_interval(F.lit(0), F.lit(1)), "[]", how)
        unmatched = F.col("stay_id").isNull()
        d = d.select(*[F.when(~unmatched, F.col(k)).alias(k) for k in KEYS], *[c for c in d.columns if c.startswith("__")])
    grouped = cond.agg is not None and number is not None
    if cond.hours:
        if times is None:
            raise ValueError("an hour window needs the heart-rate times of the stays")
        d = in_hours(d, times, "__ts", cond.hours, per_hour=grouped and cond.agg in ("sum", "mean", "median"))
    if cohort is not None:
        d = d.join(cohort.select(*KEYS), list(KEYS), "inner" if grouped else "left_semi")
    if not grouped:
        return d.select(*KEYS).distinct()
    if cond.agg == "median":
        per_stay = exact_median(d, list(KEYS), "__num", "__agg")
    else:
        per_stay = aggregated(d, cond.agg)
    return per_stay.filter(number_test(cond, F.col("__agg"), kind)).select(*KEYS)


def clean(series: DataFrame, drop_stays: list[int], lo: float, hi: float) -> DataFrame:
    """Leave out listed stays and values outside [lo, hi] (NULL values go)."""
    d = series.filter(~F.col("stay_id").isin(drop_stays)) if drop_stays else series
    return d.filter(F.col("value").between(lo, hi))


def admissions_with_stay(adm: DataFrame, stays: DataFrame) -> DataFrame:
    return adm.join(stays.select("hadm_id").distinct(), "hadm_id", "left_semi")


def search_names(catalogue: DataFrame, name: str, text: str, n: int | None = None) -> DataFrame:
    """Entries whose name holds the text in any case; with n, the first n in the order of name, then of all columns."""
    found = catalogue.filter(F.lower(F.col(name)).contains(text.lower()))
    return found if n is None else found.orderBy(name, *[c for c in catalogue.columns if c != name]).limit(n)


def search_ids(df: DataFrame, col: str, prefix: str, n: int | None = None) -> DataFrame:
    """Rows whose id starts with the digits; with n, the first n in the order of id, then of all columns."""
    found = df.filter(F.col(col).cast("string").startswith(prefix))
    return found if n is None else found.orderBy(col, *[c for c in df.columns if c != col]).limit(n)
