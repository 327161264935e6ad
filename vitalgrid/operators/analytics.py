"""Series of one item for a cohort, time bins, strata, comparisons and descriptive tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import NUMBER_PATTERN, age_by_year, cut, guarded_number, shift, span_days
from ..sources.schemas import EVENTS
from .joins import attach_stay
from .predicates import compare, in_hours
from .quantiles import exact_quantiles, ranked_values
from .windows import Order, top_k


# --- series and bins ----------------------------------------------------------------------------------
def cohort_item_series(events: DataFrame, table: str, itemid: int, field: str, cohort: DataFrame, stays: DataFrame, times: DataFrame,
                       force_number: bool = False) -> DataFrame:
    """value, stay, ICU hour and unit of one item for the stays of a cohort.

    Outside ICU tables an event belongs to the stay whose time range, padded by a day, holds it.
    An event on a full hour appears in both hours.
    """
    spec = EVENTS[table]
    if field not in spec.fields:
        raise ValueError(f"{field} is not a field of {table}")
    d = events.filter(F.col("itemid") == itemid)
    value = guarded_number(field) if force_number and isinstance(events.schema[field].dataType, StringType) else F.col(field)
    unit = F.col(spec.uom[field]) if field in spec.uom and spec.uom[field] in events.columns else F.lit(None).cast("string")
    cols = [F.col(spec.time).alias("__ts"), value.alias("value"), unit.alias("unitname")]
    wanted = cohort.select("stay_id").filter(F.col("stay_id").isNotNull()).distinct()
    if spec.scope == "icu":
        d = d.select("stay_id", *cols).join(wanted, "stay_id", "left_semi")
    else:
        day = F.make_dt_interval(F.lit(1))
        mine = stays.join(wanted, "stay_id", "left_semi")
        d = attach_stay(d.select("subject_id", "hadm_id", *cols), mine, ["subject_id", "hadm_id"], "__ts", day, day, "[)").select("stay_id", "__ts", "value", "unitname")
    span = in_hours(d, times, "__ts", (-24, 2**31 - 1), per_hour=True)
    return span.select("value", "stay_id", F.col("hr").cast("int").alias("hr"), "unitname")


def bin_breaks(start: int, end: int, step: int) -> list[int]:
    """Bin limits; a step longer than the span is cut to it."""
    step = min(step, end - start)
    return list(range(start, end + 1, step))


_FN: dict[str, Callable] = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def aggregate_bins(df: DataFrame, by: Sequence[str], fn: str, value: str = "value") -> DataFrame:
    """One aggregate per (bin, stay); NULL for a group without values."""
    if fn == "median":
        return exact_quantiles(df, by, value, {"aggr": 0.5}, keep_empty=True)
    return df.groupBy(*by).agg(_FN[fn](value).alias("aggr"))


def bin_aggregate(series: DataFrame, start: int, end: int, step: int, fn: str, per_hour: bool = False) -> DataFrame:
    """Hours in [start, end] to bins, then one aggregate per (bin, stay); `per_hour` bins by hour."""
    d = series.filter(F.col("hr").between(start, end))
    bins = F.col("hr").cast("string") if per_hour else cut("hr", bin_breaks(start, end, step))
    return aggregate_bins(d.withColumn("interval", bins), ["interval", "stay_id"], fn)


def trajectory(df: DataFrame, by: Sequence[str] = ("interval", "strat"), value: str = "aggr") -> DataFrame:
    """Quartiles and number of observations per bin and stratum."""
    q = exact_quantiles(df, by, value, {"ymin": 0.25, "median_aggr": 0.5, "ymax": 0.75}, stats={"n": "rows"}, keep_empty=True)
    return q.select(*by, "n", "ymin", "median_aggr", "ymax")


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Five-number summary and count per group."""
    q = exact_quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, stats={"n": "count", "low": "min", "high": "max"}, keep_empty=True)
    return q.select(*by, "n", "low", "q1", "median", "q3", "high")


def histogram(df: DataFrame, by: Sequence[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; 0 and bins+1 hold values outside."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, F.expr(f"width_bucket({value}, double({lo}), double({hi}), {bins})").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def unit_check(series: DataFrame, by: Sequence[str] = ("itemid",), unit: str = "valueuom") -> DataFrame:
    """Distinct units per item (blank and `None` aside) and whether there are several."""
    d = series.filter(F.col(unit).isNotNull() & (F.col(unit) != "None")).select(*by, unit).distinct()
    return d.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(unit)), ",").alias("units"), F.count(F.lit(1)).alias("n_units")).withColumn(
        "inconsistent", F.col("n_units") > 1)


def numeric_items(df: DataFrame, by: Sequence[str] = ("itemid",), value: str = "value") -> DataFrame:
    """Per item whether every value that is present reads as a number."""
    ok = F.coalesce(F.col(value).rlike(NUMBER_PATTERN), F.lit(True))
    return df.groupBy(*by).agg(F.bool_and(ok).alias("is_numeric"), F.count(value).alias("n"))


def item_preview(events: DataFrame, itemid: int | None, field: str) -> DataFrame:
    """min, quartiles, mean and max of an item's field (text is read as number where it is one)."""
    d = events if itemid is None else events.filter(F.col("itemid") == itemid)
    v = guarded_number(field) if isinstance(events.schema[field].dataType, StringType) else F.col(field).cast("double")
    d = d.select("itemid", v.alias("v"))
    return exact_quantiles(d, ["itemid"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75}, stats={"min": "min", "mean": "mean", "max": "max"}, keep_empty=True).select(
        "itemid", "min", "q25", "median", "mean", "q75", "max")


def value_preview(events: DataFrame, itemid: int, field: str, param_type: str | None = None) -> tuple[str, DataFrame]:
    """What to show for an item: kind, and its distinct texts or its number summary.

    Without a declared type a text field counts as numeric when more than half of its values read as numbers.
    """
    d = events.filter(F.col("itemid") == itemid)
    if param_type == "Checkbox":
        return "checkbox", d.sparkSession.createDataFrame([("1",), ("0",)], "value string")
    numeric = param_type == "Numeric" or not isinstance(events.schema[field].dataType, StringType)
    if not numeric and param_type != "Text":
        seen = d.agg(F.count_if(F.col(field).rlike(NUMBER_PATTERN)).alias("numbers"), F.count(field).alias("n")).first()
        numeric = seen["numbers"] > seen["n"] / 2
    if numeric and param_type != "Text":
        return "numeric", item_preview(events, itemid, field)
    return "text", d.select(F.col(field).alias("value")).distinct()


# --- strata ------------------------------------------------------------------------------------------
def stratify_by_stays(df: DataFrame, stays: DataFrame, label: str = "Event condition", others: str = "Others") -> DataFrame:
    """Rows of the listed stays get the label, all others `others`."""
    hit = stays.select("stay_id").filter(F.col("stay_id").isNotNull()).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, "stay_id", "left").withColumn("strat", F.when(F.col("__hit"), label).otherwise(others)).drop("__hit")


def stratify_by_demographic(df: DataFrame, kind: str, stays: DataFrame, adm: DataFrame, patients: DataFrame, op: str | None = None,
                            value: float | None = None) -> DataFrame:
    """Strata from gender, age, admission length, death in hospital or within a year of discharge."""
    who = stays.select("stay_id", "hadm_id", "subject_id").join(patients.select("subject_id", "gender", "anchor_age", "anchor_year", "dod"), "subject_id")
    if kind == "Gender":
        strat = F.col("gender")
    else:
        who = who.join(adm.select("hadm_id", "admittime", "dischtime"), "hadm_id")
        died = F.col("dod").cast("timestamp_ntz")
        if kind in ("Age", "HADM Length"):
            if op is None or value is None:
                raise ValueError(f"{kind} needs an operator and a value")
            number = age_by_year("admittime", "anchor_age", "anchor_year") if kind == "Age" else span_days("dischtime", "admittime")
            shown = str(int(value)) if float(value).is_integer() else str(value)
            strat = F.when(compare(number, "=" if op == "==" else op, value), f"{kind}{op}{shown}").otherwise("others")
        elif kind == "In hospital death":
            strat = F.when(shift("dischtime", 1, "day") >= died, kind).otherwise("Others")
        elif kind == "< 1 year after HADM death":
            strat = F.when(shift("dischtime", 1, "year") >= died, kind).otherwise("Others")
        else:
            raise ValueError(f"unknown stratification {kind}")
    return df.join(who.select("stay_id", strat.alias("strat")), "stay_id")


def assign_strata(cohort: DataFrame, strata: Sequence[tuple[str, DataFrame]], others: str = "Others") -> DataFrame:
    """Ordered strata of stays: the first that lists a stay wins, the rest are `others`.

    The lists are stacked with their position and reduced to the lowest one per stay.
    """
    if not strata:
        return cohort.withColumn("strat", F.lit("Whole Cohort"))
    tagged = reduce(DataFrame.unionByName, [df.select("stay_id").withColumn("__i", F.lit(i)) for i, (_, df) in enumerate(strata)])
    first = tagged.filter(F.col("stay_id").isNotNull()).groupBy("stay_id").agg(F.min("__i").alias("__i"))
    label = F.lit(others)
    for i, (name, _) in enumerate(strata):
        label = F.when(F.col("__i") == i, name or f"Stratification {i + 1}").otherwise(label)
    return cohort.join(first, "stay_id", "left").withColumn("strat", label).drop("__i")


def strata_comparison(df: DataFrame, stays: DataFrame, adm: DataFrame, patients: DataFrame) -> DataFrame:
    """Per stratum: stays, sexes, mean age and length of stay, deaths in hospital and within 30 days of the start."""
    d = df.select("stay_id", "strat").distinct().join(stays.select("subject_id", "hadm_id", "stay_id", "intime", "outtime"), "stay_id")
    d = d.join(patients.select("subject_id", "gender", "anchor_age", "anchor_year", "dod"), "subject_id").join(adm.select("hadm_id", "dischtime"), "hadm_id", "left")
    died = F.col("dod").cast("timestamp_ntz")
    sex = lambda g: F.count_distinct(F.when(F.col("gender") == g, F.col("subject_id")))
    share = lambda c: F.round(F.sum(F.when(c, 1).otherwise(0)) / F.count(F.lit(1)) * 100, 2)
    return d.groupBy("strat").agg(
        F.count_distinct("stay_id").alias("stay_count"), sex("M").alias("males"), sex("F").alias("females"),
        F.round(F.avg(age_by_year("intime", "anchor_age", "anchor_year")), 2).alias("mean_age"),
        F.round(F.avg(span_days("outtime", "intime")), 2).alias("mean_stay_days"),
        share(died <= shift("dischtime", 1, "day")).alias("hospital_death_pct"), share(died <= shift("intime", 30, "day")).alias("death_30d_pct"))


# --- categories and codes --------------------------------------------------------------------------------
def category_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def top_categories(df: DataFrame, by: Sequence[str], value: str, n: int = 10, others: str = "Others") -> DataFrame:
    """The n most frequent texts per group, the rest summed up. Equal counts rank by text."""
    counts = category_counts(df, by, value)
    kept = top_k(counts, by, n, [Order("n", desc=True), Order(value)], "__rank").select(*by, value, F.lit(True).alias("__keep"))
    a = counts.withColumnsRenamed({c: f"__{c}" for c in (*by, value)})
    cond = reduce(lambda x, y: x & y, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in (*by, value)])
    j = a.join(kept, cond, "left")
    name = F.when(F.col("__keep"), F.col(f"__{value}")).otherwise(others)
    return j.select(*[F.col(f"__{c}").alias(c) for c in by], name.alias(value), "n").groupBy(*by, value).agg(F.sum("n").alias("n"))


def top_codes(cohort: DataFrame, dx: DataFrame, d_dx: DataFrame, n: int = 5, max_seq: int | None = None) -> DataFrame:
    """Most frequent diagnoses per stratum; `max_seq` leaves out those further down an admission's list."""
    who = cohort.select("subject_id", "hadm_id", "strat").distinct()
    d = (dx if max_seq is None else dx.filter(F.col("seq_num") <= max_seq)).join(who, ["subject_id", "hadm_id"]).join(d_dx, ["icd_version", "icd_code"])
    counts = d.groupBy("icd_code", "icd_version", "long_title", "strat").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["strat"], n, [Order("n", desc=True), Order("icd_code"), Order("icd_version")])


# --- descriptive table -----------------------------------------------------------------------------------
def long_variables(demo: DataFrame, strata: DataFrame) -> DataFrame:
    """(stay, stratum, variable, number, text) from the pseudo-items."""
    return demo.join(strata.select("stay_id", "strat"), "stay_id").select(
        "stay_id", "strat", F.col("label").alias("variable"), F.col("valuenum").alias("number"), F.col("value").alias("text"))


def describe_numbers(long: DataFrame) -> DataFrame:
    """Median, quartiles and number of values per numeric variable and stratum; missing values are left out."""
    d = long.filter(F.col("number").isNotNull())
    q = exact_quantiles(d, ["variable", "strat"], "number", {"q1": 0.25, "median": 0.5, "q3": 0.75}, count="n")
    return q.select("variable", "strat", "n", "median", "q1", "q3")


def describe_levels(long: DataFrame) -> DataFrame:
    """Count and share of each level per categorical variable and stratum; missing values are left out."""
    d = long.filter(F.col("number").isNull() & F.col("text").isNotNull())
    counts = d.groupBy("variable", "strat", "text").agg(F.count(F.lit(1)).alias("n"))
    total = d.groupBy("variable", "strat").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(total, ["variable", "strat"]).select(
        "variable", "strat", F.col("text").alias("level"), "n", (F.col("n") / F.col("total") * 100).alias("pct"))


def table_one(long: DataFrame) -> DataFrame:
    """Numeric and categorical rows of the descriptive table in one layout."""
    none = F.lit(None).cast("double")
    a = describe_numbers(long).select("variable", "strat", F.lit(None).cast("string").alias("level"), "n", "median", "q1", "q3", none.alias("pct"))
    b = describe_levels(long).select("variable", "strat", "level", "n", none.alias("median"), none.alias("q1"), none.alias("q3"), "pct")
    return a.unionByName(b)


def variable_summary(long: DataFrame, by_stratum: bool = True) -> DataFrame:
    """Distribution of every numeric variable, by stratum on request: count, mean, spread, five numbers."""
    by = ["variable", "strat"] if by_stratum else ["variable"]
    d = long.filter(F.col("number").isNotNull())
    stats = {"n": "count", "mean": "mean", "sd": "sd", "min": "min", "max": "max"}
    return exact_quantiles(d, by, "number", {"q1": 0.25, "median": 0.5, "q3": 0.75}, stats=stats).select(*by, "n", "mean", "sd", "min", "q1", "median", "q3", "max")


# --- tests -------------------------------------------------------------------------------------------
def rank_sums(long: DataFrame) -> DataFrame:
    """Kruskal-Wallis statistic per numeric variable.

    Ranks are needed per distinct value only: the number of smaller values gives the average rank of a value, and rank
    sums are weighted by counts.
    """
    d = long.filter(F.col("number").isNotNull())
    cells = d.groupBy("variable", "number", "strat").agg(F.count(F.lit(1)).alias("n"))
    v = ranked_values(d, ["variable"], "number").select("variable", "number", F.col("n").alias("t"), (F.col("below") + (F.col("n") + 1) / 2.0).alias("rank"))
    groups = cells.join(v.select("variable", "number", "rank"), ["variable", "number"]).groupBy("variable", "strat").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    h = groups.groupBy("variable").agg(F.sum("n").alias("total"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.count(F.lit(1)).alias("groups"))
    ties = v.groupBy("variable").agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    total = F.col("total").cast("double")
    stat = (F.lit(12.0) / (total * (total + 1)) * F.col("q") - 3 * (total + 1)) / F.nullif(1 - F.col("ties") / (total * total * total - total), F.lit(0.0))
    return h.join(ties, "variable").select("variable", F.lit("rank").alias("test"), stat.alias("statistic"), (F.col("groups") - 1).cast("int").alias("df"))


def contingency(long: DataFrame) -> DataFrame:
    """Chi-square statistic per categorical variable from the counts of level and stratum."""
    d = long.filter(F.col("number").isNull() & F.col("text").isNotNull())
    cells = d.groupBy("variable", "text", "strat").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("variable", "text").agg(F.sum("n").alias("rn"))
    cols = cells.groupBy("variable", "strat").agg(F.sum("n").alias("cn"))
    whole = cells.groupBy("variable").agg(F.sum("n").alias("total"), F.count_distinct("text").alias("k"), F.count_distinct("strat").alias("m"))
    # sum (o-e)^2/e = N * sum o^2/(row*col) - N; empty cells add nothing to the sum
    part = cells.join(rows, ["variable", "text"]).join(cols, ["variable", "strat"]).groupBy("variable").agg(
        F.sum(F.col("n") * F.col("n") / (F.col("rn") * F.col("cn"))).alias("s"))
    return part.join(whole, "variable").select("variable", F.lit("chi-square").alias("test"), (F.col("total") * F.col("s") - F.col("total")).alias("statistic"),
                                               ((F.col("k") - 1) * (F.col("m") - 1)).cast("int").alias("df"))


TERMS = 400


def half_tail(x: Column) -> Column:
    """Regularised upper incomplete gamma function of 1/2: a series below 2, a continued fraction from there on."""
    root = F.sqrt(x)
    # P(1/2, x) = sqrt(x / pi) e^-x sum of x^n / (1/2 * 3/2 * ... * (n + 1/2))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(2.0).alias("sum"), F.lit(2.0).alias("term")),
                         lambda s, n: F.struct((s["sum"] + s["term"] * x / (n + 0.5)).alias("sum"), (s["term"] * x / (n + 0.5)).alias("term")), lambda s: s["sum"])
    low = 1 - series * root * F.exp(-x) / F.lit(math.sqrt(math.pi))
    # Q(1/2, x) = e^-x sqrt(x / pi) / (x + 1/2 - (1/2 * 1) / (x + 5/2 - (3/2 * 2) / (x + 9/2 - ...))), from the innermost fraction outwards
    fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), x + 2.0 * TERMS + 0.5, lambda f, n: x + 2.0 * (n - 1) + 0.5 - n * (n - 0.5) / f)
    high = F.exp(-x) * root / F.lit(math.sqrt(math.pi)) / fraction
    return F.when(x < 2, low).otherwise(high)


def chi_square_tail(statistic: float | None, df: int) -> float | None:
    """Upper tail of the chi-square distribution for plain numbers."""
    if statistic is None or df < 1:
        return None
    x, half = max(statistic, 0.0) / 2, df % 2 / 2
    if x == 0:
        return 1.0
    total = sum(math.exp((i + half) * math.log(x) - x - math.lgamma(i + half + 1)) for i in range(df // 2))
    return min(1.0, total + (math.erfc(math.sqrt(x)) if half else 0.0))


def chi_square_tails(statistic: Column, df: Column) -> Column:
    """The same for columns: a finite sum for whole and half arguments of the gamma function."""
    x, odd = statistic / 2, (df % 2) == 1
    half = F.when(odd, 0.5).otherwise(0.0)
    # terms x^(i - 1 + half) e^-x / gamma(i + half); logarithms keep the first ones when e^-x is too small for a double
    start = half * F.log(x) - x - F.when(odd, math.lgamma(1.5)).otherwise(0.0)
    steps = F.floor(df / 2).cast("int")
    terms = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, F.struct(F.lit(0.0).alias("sum"), start.alias("log")),
                        lambda s, i: F.struct((s["sum"] + F.exp(s["log"])).alias("sum"), (s["log"] + F.log(x) - F.log(i + half)).alias("log")), lambda s: s["sum"])
    tail = F.when(odd, half_tail(x) + total).otherwise(total)
    return F.when(statistic.isNull() | (df < 1), None).when(statistic <= 0, 1.0).otherwise(F.least(tail, F.lit(1.0)))


def group_tests(long: DataFrame) -> DataFrame:
    """p value per variable and its false-discovery-rate adjusted q value.

    q: p times tests over rank, made monotone from the largest rank down, by windows over one row per variable.
    """
    stats = rank_sums(long).unionByName(contingency(long))
    p = stats.withColumn("p_value", chi_square_tails(F.col("statistic"), F.col("df")))
    order = Window.orderBy(F.col("p_value").asc_nulls_last(), "variable")
    ranked = p.withColumns({"__rank": F.row_number().over(order), "__tests": F.count("p_value").over(Window.partitionBy())})
    raised = F.col("p_value") * F.col("__tests") / F.col("__rank")
    up = Window.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(F.col("p_value").isNotNull(), F.least(F.lit(1.0), F.min(raised).over(up)))
    return ranked.select("variable", "test", "statistic", "df", "p_value", q.alias("q_value"))
