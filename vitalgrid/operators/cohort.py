"""Cohort algebra: AND/OR of conditions, diagnosis inclusion and exclusion, summaries.

An expression is evaluated in one pass: the keys of all leaves are stacked with the leaf's number and
reduced to one row of flags per key, on which the expression is a plain boolean column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_by_year, shift
from .joins import null_safe_join
from .predicates import KEYS, Condition
from .quantiles import exact_median
from .shared_scan import MOST_BROADCAST, SharedScan

TWO_KEYS = ("subject_id", "hadm_id")


def and_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both. A side without stay_id matches on patient and admission and takes the other's stay."""
    if "stay_id" in a.columns and "stay_id" in b.columns:
        return null_safe_join(a, b.select(*KEYS), KEYS)
    with_stay, without = (a, b) if "stay_id" in a.columns else (b, a)
    return null_safe_join(with_stay, without.select(*TWO_KEYS), TWO_KEYS)


def or_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in either. A side without stay_id adds its admissions with the other side's stays, if any."""
    if "stay_id" in a.columns and "stay_id" in b.columns:
        return a.select(*KEYS).union(b.select(*KEYS)).distinct()
    with_stay, without = (a, b) if "stay_id" in a.columns else (b, a)
    return with_stay.select(*KEYS).join(without.select(*TWO_KEYS), list(TWO_KEYS), "full").select(*KEYS).distinct()


class CohortExpr:
    """Base of the expression tree; `&` and `|` combine trees."""

    def __and__(self, other: "CohortExpr") -> "CohortExpr":
        return Both(self, other)

    def __or__(self, other: "CohortExpr") -> "CohortExpr":
        return Either(self, other)


@dataclass(frozen=True)
class Leaf(CohortExpr):
    cond: Condition


@dataclass(frozen=True)
class Both(CohortExpr):
    left: CohortExpr
    right: CohortExpr


@dataclass(frozen=True)
class Either(CohortExpr):
    left: CohortExpr
    right: CohortExpr


def fold_right(items: Sequence[CohortExpr | str]) -> CohortExpr:
    """`[a, "&", b, "|", c]` grouped from the right without precedence: a & (b | c).

    Neighbouring conditions without an operator are joined by OR.
    """
    if not items:
        raise ValueError("empty expression")
    head, rest = items[0], list(items[1:])
    if isinstance(head, str):
        raise ValueError(f"unexpected operator {head}")
    if not rest:
        return head
    op = rest.pop(0) if isinstance(rest[0], str) else "|"
    if op not in ("&", "|"):
        raise ValueError(f"unknown operator {op}")
    tail = fold_right(rest)
    return head & tail if op == "&" else head | tail


def leaves(expr: CohortExpr) -> list[Condition]:
    if isinstance(expr, Leaf):
        return [expr.cond]
    return leaves(expr.left) + leaves(expr.right)


def evaluate_expr(expr: CohortExpr, matcher: Callable[[Condition], DataFrame] | SharedScan) -> DataFrame:
    """Distinct keys for which the expression holds.

    `matcher` gives the keys of one condition; a `SharedScan` gives those of all leaves from one reading of each table.
    """
    conds = list(dict.fromkeys(leaves(expr)))
    tagged = matcher.many(conds) if isinstance(matcher, SharedScan) else reduce(DataFrame.unionByName, [matcher(c).select(*KEYS).withColumn("__leaf", F.lit(i)) for i, c in enumerate(conds)])
    flags = [F.max(F.when(F.col("__leaf") == i, True).otherwise(False)).alias(f"__f{i}") for i in range(len(conds))]

    def test(e: CohortExpr) -> Column:
        if isinstance(e, Leaf):
            return F.col(f"__f{conds.index(e.cond)}")
        return test(e.left) & test(e.right) if isinstance(e, Both) else test(e.left) | test(e.right)
    return tagged.groupBy(*KEYS).agg(*flags).filter(test(expr)).select(*KEYS)


# --- diagnoses ----------------------------------------------------------------------------------------
def code_hits(dx: DataFrame, codes: Sequence[tuple[str, int]]) -> DataFrame:
    """(subject_id, hadm_id, __i): one row per diagnosis and requested code (by its position) that it starts with, in the same version.

    A diagnosis is exploded to its prefixes of the requested lengths, and these meet the requested codes by equality: one
    reading of the diagnoses and no chain of tests, whatever the number of codes.
    """
    asked = dx.sparkSession.createDataFrame([(code, int(version), i) for i, (code, version) in enumerate(codes)], "__code string, __version long, __i int")
    code = F.col("icd_code")
    prefixes = F.array_compact(F.array(*[F.when(F.length(code) >= n, F.substring(code, 1, n)) for n in sorted({len(c) for c, _ in codes})]))
    d = dx.filter(F.col("icd_version").isin(sorted({v for _, v in codes})))
    d = d.select(*TWO_KEYS, F.col("icd_version").cast("long").alias("__version"), F.explode(prefixes).alias("__code"))
    return d.join(F.broadcast(asked) if len(codes) <= MOST_BROADCAST else asked, ["__code", "__version"]).select(*TWO_KEYS, "__i")


def code_matches(dx: DataFrame, codes: Sequence[tuple[str, int]], mode: str = "OR", strict: bool = False, distinct: bool = True) -> DataFrame:
    """Admissions whose codes start with the requested ones in the same version.

    OR: any (without `distinct` one row per matching diagnosis and code). AND: as many matching rows as
    requested codes; `strict` wants every requested code instead.
    """
    if mode not in ("OR", "AND"):
        raise ValueError("mode is OR or AND")
    hits = code_hits(dx, codes)
    if mode == "OR":
        return hits.select(*TWO_KEYS).distinct() if distinct else hits.select(*TWO_KEYS)
    if strict:
        hits = hits.distinct()
    return hits.groupBy(*TWO_KEYS).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(codes)).select(*TWO_KEYS)


def icd_filter(df: DataFrame, dx: DataFrame, allow: Sequence[tuple[str, int]] = (), deny: Sequence[tuple[str, int]] = (),
               allow_mode: str = "OR", deny_mode: str = "OR", strict: bool = False, duplicates: bool = False) -> DataFrame:
    """Keep admissions with the allowed codes, drop those with the denied ones.

    `duplicates` repeats a row for every diagnosis that matched an allowed code.
    """
    if allow:
        matched = code_matches(dx, allow, allow_mode, strict, distinct=not duplicates)
        df = df.join(matched, list(TWO_KEYS), "inner" if duplicates else "left_semi")
    if deny:
        df = df.join(code_matches(dx, deny, deny_mode, strict), list(TWO_KEYS), "left_anti")
    return df


def evaluate_cohort(expr: CohortExpr | None, matcher: Callable[[Condition], DataFrame] | SharedScan, universe: DataFrame, dx: DataFrame, patients: DataFrame,
                    adm: DataFrame, **icd) -> DataFrame:
    """Expression, then diagnosis filter, then only known patients and admissions.

    Without an expression the diagnosis filter applies to all stays.
    """
    d = universe.select(*KEYS) if expr is None else evaluate_expr(expr, matcher)
    d = icd_filter(d, dx, **icd)
    return d.join(patients.select("subject_id").distinct(), "subject_id", "left_semi").join(
        adm.select(*TWO_KEYS).distinct(), list(TWO_KEYS), "left_semi").select(*KEYS)


def with_ages(cohort: DataFrame, patients: DataFrame, adm: DataFrame) -> DataFrame:
    p = patients.select("subject_id", "gender", "anchor_age", "anchor_year")
    d = cohort.join(p, "subject_id").join(adm.select(*TWO_KEYS, "admittime"), list(TWO_KEYS))
    return d.withColumn("age", age_by_year("admittime", "anchor_age", "anchor_year"))


def cohort_summary(cohort: DataFrame, patients: DataFrame, adm: DataFrame) -> DataFrame:
    """One row: distinct patients, admissions and stays, share of patients with a stay row, sexes, ages."""
    d = with_ages(cohort, patients, adm).withColumn("__all", F.lit(1))
    who = lambda g: F.count_distinct(F.when(F.col("gender") == g, F.col("subject_id")))
    flat = d.groupBy("__all", *KEYS, "gender").agg(F.count(F.lit(1)).alias("n"), F.sum("age").alias("ages"))
    s = flat.groupBy("__all").agg(
        F.count_distinct("subject_id").alias("subjects"), F.count_distinct("hadm_id").alias("admissions"), F.count_distinct("stay_id").alias("stays"),
        F.count_distinct("subject_id").alias("with_row"), who("M").alias("males"), who("F").alias("females"),
        (F.sum("ages") / F.sum("n")).alias("mean_age"))
    names = [c for c in s.columns if c != "__all"]
    both = s.select(*names).unionByName(exact_median(d, ["__all"], "age", "median_age").select("median_age"), allowMissingColumns=True)
    s = both.agg(*[F.max(c).alias(c) for c in (*names, "median_age")])
    return s.select("subjects", "admissions", "stays", (F.col("with_row") / F.col("subjects") * 100).alias("subjects_with_stay_pct"),
                    "males", "females", F.round(F.col("males") / F.nullif(F.col("females"), F.lit(0)), 3).alias("sex_ratio"),
                    F.round("mean_age", 2).alias("mean_age"), "median_age")


# --- ready-made cohorts and catalogues ---------------------------------------------------------------------
PRE_ADMISSION_FLUID = "16-Pre Admission/Non-ICU"
SURGERY_WORDS = ("cardiac", "vascular", "trauma")


def literature_sepsis_cohort(sepsis: DataFrame, stays: DataFrame, adm: DataFrame, inputs: DataFrame) -> DataFrame:
    """Septic stays with documented fluid before the stay and an emergency registration, without heart, vessel or trauma surgery."""
    s = sepsis.filter(F.col("sepsis3")).select("subject_id", "stay_id").distinct().join(stays.select("stay_id", "hadm_id"), "stay_id")
    fluid = (inputs.filter((F.col("ordercategoryname") == PRE_ADMISSION_FLUID) & (F.col("amount") > 0)).groupBy("stay_id")
             .agg(F.sum("amount").alias("volume")).filter(F.col("volume") > 0))
    kind = F.lower("admission_type")
    excluded = reduce(lambda x, y: x | y, [kind.contains(w) for w in SURGERY_WORDS])
    ok = adm.filter(~excluded & F.col("edregtime").isNotNull()).select("hadm_id")
    return s.join(fluid, "stay_id", "left_semi").join(ok, "hadm_id", "left_semi").select(*KEYS)


def cohort_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct patients and stays before and after exclusions, one row per step."""
    tagged = before.select("subject_id", "stay_id").withColumn("step", F.lit("before")).unionByName(
        after.select("subject_id", "stay_id").withColumn("step", F.lit("after"))).distinct()
    return tagged.groupBy("step").agg(F.count_distinct("subject_id").alias("patients"), F.count_distinct("stay_id").alias("stays"))


def event_catalogue(events: DataFrame) -> DataFrame:
    """Rows, stays, admissions and patients per item and label.

    Rows are first counted per item and key, so the distinct counts see one row per key.
    """
    per_key = events.groupBy("itemid", "label", *KEYS).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("itemid", "label").agg(
        F.sum("n").alias("events"), F.count_distinct("stay_id").alias("stays"), F.count_distinct("hadm_id").alias("admissions"),
        F.count_distinct("subject_id").alias("patients"))


def mortality_flags(stays: DataFrame, adm: DataFrame, patients: DataFrame) -> DataFrame:
    """Death in unit, in hospital, within 30 days and a year of the stay's start, and lengths in started hours."""
    d = stays.select(*KEYS, "intime", "outtime").join(adm.select(*TWO_KEYS, "admittime", "dischtime"), list(TWO_KEYS)).join(
        patients.select("subject_id", "dod"), "subject_id")
    died = F.col("dod").cast("timestamp_ntz")

    def by(limit: Column) -> Column:
        return F.coalesce(died <= limit, F.lit(False))
    from ..functions.scalars import datetime_diff
    return d.select(
        *KEYS, by(shift("outtime", 24, "hour")).alias("icu_death"), by(shift("dischtime", 24, "hour")).alias("hospital_death"),
        by(shift("intime", 30, "day")).alias("death_30d"), by(shift("intime", 1, "year")).alias("death_1y"),
        F.ceil(datetime_diff("outtime", "intime", "hour")).alias("icu_hours"), F.ceil(datetime_diff("dischtime", "admittime", "hour")).alias("hospital_hours"))
