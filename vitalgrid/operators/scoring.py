"""Rule tables compiled to one CASE chain per component, code flags and worst-value choice.

Predicates are SQL boolean texts over the input columns; the first rule that holds gives the points.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, float | int | None]


@dataclass(frozen=True)
class RuleScore:
    """Ordered (predicate, points) pairs; `otherwise` when none holds (None leaves NULL)."""

    name: str
    rules: tuple[Rule, ...]
    otherwise: float | int | None = None

    def column(self) -> Column:
        out: Column | None = None
        for test, points in self.rules:
            cond = F.expr(test)
            out = F.when(cond, F.lit(points)) if out is None else out.when(cond, F.lit(points))
        if out is None:
            raise ValueError("a score needs rules")
        return (out if self.otherwise is None else out.otherwise(F.lit(self.otherwise))).cast("int")

    def sql(self) -> str:
        """The same chain as SQL text."""
        def lit(p):
            return "NULL" if p is None else str(p)
        body = " ".join(f"WHEN {test} THEN {lit(points)}" for test, points in self.rules)
        tail = "" if self.otherwise is None else f" ELSE {self.otherwise}"
        return f"CAST(CASE {body}{tail} END AS INTEGER)"


def bands(col: str, steps: Sequence[tuple[float, int]], above: int | None = None, guard: str | None = None) -> tuple[Rule, ...]:
    """`col < limit` bands in rising order, NULL input first; `above` is for values past the last limit."""
    rules: list[Rule] = [(f"{guard or col} IS NULL", None)]
    rules += [(f"{col} < {limit}", points) for limit, points in steps]
    if above is not None:
        rules.append((f"{col} >= {steps[-1][0]}", above))
    return tuple(rules)


def add_scores(df: DataFrame, scores: Sequence[RuleScore]) -> DataFrame:
    return df.select("*", *[s.column().alias(s.name) for s in scores])


def total(names: Sequence[str]) -> Column:
    """Sum of components with missing ones as zero."""
    out = F.lit(0)
    for n in names:
        out = out + F.coalesce(F.col(n), F.lit(0))
    return out.cast("int")


def total_sql(names: Sequence[str]) -> str:
    return "CAST(" + " + ".join(f"COALESCE({n}, 0)" for n in names) + " AS INTEGER)"


def worst_of(low: str, high: str, normal: float, low_points: str, high_points: str) -> "WorstOf":
    """Points of whichever extreme is further from normal; equal distance takes the higher points."""
    return WorstOf(high, f"ABS({high} - {normal})", f"ABS({low} - {normal})", low_points, high_points)


@dataclass(frozen=True)
class WorstOf:
    high: str
    far_high: str
    far_low: str
    low_points: str
    high_points: str

    def column(self) -> Column:
        return F.expr(self.sql())

    def sql(self) -> str:
        best = f"GREATEST({self.high_points}, {self.low_points})"
        return (f"CASE WHEN {self.high} IS NULL THEN NULL WHEN {self.far_high} > {self.far_low} THEN {self.high_points} "
                f"WHEN {self.far_high} < {self.far_low} THEN {self.low_points} ELSE {best} END")


@dataclass(frozen=True)
class CodeRule:
    """Diagnosis codes by version: prefixes, and ranges on a prefix of given length (both ends included)."""

    prefixes9: tuple[str, ...] = ()
    prefixes10: tuple[str, ...] = ()
    ranges9: tuple[tuple[str, str], ...] = ()
    ranges10: tuple[tuple[str, str], ...] = ()

    def predicate(self, code: str = "icd_code", version: str = "icd_version") -> str:
        """SQL boolean text: equal version and (prefix of the code is listed or inside a range)."""
        sides = []
        for v, prefixes, ranges in ((9, self.prefixes9, self.ranges9), (10, self.prefixes10, self.ranges10)):
            tests = []
            for n in sorted({len(p) for p in prefixes}):
                listed = ", ".join(f"'{p}'" for p in prefixes if len(p) == n)
                tests.append(f"SUBSTR({code}, 1, {n}) IN ({listed})")
            tests += [f"SUBSTR({code}, 1, {len(a)}) BETWEEN '{a}' AND '{b}'" for a, b in ranges]
            if tests:
                sides.append(f"({version} = {v} AND ({' OR '.join(tests)}))")
        return " OR ".join(sides)


def code_flags(dx: DataFrame, key: Sequence[str], rules: Mapping[str, CodeRule]) -> DataFrame:
    """0/1 flag per rule and key; combined before the shuffle."""
    return dx.groupBy(*key).agg(*[
        F.max(F.when(F.expr(rule.predicate()), 1).otherwise(0)).alias(name) for name, rule in rules.items()])
