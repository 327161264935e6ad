"""Scalar helpers.

Times are TIMESTAMP_NTZ columns; arithmetic that needs a number goes through `micros`,
which reads the column as UTC. All helpers return Columns, none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Text that counts as a number in a condition: optional sign, digits, optional fraction.
NUMBER_PATTERN = r"^[+-]?([0-9]*[.])?[0-9]+$"

# Seconds in a year used for age (365.2425 days less rounding) and days used for date differences.
YEAR_SECONDS = 31556908.8
YEAR_DAYS = 365.242


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp (read as UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def shift(ts: Column | str, n: Column | int | float, unit: str) -> Column:
    """ts plus n units; month and year are calendar steps that clamp to the month's end."""
    n = n if isinstance(n, Column) else F.lit(n)
    unit = unit.lower().rstrip("s")
    if unit in ("month", "year"):
        months = (n * 12 if unit == "year" else n).cast("int")
        return col(ts) + F.make_ym_interval(F.lit(0), months)
    parts = {"day": F.lit(0), "hour": F.lit(0), "minute": F.lit(0), "second": F.lit(0)}
    if unit not in parts:
        raise ValueError(f"unknown unit {unit}")
    parts[unit] = n if unit == "second" else n.cast("int")
    return col(ts) + F.make_dt_interval(parts["day"], parts["hour"], parts["minute"], parts["second"])


_UNIT_MICROS = {"second": SECOND, "minute": MINUTE, "hour": HOUR, "day": DAY, "year": YEAR_DAYS * DAY}


def datetime_diff(end: Column | str, start: Column | str, part: str) -> Column:
    """Fractional difference in second, minute, hour, day or year."""
    return (micros(end) - micros(start)) / F.lit(float(_UNIT_MICROS[part.lower()]))


def span_days(end: Column | str, start: Column | str) -> Column:
    """Exact length in days."""
    return datetime_diff(end, start, "day")


def ceil_hour(ts: Column | str) -> Column:
    """The timestamp itself when it is on the hour, else the next full hour."""
    us = micros(ts)
    return from_micros((F.ceil(us / F.lit(float(HOUR))) * F.lit(HOUR)).cast("long"))


def trunc_to(ts: Column | str, unit: str) -> Column:
    return F.date_trunc(unit, col(ts)).cast("timestamp_ntz")


def year_start(year: Column | str) -> Column:
    """Midnight of January 1st of a year column."""
    y = col(year).cast("int")
    one, zero = F.lit(1), F.lit(0)
    return F.make_timestamp_ntz(y, one, one, zero, zero, F.lit(0.0))


def age_years(admit: Column | str, anchor_age: Column | str, anchor_year: Column | str) -> Column:
    """Anchor age plus the time since the start of the anchor year."""
    secs = (micros(admit) - micros(year_start(anchor_year))) / F.lit(float(SECOND))
    return col(anchor_age) + secs / F.lit(YEAR_SECONDS)


def age_by_year(admit: Column | str, anchor_age: Column | str, anchor_year: Column | str) -> Column:
    return col(anchor_age) + F.year(col(admit)) - col(anchor_year)


def round_dec(value: Column | str, digits: int) -> Column:
    """Half-up rounding on an exact decimal, returned as double."""
    return F.round(col(value).cast("decimal(38,10)"), digits).cast("double")


def guarded_number(text: Column | str) -> Column:
    """The text as double when it matches the plain number pattern, else NULL (1e5 and `5.` are no numbers)."""
    c = col(text)
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def upper_trim(c: Column | str) -> Column:
    return F.upper(F.trim(col(c)))


def like_contains(c: Column | str, needle: str) -> Column:
    """Case-sensitive substring test in which % and _ of the needle stay wildcards."""
    return col(c).like(f"%{needle}%")


def matches(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(pattern)


def any_keyword(c: Column | str, words: Sequence[str]) -> Column:
    """True when the upper-cased text contains any of the words (one regular expression, one pass)."""
    escaped = "|".join(_escape(w.upper()) for w in words)
    return F.upper(col(c)).rlike(escaped)


def _escape(word: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\-%" else ch for ch in word)


def fio2_percent(value: Column | str, low: float = 0.2, low_inclusive: bool = False, gap_from: float = 20.0,
                 gap_inclusive: bool = True) -> Column:
    """Inspired oxygen as percent: fractions are scaled, the unphysiological range up to 20 is dropped."""
    v = col(value)
    above = v >= low if low_inclusive else v > low
    percent = v >= gap_from if gap_inclusive else v > gap_from
    return F.when(above & (v <= 1), v * 100.0).when(percent & (v <= 100), v)


def canonical(c: Column | str, mapping: Mapping[str, Iterable[str]]) -> Column:
    """Replace each listed variant by its canonical label, other texts stay."""
    source = col(c)
    out: Column | None = None
    for label, variants in mapping.items():
        test = source.isin(list(variants))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return source if out is None else out.otherwise(source)


def cut(value: Column | str, breaks: Sequence[float]) -> Column:
    """Left-closed bins `[a,b)`; the last one also includes its upper break. Outside values give NULL."""
    v = col(value)
    out: Column | None = None
    last = len(breaks) - 2
    for i, (lo, hi) in enumerate(zip(breaks[:-1], breaks[1:])):
        inside = (v >= lo) & ((v <= hi) if i == last else (v < hi))
        label = F.lit(f"[{_num(lo)},{_num(hi)}" + ("]" if i == last else ")"))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    if out is None:
        raise ValueError("at least two breaks are needed")
    return out


def _num(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


# strftime-like tokens and the pattern letters Spark uses (fixed values)
TIME_TOKENS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def _pattern(fmt: str) -> str:
    for token, letters in TIME_TOKENS.items():
        fmt = fmt.replace(token, letters)
    return fmt


def format_ts(ts: Column | str, fmt: str) -> Column:
    return F.date_format(col(ts), _pattern(fmt))


def parse_ts(text: Column | str, fmt: str) -> Column:
    """Parse with strftime-like tokens; text that does not fit gives NULL."""
    return F.try_to_timestamp(col(text), F.lit(_pattern(fmt))).cast("timestamp_ntz")


def regexp_extract(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(col(text), pattern, group)


def hour_span(lo: int | Column, hi: int | Column) -> Column:
    """The integers lo..hi as an array, to be exploded."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.sequence(lo.cast("long"), hi.cast("long"))


def join_distinct(c: Column | str, sep: str = ", ") -> Column:
    """Aggregate: sorted distinct texts joined by a separator, NULL when there is none.

    Meant for label columns with a small vocabulary: the set holds distinct texts, not rows.
    """
    joined = F.array_join(F.array_sort(F.collect_set(col(c))), sep)
    return F.when(F.count(col(c)) > 0, joined)


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
