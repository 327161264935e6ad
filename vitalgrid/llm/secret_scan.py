"""Secrets in whole texts: fixed patterns, and strings that pass a battery of randomness tests.

Only built-in column functions are used. Positions count code points; the pieces between matches (split) and the
matches themselves (regexp_extract_all) give them, as both run the same leftmost, non-overlapping matching.

Fixed patterns: `assign`, `access`, `hex`. Further spans (`random`) come from runs of 20 or more signs of
[A-Za-z0-9+/_-]:

* the encoding is the first of hex, upper-case hex, base32, upper or lower alphanumeric, base62, base64, base64url
  that has all signs of the string;
* three tests of "uniform over this alphabet": chi-squared of the sign counts (Wilson-Hilferty), runs above and
  below the middle of the alphabet, lag-1 serial correlation of the positions in it; the string passes when
  the smallest p value, times three, is at least ALPHA;
* false discoveries are bounded by encoding and length: an ordinary string of length n reaches the p value c in the
  chi-squared test with a chance b(n, c) that follows from the letter statistics of prose (decimal digits for hex). The
  share of strings failing that test that still reach c in the two others, r(c), completes the chance of the whole
  battery, b * r. Strings that failed are ordinary, which gives the number of ordinary strings, failed / (1 - b * r) at
  ALPHA, and so the expected false ones at each c of CUTS. In every encoding and length band the strings of
  the best p values are reported, down to the least c at which the false ones are at most FALSE_SHARE of those that
  reach it, over all texts. A band without such a c reports nothing.

A reported string that overlaps a fixed-pattern span is left out. Null and empty texts have no spans. Repeated
rows count as often as they occur. Equal starts are ordered by kind, in the order above.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import ROW, flat, rows_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}+", "[0-9a-f]{24,}+"
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name, alphabet, sum of squared shares of signs in an ordinary string
ENCODINGS = (("hex", DIGITS + "abcdef", 0.1), ("upper hex", DIGITS + "ABCDEF", 0.1), ("base32", UPPER + "234567", 0.065), ("upper", DIGITS + UPPER, 0.065),
             ("lower", DIGITS + LOWER, 0.065), ("base62", DIGITS + UPPER + LOWER, 0.065), ("base64", UPPER + LOWER + DIGITS + "+/", 0.065),
             ("base64url", UPPER + LOWER + DIGITS + "-_", 0.065))
BANDS = (20, 24, 28, 32, 40, 48, 64, 96, 128)
ALPHA, FALSE_SHARE = 0.01, 0.05
#: P values down to which a band may be reported.
CUTS = (ALPHA, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0)
MARK = "[SECRET]"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, found: Column, least: Column | None = None) -> Column:
    """Spans of all matches; `found` says cheaply that there may be any."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("match"))
    start = lambda acc, x: acc["at"] + F.length(x["piece"])
    walked = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)").alias("out")),
                         lambda acc, x: F.struct((start(acc, x) + F.length(x["match"])).alias("at"), F.concat(acc["out"], F.array(F.struct(
                             start(acc, x).alias("start"), F.lit(kind).alias("kind"), (start(acc, x) + F.length(x["match"])).alias("end"), x["match"].alias("value")))).alias("out")))["out"]
    return F.when(found, walked).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"))


def _tail(z: Column) -> Column:
    """P(N > z) for z >= 0, to about 1e-7 (a rational approximation of the error function)."""
    x = z / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = reduce(lambda acc, c: (acc + c) * t, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(0.0))
    return 0.5 * poly * F.exp(-x * x)


def _upper(z: Column) -> Column:
    return F.when(z >= 0, _tail(F.abs(z))).otherwise(1.0 - _tail(F.abs(z)))


def tested(value: Column) -> Column:
    """encoding (index or null), n, chi (the chi-squared test), rest (the two others) and p (all) of a string."""
    encoding = F.coalesce(*[F.when(value.rlike(f"^[{a.replace('-', '')}{'-' * ('-' in a)}]+$"), F.lit(i)) for i, (_, a, _) in enumerate(ENCODINGS)])
    alphabet = F.element_at(F.array(*[F.lit(a) for _, a, _ in ENCODINGS]), encoding + 1)
    one = F.struct(encoding.alias("encoding"), F.length(value).alias("n"), alphabet.alias("alphabet"), F.split(value, "(?!^)(?!$)").alias("signs"))

    # each step binds its results, so that a lambda over the signs only reads them
    def placed(s: Column) -> Column:
        return F.struct(s["encoding"].alias("encoding"), s["n"].alias("n"), F.length(s["alphabet"]).cast("double").alias("a"), s["signs"].alias("signs"),
                        F.transform(s["signs"], lambda c: F.instr(s["alphabet"], c) - 1).alias("places"))

    def centred(s: Column) -> Column:
        """With the mean place, which would otherwise be worked out anew for every sign."""
        mean = F.aggregate(s["places"], F.lit(0.0), lambda acc, x: acc + x) / s["n"]
        return F.struct(s["encoding"].alias("encoding"), s["n"].alias("n"), s["a"].alias("a"), s["signs"].alias("signs"), s["places"].alias("places"), mean.alias("mean"))

    def battery(s: Column) -> Column:
        n, a, df = s["n"].cast("double"), s["a"], s["a"] - 1.0
        squares = F.aggregate(F.array_distinct(s["signs"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(s["signs"], lambda x: x == c)).cast("double"), F.lit(2.0)))
        chi = a / n * squares - n
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        nexts = F.slice(s["places"], 2, s["n"])
        pairs = F.arrays_zip(F.slice(s["places"], 1, s["n"] - 1).alias("x"), nexts.alias("y"))
        high = F.size(F.filter(s["places"], lambda p: p * 2 >= a)).cast("double")
        low = n - high
        runs = 1.0 + F.size(F.filter(pairs, lambda p: (p["x"] * 2 >= a) != (p["y"] * 2 >= a))).cast("double")
        expected, spread = 1.0 + 2.0 * high * low / n, 2.0 * high * low * (2.0 * high * low - n) / (n * n * (n - 1.0))
        p_runs = F.when(spread > 0, 2.0 * _tail(F.abs(runs - expected) / F.sqrt(spread))).otherwise(0.0)
        mean = s["mean"]
        total = F.aggregate(s["places"], F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["x"] - mean) * (p["y"] - mean))
        p_serial = F.when(total > 0, 2.0 * _tail(F.abs(serial / total + 1.0 / n) * F.sqrt(n))).otherwise(0.0)
        return F.struct(s["encoding"].alias("encoding"), s["n"].alias("n"), F.least(F.lit(1.0), 3.0 * _upper(z_chi)).alias("chi"), F.least(F.lit(1.0), 3.0 * F.least(p_runs, p_serial)).alias("rest"))

    def joined(s: Column) -> Column:
        return F.struct(*[s[c].alias(c) for c in ("encoding", "n", "chi", "rest")], F.least(s["chi"], s["rest"]).alias("p"))
    return F.transform(F.transform(F.transform(F.transform(F.array(one), placed), centred), battery), joined)[0]


def passing_chance(encoding: int, n: int, cut: float = ALPHA) -> float:
    """Chance that an ordinary string of length n reaches the p value `cut` in the chi-squared test."""
    _, alphabet, squares = ENCODINGS[encoding]
    df, away = len(alphabet) - 1, n * (len(alphabet) * squares - 1)
    z = NormalDist().inv_cdf(1 - cut / 3)
    limit = df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3
    return 0.5 * math.erfc((df + away - limit) / math.sqrt(2 * (df + 2 * away)) / math.sqrt(2))


def _band(n: Column) -> Column:
    return F.coalesce(*[F.when(n >= b, F.lit(b)) for b in reversed(BANDS)])


def reported_cuts(candidates: DataFrame) -> list[tuple[int, int, float]]:
    """(encoding, band, least p value reported) where the expected false share is small enough; candidates: encoding, n, chi, rest, p."""
    clear = F.col("chi") < ALPHA
    counts = candidates.groupBy("encoding", _band(F.col("n")).alias("band")).agg(
        F.count_if(F.col("p") < ALPHA).alias("failed"), F.count_if(clear).alias("clear"),
        F.array(*[F.count_if(F.col("p") >= c) for c in CUTS]).alias("reached"), F.array(*[F.count_if(clear & (F.col("rest") >= c)) for c in CUTS]).alias("others")).collect()  # encodings times bands
    out = []
    for r in counts:
        # one more of each, so that few strings promise little
        chance = [passing_chance(r["encoding"], r["band"], c) * (k + 1) / (r["clear"] + 1) for c, k in zip(CUTS, r["others"], strict=True)]
        ordinary = r["failed"] / (1 - chance[0])
        cut = next((c for c, b, n in zip(CUTS, chance, r["reached"], strict=True) if n and ordinary * b <= FALSE_SHARE * n), None)
        if cut is not None:
            out.append((r["encoding"], r["band"], cut))
    return sorted(out)


def secret_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents as `row`; base (fixed spans), spans (all), both sorted arrays of (start, kind, end)."""
    rows = rows_of(docs).withColumn("body", F.coalesce(F.col(f"{ROW}.`{text_col}`"), F.lit("")))
    body = F.col("body")
    assign = F.filter(_spans(body, ASSIGN, 0, body.rlike(ASSIGN)), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    access = _spans(body, ACCESS, 1, body.contains("AKIA"))
    hexes = _spans(body, HEX, 2, body.rlike(HEX))
    strings = _spans(body, CANDIDATE, 3, body.rlike(CANDIDATE))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    rows = rows.withColumn("base", F.array_sort(F.transform(F.concat(assign, access, hexes), plain)))
    rows = rows.withColumn("strings", F.transform(strings, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), tested(s["value"]).alias("test"))))
    seen = rows.select(F.explode("strings.test").alias("test")).where("test.encoding IS NOT NULL").select("test.encoding", "test.n", "test.chi", "test.rest", "test.p")
    cuts = reported_cuts(seen)
    is_reported = lambda t: reduce(lambda acc, b: acc | ((t["encoding"] == b[0]) & (_band(t["n"]) == b[1]) & (t["p"] >= b[2])), cuts, F.lit(False))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.transform(F.filter("strings", lambda s: F.coalesce(is_reported(s["test"]), F.lit(False)) & free(s)), plain)
    return rows.select(ROW, "body", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _written(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents' columns, n_assign, n_access, n_hex, n_random, base_sha256 and spans."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return flat(secret_rows(docs, text_col).select(ROW, *[n(k) for k in range(4)], F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans")))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by MARK; rows without spans stay as they are.

    A column `length_col` follows the new text.
    """
    rows = secret_rows(docs, text_col)
    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("body"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(MARK)).alias("out"))).otherwise(
        F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))))
    rows = rows.withColumn("done", F.when(F.size("spans") > 0, done)).withColumn(
        "clean", F.when(F.col("done").isNull(), F.col(f"{ROW}.`{text_col}`")).otherwise(F.concat("done.out", F.substring(F.col("body"), F.col("done.at") + 1, F.length("body")))))
    new = {text_col: F.col("clean")}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("done").isNull(), F.col(f"{ROW}.`{length_col}`")).otherwise(F.length("clean").cast(docs.schema[length_col].dataType))
    return rows.select(*[new.get(c, F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns])
