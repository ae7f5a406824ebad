"""Clock ranges and durations in normalised text, as minutes of the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"(\d{1,2}(?::|\.)?\d{0,2})"


def range_pattern(compat: bool = False) -> str:
    """Two clock times joined by a dash or a word for "to". Normalised text spells the word الي, which the
    compatible pattern lacks."""
    to = "الى|إلى|حتي|حتى" + ("" if compat else "|الي|إلي")
    return rf"(?:من\s*)?{CLOCK}\s*(?:[-–—]|{to})\s*{CLOCK}"


DURATION = r"(?U)\b(\d{1,3})\s*(?:دقيقه|دقائق|ساعه|ساعات)\b"
DURATION_EVAL = r"(?U)\b(\d{1,3})\s*(?:دقيقة|دقائق|ساعة|ساعات)\b"
TIME_TOKEN = r"(?U)\b\d{1,2}[:.]\d{0,2}\b"


def _parts(token) -> tuple[Column, Column]:
    t = F.split(F.translate(token, ".", ":"), ":")
    return F.get(t, F.lit(0)).try_cast("int"), F.coalesce(F.get(t, F.lit(1)).try_cast("int"), F.lit(0))


def clock(token) -> Column:
    """H:MM of 8, 8:5, 8. and 8.05."""
    return F.format_string("%d:%02d", *_parts(token))


def minutes(token) -> Column:
    h, m = _parts(token)
    return h * 60 + m


def hhmm(m) -> Column:
    return F.format_string("%d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))


def raw_ranges(normed, compat: bool = False) -> Column:
    """array<struct<a: string, b: string>> of the token pairs, in order."""
    p = F.lit(range_pattern(compat))
    return F.zip_with(F.regexp_extract_all(normed, p, F.lit(1)), F.regexp_extract_all(normed, p, F.lit(2)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ranges(normed, hours, compat: bool = False) -> Column:
    """array<struct<a: int, b: int>>: an end that isn't later gets 12 hours, and is swapped if that doesn't help;
    where ``hours`` holds, only plausible work days stay. Unless compat, hours over 23 and minutes over 59 are no times."""
    pairs = F.transform(raw_ranges(normed, compat), lambda x: F.struct(minutes(x["a"]).alias("a"), minutes(x["b"]).alias("b"), x["a"].alias("ta"), x["b"].alias("tb")))
    if not compat:
        pairs = F.filter(pairs, lambda x: (x["a"] < 1440) & (x["b"] < 1440))
    fixed = F.transform(pairs, lambda x: F.when(x["b"] > x["a"], F.struct(x["a"].alias("a"), x["b"].alias("b"))).when(x["b"] + 720 > x["a"], F.struct(x["a"].alias("a"), (x["b"] + 720).alias("b"))).otherwise(F.struct(x["b"].alias("a"), x["a"].alias("b"))))
    return F.filter(fixed, lambda x: ~hours | ((x["b"] - x["a"]).between(360, 660) & x["a"].between(360, 1230) & x["b"].between(360, 1230) & (x["b"] > x["a"])))


def best_range(rs) -> Column:
    """The range nearest 7.5 hours, then the longest, then the earliest; null if there is none."""
    keyed = F.transform(rs, lambda x: F.struct(F.abs((x["b"] - x["a"]) * 2 - 900).alias("k"), (x["a"] - x["b"]).alias("d"), x["a"].alias("a"), x["b"].alias("b")))
    return F.array_min(keyed)
