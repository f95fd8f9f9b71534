"""Instants as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_instant(text: Column) -> Column:
    """ISO text with or without seconds, offset or time of day; without an offset it is UTC (D01, T2). Null if it is none."""
    repaired = F.regexp_replace(F.trim(text), r"T(\d{2}:\d{2})(?=$|Z|[+-])", "T$1:00")
    return repaired.try_cast("timestamp")


def had_time(text: Column) -> Column:
    return text.rlike(r"\dT\d")


def is_iso(text: Column) -> Column:
    """D02."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")


def parse_day(text: Column) -> Column:
    """dd/mm/yyyy or dd/mm/yy (D07); two digits from 69 on are years of the last century."""
    day = lambda f: F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date")
    short = day("d/M/yy")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(F.when(F.trim(text).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), day("d/M/yyyy")), F.when(F.trim(text).rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), short))


def season_code(day: Column) -> Column:
    """Two years of a season from July to June, as 2627."""
    first = F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(first), two(first + 1))


def date_chunks(start: str, end: str, n: int) -> Column:
    """Ranges of n days that cover start to end, one after the other."""
    first = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"INTERVAL {n} DAYS"))
    return F.transform(first, lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, n - 1), F.lit(end).cast("date")).alias("last")))


def minute_bucket(at: Column) -> Column:
    """D09."""
    return F.date_trunc("minute", at)


def tolerant_seconds(text: Column) -> Column:
    """Seconds since 1970 of what a feed gives as an instant (Z20): its first 19 characters as UTC, with or without seconds; what follows them,
    an offset too, says nothing. Null if it is none."""
    cut = F.substring(F.regexp_replace(F.trim(text), "[Zz]+$", ""), 1, 19)
    whole = F.when(cut.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}$"), F.concat(cut, F.lit(":00"))).when(cut.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"), cut)
    return F.unix_seconds(F.try_to_timestamp(F.concat(whole, F.lit("Z")), F.lit("yyyy-M-d'T'H:m:sX")))
