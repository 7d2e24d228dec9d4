"""Dates of mixed precision as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def start_text(c: Column) -> Column:
    """The text without an interval's end and without a time of day; blank is null."""
    t = F.split_part(F.split_part(F.trim(c.cast("string")), F.lit("/"), F.lit(1)), F.lit("T"), F.lit(1))
    t = F.trim(t)
    return F.when(t != "", t)


def parse(c: Column) -> Column:
    """The day: year, year-month or full date, with / without time or interval; null where it can't be read.

    A year or month stands for its first day.
    """
    t = start_text(c)
    spelt = [F.to_date(F.try_to_timestamp(t, F.lit(p))) for p in ("MMMM yyyy", "MMM yyyy", "d MMM yyyy", "d MMMM yyyy")]
    compact = F.when(t.rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyyMMdd"))))
    return F.coalesce(compact, F.when(~t.rlike("^[0-9]{5,}$"), t.try_cast("date")), *spelt)


def is_interval(c: Column) -> Column:
    return F.coalesce(c.cast("string").contains("/"), F.lit(False))


def has_time(c: Column) -> Column:
    return F.coalesce(F.split_part(c.cast("string"), F.lit("/"), F.lit(1)).contains("T"), F.lit(False))


def incomplete(c: Column) -> Column:
    """Whether the start has no day (fewer than three parts)."""
    return F.coalesce(start_text(c).rlike("^[0-9-]+$") & ~start_text(c).rlike("^[0-9]{8}$") & (F.size(F.split(start_text(c), "-")) < 3), F.lit(False))


def day_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


#: Microseconds of a day.
DAY = 86_400_000_000


def micros(c: Column, kind: str) -> Column:
    """Microseconds since 1970 (UTC) of a column of a type: a date's midnight, a timestamp, or epoch milliseconds of an integer."""
    if kind == "date":
        return F.unix_date(c).cast("bigint") * DAY
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if kind in ("int", "bigint"):
        return c.cast("bigint") * 1000
    if kind in ("void", "string"):
        return micros(c.cast("timestamp"), "timestamp")
    raise ValueError(f"no time in a column of type {kind}")


def of_micros(c: Column, kind: str) -> Column:
    """Microseconds since 1970 as a value of a type; a timestamp where the type has none of its own."""
    if kind == "date":
        return F.date_from_unix_date(F.floor(c / F.lit(DAY)).cast("int"))
    if kind == "timestamp_ntz":
        return F.timestamp_micros(c).cast("timestamp_ntz")
    return F.timestamp_micros(c)
