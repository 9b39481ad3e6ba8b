"""Time expressions. Update times are zone-less and to the second."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timestamp layouts found in update dumps, catalogues and results.
LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy:MM:dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
)


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less time."""
    return F.unix_timestamp(ts)


def from_seconds(secs: Column) -> Column:
    """Zone-less time at ``secs`` after 1970."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)")
    )


def bucket_seconds(ts: Column, width: int = 300) -> Column:
    s = seconds(ts)
    return s - F.pmod(s, F.lit(width))


def bucket_start(ts: Column, width: int = 300) -> Column:
    """Start of the bucket of ``width`` seconds (default five minutes)."""
    return from_seconds(bucket_seconds(ts, width))


def text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def parse_two_digit_year(raw: Column) -> Column:
    """``MM/DD/YY HH:MM[:SS]``; years under 50 are 20xx, others 19xx."""
    layout = r"^(\d{1,2})/(\d{1,2})/(\d{2}) (\d{1,2}):(\d{2})(?::(\d{2}))?"

    def part(i: int) -> Column:
        return F.regexp_extract(raw, layout, i).try_cast("int")

    year = part(3) + F.when(part(3) < 50, 2000).otherwise(1900)
    return F.when(
        raw.rlike(layout),
        F.try_make_timestamp_ntz(
            year, part(1), part(2), part(4), part(5), F.coalesce(part(6), F.lit(0)).cast("decimal(8,6)")
        ),
    )


def parse_time(raw: Column) -> Column:
    """First layout that fits; epoch seconds too; null when none does."""
    raw = F.trim(raw)
    tries = [F.try_to_timestamp(raw, F.lit(layout)).cast("timestamp_ntz") for layout in LAYOUTS]
    epoch = F.when(raw.rlike(r"^\d{9,11}(\.\d+)?$"), from_seconds(raw.try_cast("double").cast("bigint")))
    return F.coalesce(parse_two_digit_year(raw), epoch, *tries)


def extended_window(start: Column, end: Column) -> tuple[Column, Column]:
    """One day before, six hours after."""
    return start - F.expr("INTERVAL 1 DAY"), end + F.expr("INTERVAL 6 HOURS")


def earlier(a: Column, b: Column) -> Column:
    return F.least(a, b)


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)
