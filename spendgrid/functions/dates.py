"""Calendar days in a zone, closed windows and gaps as Column expressions. Timestamps are instants under session zone UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Bucharest"


def local_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """The calendar day of an instant in a zone."""
    return F.from_utc_timestamp(ts, zone).cast("date")


def local_year(ts: Column, zone: str = "UTC") -> Column:
    return F.year(F.from_utc_timestamp(ts, zone))


def lenient_timestamp(c: Column) -> Column:
    """A timestamp from text; null if the text is none."""
    return F.try_to_timestamp(c)


def closed_window(today: Column, days: int) -> Column:
    """The last `days` closed days before today, as a struct of first and last day (both included)."""
    return F.struct(F.date_sub(today, days).alias("start"), F.date_sub(today, 1).alias("end"))


def days_of(start: Column, end: Column) -> Column:
    """Every day of a window, ends included; an empty array if it ends before it starts."""
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))


def in_window(day: Column, start: Column, end: Column) -> Column:
    return day.between(start, end)


def gap_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def gap_minutes(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, half up; null if either is null or end comes first."""
    return F.when(end >= start, F.round(gap_seconds(start, end) / 60).cast("long"))


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")
