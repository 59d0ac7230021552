"""Dates and times: a fixed offset of eight hours, never a named zone for stored data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
YEAR_DAYS = 365.2425


def epoch_day(ts: Column) -> Column:
    """Days since 1970 as a double, of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) / F.lit(8.64e10)


def fixed_offset_local(year, month, day, hour, minute, second) -> Column:
    """Local time from its parts; second 60 carries into the next minute."""
    return F.make_timestamp_ntz(year, month, day, hour, minute, F.lit(0)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)


def local_to_utc(local: Column, hours: int = 8) -> Column:
    return local - F.make_dt_interval(F.lit(0), F.lit(hours))


def fixed_local_midnight(date: Column) -> Column:
    """UTC time of the date's midnight at +08:00."""
    return local_to_utc(date.cast("timestamp_ntz"))


def conservative_available_at(*dates: Column) -> Column:
    """UTC time of the midnight at +08:00 after the latest date."""
    latest = F.greatest(*dates) if len(dates) > 1 else dates[0]
    return fixed_local_midnight(F.date_add(latest, 1))


def strict_date(text: Column) -> Column:
    """A canonical ISO date, else null."""
    parsed = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(parsed, "yyyy-MM-dd") == text, parsed)


def add_years(date: Column, years: int) -> Column:
    return F.add_months(date, 12 * years)


def duration_years(start_day: Column, end_day: Column) -> Column:
    return (end_day - start_day) / F.lit(YEAR_DAYS)


def elapsed_ratio(snapshot_year: Column, last_year: Column, recurrence_years: Column) -> Column:
    return F.try_divide(snapshot_year - last_year, recurrence_years)
