"""Calendar arithmetic with Sunday-based weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(d: Column) -> Column:
    """The Sunday on or before the date."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_of_year(d: Column) -> Column:
    """0-53; days before the first Sunday of the year are week 0."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def months_between_dates(later: Column, earlier: Column) -> Column:
    """Calendar month boundaries between two dates."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def weeks_between_dates(later: Column, earlier: Column) -> Column:
    """Sunday boundaries between two dates."""
    return (F.datediff(week_start(later), week_start(earlier)) / 7).cast("int")


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "QUARTER"), 2))


def date_key(d: Column) -> Column:
    """YYYYMMDD as a number."""
    return F.date_format(d, "yyyyMMdd").cast("bigint")


def whole_units_between(unit: str, earlier: Column, later: Column) -> Column:
    """Completed units (HOUR, DAY, ...) between two timestamps."""
    return F.timestamp_diff(unit, earlier, later)


def is_weekend(d: Column) -> Column:
    return F.dayofweek(d).isin(1, 7)
