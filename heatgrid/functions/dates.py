"""Date parts, day and night, and the two kinds of seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_of_year(when: Column) -> Column:
    """Weeks of seven days from 1 January (not ISO weeks)."""
    return (F.floor((F.dayofyear(when) - 1) / 7) + 1).cast("int")


def first_of_month(when: Column) -> Column:
    return F.make_date(F.year(when), F.month(when), F.lit(1))


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis).cast("date")


def day_or_night(when: Column) -> Column:
    return F.when((F.hour(when) >= 8) & (F.hour(when) < 20), "day").otherwise("night")


def quarter_season(when: Column) -> Column:
    """Seasons of weather tables: calendar quarters, from winter."""
    return F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "fall"))), F.quarter(when))


def meteorological_season(when: Column) -> Column:
    """Seasons of vegetation tables: three months each, winter from December."""
    month = F.month(when)
    return F.when(month.between(3, 5), "Spring").when(month.between(6, 8), "Summer").when(month.between(9, 11), "Fall").when(month.isNotNull(), "Winter")


def year_season(when: Column) -> Column:
    return F.when(when.isNotNull(), F.concat_ws("_", F.year(when), meteorological_season(when)))
