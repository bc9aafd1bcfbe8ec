"""A calendar of 365-day years without leap days and without a year 0, as column expressions.

A date is one integer: days since 1 January AD 1, negative before. BC years are negative.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MONTH_LENGTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_STARTS = tuple(sum(MONTH_LENGTHS[:m]) for m in range(12))
#: First year of the map's dated layers.
FIRST_MAP_YEAR = 1219


def year_index(year: Column) -> Column:
    """Continuous index of a year: AD 1 is 0, 1 BC (-1) is -1."""
    return F.when(year > 0, year - 1).otherwise(year)


def index_year(index: Column) -> Column:
    return F.when(index >= 0, index + 1).otherwise(index)


def valid_date(year: Column, month: Column, day: Column) -> Column:
    length = F.get(F.array(*map(F.lit, MONTH_LENGTHS)), (month - 1).cast("int"))
    return F.coalesce((year != 0) & month.between(1, 12) & (day >= 1) & (day <= length), F.lit(False))


def day_of_date(year: Column, month: Column, day: Column, strict: bool = True) -> Column:
    """Day count of a date; an invalid date raises, or gives null if not strict."""
    start = F.get(F.array(*map(F.lit, MONTH_STARTS)), (month - 1).cast("int"))
    value = (year_index(year) * 365 + start + day - 1).cast("long")
    bad = F.raise_error(F.format_string("bad date: %s-%s-%s", year, month, day)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(valid_date(year, month, day), value).otherwise(bad)


def year_of_day(day: Column) -> Column:
    """Year of a day count, by floor division, so that days before AD 1 fall in BC years."""
    return index_year(F.floor(day / 365))


def day_of_year(day: Column) -> Column:
    return F.pmod(day, F.lit(365))


def month_of_day(day: Column) -> Column:
    at = day_of_year(day)
    month = F.lit(1)
    for start in MONTH_STARTS[1:]:
        month = month + F.when(at >= start, 1).otherwise(0)
    return month


def day_in_month(day: Column) -> Column:
    return (day_of_year(day) - F.get(F.array(*map(F.lit, MONTH_STARTS)), (month_of_day(day) - 1).cast("int")) + 1).cast("int")


def format_day(day: Column) -> Column:
    """`1 January 1219`, or `5 March 120 BC`."""
    year = year_of_day(day)
    name = F.get(F.array(*map(F.lit, MONTH_NAMES)), (month_of_day(day) - 1).cast("int"))
    return F.concat_ws(" ", day_in_month(day).cast("string"), name, F.when(year > 0, year.cast("string")).otherwise(F.concat((-year).cast("string"), F.lit(" BC"))))


def is_first_of_month(day: Column) -> Column:
    return day_in_month(day) == 1


def month_started_since(day: Column, last: Column) -> Column:
    """Whether a month began after `last` and by `day`."""
    months = lambda d: F.floor(d / 365) * 12 + month_of_day(d)
    return months(day) > months(last)


def map_year(day: Column, first: int = FIRST_MAP_YEAR) -> Column:
    """Year that a map shows on a day: never before its first."""
    return F.greatest(year_of_day(day), F.lit(first))


def era_of(year: Column, first: int = FIRST_MAP_YEAR) -> Column:
    """Struct (year shown, no_data): years before the first are shown as it and marked."""
    return F.struct(F.greatest(year, F.lit(first)).alias("shown"), (year < first).alias("no_data"))
