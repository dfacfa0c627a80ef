"""Calendar helpers on integers, proleptic Gregorian and UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    return F.unix_date(F.make_date(y, m, d))


def civil_from_days(days: Column) -> Column:
    date = F.date_from_unix_date(days.cast("int"))
    return F.struct(F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day"))


def is_leap(y: Column) -> Column:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def last_day_of_month(y: Column, m: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))


def weekday_from_days(days: Column) -> Column:
    """0 is Sunday."""
    return F.pmod(days + 4, F.lit(7)).cast("int")


def weekday_difference(x: Column, y: Column) -> Column:
    """Days from weekday y to weekday x."""
    return F.pmod(x - y, F.lit(7))


def next_weekday(w: Column) -> Column:
    return F.pmod(w + 1, F.lit(7))


def prev_weekday(w: Column) -> Column:
    return F.pmod(w - 1, F.lit(7))


def epoch_seconds(y: Column, m: Column, d: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 1970 of a UTC time."""
    return F.unix_date(F.make_date(y, m, d)).cast("long") * 86400 + hour * 3600 + minute * 60 + second


def timestamp_seconds(time: Column) -> Column:
    return F.timestamp_seconds(time)
