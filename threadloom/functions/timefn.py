"""Calendar functions: symbolic age, day ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that a symbolic year, month and day count for.
YEAR_S, MONTH_S, DAY_S = 31_557_600, 2_592_000, 86_400


def age_epoch(hi: Column, lo: Column) -> Column:
    """Seconds of the symbolic interval hi - lo (years, months, days, time), negative where lo is later.

    Fields are subtracted one by one; a day is borrowed from the month of the earlier time.
    """
    sign = F.when(hi < lo, F.lit(-1)).otherwise(F.lit(1))
    a, b = F.greatest(hi, lo), F.least(hi, lo)
    midnight = lambda t: F.date_trunc("day", t)
    us = lambda t: F.unix_micros(t.cast("timestamp")) - F.unix_micros(midnight(t).cast("timestamp"))
    du = us(a) - us(b)
    days = F.dayofmonth(a) - F.dayofmonth(b) - F.when(du < 0, 1).otherwise(0)
    du = F.when(du < 0, du + DAY_S * 1_000_000).otherwise(du)
    months = F.month(a) - F.month(b) - F.when(days < 0, 1).otherwise(0)
    days = F.when(days < 0, days + F.dayofmonth(F.last_day(b))).otherwise(days)
    years = F.year(a) - F.year(b) - F.when(months < 0, 1).otherwise(0)
    months = F.when(months < 0, months + 12).otherwise(months)
    return sign * (years * F.lit(YEAR_S).cast("double") + months * MONTH_S + days * DAY_S + du / 1e6)


def age_since(as_of: Column, time: Column) -> Column:
    """Age of a time as of the midnight that begins the day of as_of, in seconds; negative for that same day."""
    return age_epoch(F.date_trunc("day", as_of), time)


def on_day(time: Column, day: str) -> Column:
    """Is the time within the UTC day?"""
    d = F.lit(day).cast("date").cast("timestamp_ntz")
    return (time >= d) & (time < d + F.expr("INTERVAL 1 DAY"))
