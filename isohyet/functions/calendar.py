"""Calendar and value-cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Missing-value sentinels and the range beyond which an observation is not one.
MISSING_GAUGE, MISSING_INDEX, MISSING_CLASS, RANGE_LIMIT, RADIATION_LIMIT = -99.0, -999.0, 127, 10_000.0, 1_000.0


def to_null(value: Column) -> Column:
    """NaN is missing: aggregates skip null, but not NaN."""
    return F.when(~F.isnan(value), value)


def clean(value: Column, *sentinels: float, limit: float | None = None) -> Column:
    """Null for NaN, each sentinel, and values of larger magnitude than limit."""
    ok = ~F.isnan(value) & value.isNotNull()
    for s in sentinels:
        ok &= value != F.lit(s)
    if limit is not None:
        ok &= F.abs(value) <= F.lit(limit)
    return F.when(ok, value)


def season(month: Column) -> Column:
    """Spring is March to May, and so on."""
    return F.when(month.between(3, 5), "Spring").when(month.between(6, 8), "Summer").when(month.between(9, 11), "Autumn").otherwise("Winter")


def season_order(month: Column) -> Column:
    return F.pmod(F.floor(month / 3) - 1, F.lit(4)).cast("int")


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def day_to_date(year: Column, day: Column) -> Column:
    """The date of day 1 .. 366 of a year."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def is_leap_day(date: Column) -> Column:
    return (F.month(date) == 2) & (F.dayofmonth(date) == 29)


def doy365(date: Column) -> Column:
    """Day of a year without its 29 February, which has none."""
    late = is_leap(F.year(date)) & (F.month(date) > 2)
    return F.when(~is_leap_day(date), F.dayofyear(date) - late.cast("int"))


def significance(z: Column) -> Column:
    """-2, -1, 0, 1, 2 at 1.96 and 2.58; both bounds +-2.58 are in class +-1. Null stays null."""
    size = F.when(F.abs(z) > 2.58, 2).when(F.abs(z) > 1.96, 1).when(z.isNotNull(), 0)
    return (size * F.signum(z)).cast("int")


def non_negative(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def elapsed(seconds: Column) -> Column:
    """Text of an elapsed time: 1h 02m 03s."""
    s = seconds.cast("long")
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def combinations(n: Column, m: Column) -> Column:
    """Binomial coefficient for small n (factorials up to 20)."""
    return (F.factorial(n) / (F.factorial(m) * F.factorial(n - m))).cast("long")
