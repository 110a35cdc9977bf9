"""Skill metrics as aggregate expressions over observed and simulated columns. Population moments; pairs with a null are out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _paired(o: Column, s: Column) -> tuple[Column, Column]:
    both = o.isNotNull() & s.isNotNull()
    return F.when(both, o), F.when(both, s)


def mean(x: Column) -> Column:
    return F.avg(x)


def variance(x: Column) -> Column:
    return F.var_pop(x)


def std(x: Column) -> Column:
    return F.stddev_pop(x)


def cov(x: Column) -> Column:
    """Coefficient of variation; 0 for a mean of 0."""
    return F.when(F.avg(x) == 0, 0.0).otherwise(F.try_divide(F.stddev_pop(x), F.avg(x)))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def mse(o: Column, s: Column) -> Column:
    return F.avg((o - s) * (o - s))


def rmse(o: Column, s: Column) -> Column:
    """0 when exact."""
    return F.sqrt(mse(o, s))


def mae(o: Column, s: Column) -> Column:
    return F.avg(F.abs(o - s))


def nse(o: Column, s: Column) -> Column:
    o, s = _paired(o, s)
    return 1 - F.try_divide(F.sum((o - s) * (o - s)), F.var_pop(o) * F.count(o))


def pbias(o: Column, s: Column) -> Column:
    o, s = _paired(o, s)
    return 100 * F.try_divide(F.sum(s - o), F.sum(o))


def rsr(o: Column, s: Column) -> Column:
    return F.try_divide(rmse(o, s), F.stddev_pop(_paired(o, s)[0]))


def std_ratio(o: Column, s: Column) -> Column:
    return F.try_divide(F.stddev_pop(s), F.stddev_pop(o))


def correlation(o: Column, s: Column) -> Column:
    return F.corr(o, s)


def partial_correlation(x: Column, y: Column, control: Column) -> Column:
    """First-order partial correlation."""
    xy, xc, yc = F.corr(x, y), F.corr(x, control), F.corr(y, control)
    return F.try_divide(xy - xc * yc, F.sqrt((1 - xc * xc) * (1 - yc * yc)))


def detection(o: Column, s: Column, low: float = -2.0, high: float = 2.0) -> dict[str, Column]:
    """Probability of detection and false alarm rate of dry (<= low) and wet (>= high) states."""
    out = {}
    for name, a, b in (("dry", o <= low, s <= low), ("wet", o >= high, s >= high)):
        hit, miss, false = F.count_if(a & b), F.count_if(a & ~b), F.count_if(~a & b)
        out[f"pod_{name}"] = F.try_divide(hit, hit + miss)
        out[f"far_{name}"] = F.try_divide(false, hit + false)
    return out
