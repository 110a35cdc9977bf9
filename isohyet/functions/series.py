"""Statistics of a whole series held as an array of doubles in time order.

One shuffle gathers a series. What depends on all pairs of its values is counted by the kernels of
isohyet.operators.kernels.ranks, in O(n log^2 n) time and O(n log n) memory, a batch of series a call.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.kernels import ranks


def gather(df: DataFrame, keys: list[str], time: str, value: str, name: str = "series") -> DataFrame:
    """One row a key: its values in time order, nulls kept."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v"))))
    return df.groupBy(*keys).agg(pairs.alias(name)).withColumn(name, F.transform(name, lambda p: p["v"]))


def filled(x: Column) -> Column:
    """Nulls and NaN become the mean of the rest; null if there is none, or if all values are equal."""
    real = F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(real, F.lit(0.0), lambda a, v: a + v)
    mean = total / F.size(real)
    varied = (F.size(real) > 0) & (F.array_max(real) > F.array_min(real))
    return F.when(varied, F.transform(x, lambda v: F.when(v.isNotNull() & ~F.isnan(v), v).otherwise(mean)))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("s", "var_s", "sen")]))
def trend(x: pd.Series) -> pd.DataFrame:
    """Mann-Kendall S, its variance with the correction for ties, and Sen's slope; null for null series."""
    rows = [(None, None, None) if v is None else (float(ranks.trend_sum(v)), ranks.trend_variance(v), ranks.sen_slope(v)) for v in x]
    return pd.DataFrame(rows, columns=["s", "var_s", "sen"], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def prewhitened(x: pd.Series) -> pd.Series:
    """Without its lag-1 correlation, which is that of what Sen's slope leaves, the trend put back; one value shorter."""
    return x.map(ranks.prewhitened)


def _sequential(textbook: bool):
    @F.pandas_udf("uf array<double>, ub array<double>")
    def both(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ranks.sequential(v, textbook) for v in x], columns=["uf", "ub"])

    return both


def sequential_mk(x: Column, textbook: bool = False) -> Column:
    """struct(uf, ub) of the sequential Mann-Kendall test.

    The expectation is (i + 1)(i + 2) / 4 for place i from 0, or n(n - 1) / 4 with n = i + 1 if textbook.
    """
    return _sequential(textbook)(x)


def slowing(trigger: int):
    """f(x, ac): the least ac at the crossings after `trigger` whose Sen slope before exceeds the one after."""

    @F.pandas_udf("double")
    def least(x: pd.Series, ac: pd.Series) -> pd.Series:
        out = []
        for v, c in zip(x, ac, strict=True):
            at = ranks.crossings(*ranks.sequential(v))
            falls = [k for k in at[at > trigger] if ranks.sen_slope(v[:k]) > ranks.sen_slope(v[k + 1 :])]
            found = [c[k] for k in falls if c[k] is not None and c[k] == c[k]]
            out.append(min(found, default=None))
        return pd.Series(out, dtype="float64")

    return least


def mk_z(s: Column, variance: Column) -> Column:
    return F.when(s == 0, 0.0).otherwise(F.try_divide(s - F.signum(s), F.sqrt(variance)))


def mk_tau(s: Column, n: Column) -> Column:
    return F.try_divide(s, n * (n - 1) / 2)


def pettitt(best: Column, n: Column) -> Column:
    """struct(k, u, p, class) of the largest running sum, struct(size, back = -place, u): its place, itself, its probability, and 0, 1 (p < .05), 2 (p < .01)."""
    u = best["u"]
    p = 2 * F.exp(-6 * u * u / (n * n * n + n * n))
    return F.struct((-best["back"]).cast("int").alias("k"), u.alias("u"), p.alias("p"), F.when(p < 0.01, 2).when(p < 0.05, 1).otherwise(0).alias("class"))
