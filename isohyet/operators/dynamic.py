"""The dynamic linear model of keyed series, and what is read off it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .kernels import filters as L
from .kernels.bayes import binary_acf, exponential_time, integrated_time


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns)


def forward_filter(df: DataFrame, keys: list[str], regressors: list[str], time: str = "date", value: str = "value", discount: float = 0.98, harmonics: tuple[int, ...] = (1, 2), period: float = 365.25 / 16) -> DataFrame:
    """State mean m, scale matrix C (row by row), degrees of freedom and likelihood after each step. The first regressor is the lagged series."""
    schema = f"{_kinds(df, [*keys, time])}, m array<double>, c array<double>, nu double, likelihood double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        x = pdf[regressors].to_numpy(float)
        o = L.forward_filter(pdf[value].to_numpy(float), np.where(np.isfinite(x), x, 0.0), harmonics, discount, period)
        return pdf[[*keys, time]].assign(m=list(o["m"][1:]), c=[c.ravel() for c in o["C"][1:]], nu=o["nu"][1:], likelihood=o["likelihood"][1:])

    return df.select(*keys, time, value, *[r for r in regressors if r != value]).groupBy(*keys).applyInPandas(run, schema)


def lag_coefficient(df: DataFrame, keys: list[str], time: str = "date", value: str = "value") -> DataFrame:
    """Mean and variance of the lag-1 coefficient after each step, gaps filled by the mean first; series without values give none."""
    schema = f"{_kinds(df, [*keys, time])}, ac double, variance double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        y = pdf[value].to_numpy(float)
        ok = np.isfinite(y)
        if not ok.any() or not y[ok].any():
            return pdf[[*keys, time]].iloc[:0].assign(ac=[], variance=[])
        y = np.where(ok, y, y[ok].mean())
        lag = np.r_[y[0], y[:-1]][:, None]
        o = L.forward_filter(y, lag)
        return pdf[[*keys, time]].assign(ac=o["m"][1:, 2], variance=o["C"][1:, 2, 2])

    return df.select(*keys, time, value).groupBy(*keys).applyInPandas(run, schema)


def quantile_bounds(states: DataFrame, keys: list[str], time: str = "date", index: int = 2, probability: float = 0.95) -> DataFrame:
    """Mean of one coefficient with its Student quantile bound, m + C t(probability; nu), at each step."""

    def run(batches):
        for pdf in batches:
            k = [int(np.sqrt(len(c))) for c in pdf["c"]]
            m = [v[index] for v in pdf["m"]]
            bound = [a + c[index * n + index] * L.student_ppf(probability, nu) for a, c, n, nu in zip(m, pdf["c"], k, pdf["nu"], strict=True)]
            yield pdf[[*keys, time]].assign(mean=m, upper=bound)

    return states.mapInPandas(run, f"{_kinds(states, [*keys, time])}, mean double, upper double")


def drift(df: DataFrame, keys: list[str], window: int, time: str = "date", value: str = "value") -> DataFrame:
    """Conditional drift of each window (place from 0)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = L.drift(pdf.sort_values(time)[value].to_numpy(float), window)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "place": np.arange(len(d), dtype=np.int32), "drift": d}, columns=[*keys, "place", "drift"])

    return df.groupBy(*keys).applyInPandas(run, f"{_kinds(df, keys)}, place int, drift double")


def low_steps(df: DataFrame, keys: list[str], percentile: float = 0.95, step: int = 16, time: str = "date", value: str = "value") -> DataFrame:
    """Steps below the normal range of their day of the year."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time).reset_index(drop=True)
        first = pd.Timestamp(pdf[time].iloc[0]).toordinal()
        return pdf.loc[L.low_steps(pdf[value].to_numpy(float), first, percentile, step), [*keys, time, value]]

    return df.select(*keys, time, value).groupBy(*keys).applyInPandas(run, _kinds(df, [*keys, time, value]))


def chain_times(df: DataFrame, keys: list[str], time: str = "place", value: str = "value") -> DataFrame:
    """Integrated and exponential autocorrelation time of a chain, and the lag-1 tau of its sign."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)[value].to_numpy(float)
        b = (x > np.median(x)).astype(int)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "integrated": integrated_time(x), "exponential": exponential_time(x), "sign_tau": float(binary_acf(b, 1)[1])}])

    return df.groupBy(*keys).applyInPandas(run, f"{_kinds(df, keys)}, integrated double, exponential double, sign_tau double")
