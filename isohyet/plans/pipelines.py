"""Whole chains, one lazy plan each: the station pipeline and the pixel pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as C
from ..operators import downscaling as D, dynamic, ensemble as E, temporal as T, trend as R


def calibrate(predictors: DataFrame, predictand: DataFrame, keys: list[str], names: list[str], most: int = 10, time: str = "date") -> tuple[DataFrame, DataFrame]:
    """Coefficients of each key (models and stations alike), and the scaled rows they were fitted on.

    predictors: keys, date, names; predictand: keys without the model, date, value.
    """
    shared = [k for k in keys if k in predictand.columns]
    rows = predictors.join(predictand.withColumnRenamed("value", "target"), [*shared, time])
    for n in names:
        rows = T.min_max(T.fill_month_mean(rows, keys, time, n), keys, n).drop(n).withColumnRenamed("scaled", n)
    rows = T.split_years(rows, keys, time)
    return D.fit_linear(rows, keys, names, ["target"], most), rows


def station_trends(daily: DataFrame, keys: list[str], how=F.avg, time: str = "date", value: str = "value") -> DataFrame:
    """Monthly values, gaps filled by month means, then the trend of each series and its class."""
    filled = T.fill_month_mean(T.monthly(daily, keys, time, value, how), keys)
    return R.mann_kendall(filled, keys)


def weighted_ensemble(models: DataFrame, keys: list[str], conditional: bool = False) -> DataFrame:
    """Estimates of an ensemble (keys, date, gcm, value, obs) by inverse-deviation weights."""
    weights = E.quick_weights(models, keys)
    return E.apply_weights(models, weights, keys, conditional=conditional)


def pixel_resilience(cube: DataFrame, window: int, time: str = "time", value: str = "value", bayesian: bool = False) -> DataFrame:
    """From a cube (y, x, time, value): residuals by day of the year, lag-1 coefficients, their residual variance, and the trend of the coefficient."""
    keys = ["y", "x"]
    clean = T.guard_series(cube.withColumn(value, C.clean(F.col(value), 0.0)), keys, value)
    flat = R.doy_detrend(clean, keys, time, value).select(*keys, time, F.col("residual").alias("value"))
    ac = dynamic.lag_coefficient(flat, keys, time) if bayesian else R.rolling_autocorrelation(flat, keys, window, time)
    return R.mann_kendall(ac, keys, time, "ac")
