"""Skill of simulated columns against an observed one, and contingency scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import metrics as M


def metrics(df: DataFrame, keys: list[str], obs: str = "obs", sim: str = "sim") -> DataFrame:
    """All metrics of the pairs of each key."""
    o, s = F.col(obs), F.col(sim)
    return df.groupBy(*keys).agg(
        M.cov(s).alias("cov"), M.nse(o, s).alias("nse"), M.pbias(o, s).alias("pbias"), M.mean(s).alias("mean"), M.variance(s).alias("variance"), M.std(s).alias("std"),
        M.std_ratio(o, s).alias("std_ratio"), M.rms(s).alias("rms"), M.mse(o, s).alias("mse"), M.rmse(o, s).alias("rmse"), M.mae(o, s).alias("mae"), M.rsr(o, s).alias("rsr"), M.correlation(o, s).alias("cc"),
    )


def recognition(df: DataFrame, keys: list[str], obs: str = "obs", sim: str = "sim", low: float = -2.0, high: float = 2.0) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in M.detection(F.col(obs), F.col(sim), low, high).items()])


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, control: str) -> DataFrame:
    return df.groupBy(*keys).agg(M.partial_correlation(F.col(x), F.col(y), F.col(control)).alias("r"))


def report(df: DataFrame, obs: str, simulated: list[str]) -> DataFrame:
    """A table of CoV, CC, NSE and PBIAS: a row a metric, a column a simulated column."""
    long = df.unpivot([obs], simulated, "model", "sim")
    o, s = F.col(obs), F.col("sim")
    wide = long.groupBy("model").agg(M.cov(s).alias("CoV"), M.correlation(o, s).alias("CC"), M.nse(o, s).alias("NSE"), M.pbias(o, s).alias("PBIAS"))
    return wide.unpivot(["model"], ["CoV", "CC", "NSE", "PBIAS"], "metric", "value").groupBy("metric").pivot("model", simulated).agg(F.first("value"))
