"""Streaming forms: windowed aggregates of late observations, and a filter that keeps a key's state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, keys: list[str], length: str = "1 day", slide: str | None = None, late: str = "1 hour", time: str = "ts", value: str = "value") -> DataFrame:
    """Count, mean and sum of each key in time windows; observations later than `late` are dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "mean", "total")


def filtered(stream: DataFrame, key: str, time: str = "ts", value: str = "value", discount: float = 0.98) -> DataFrame:
    """One-step forecasts and levels of a discounted local-level model, a row an observation, with the state kept for each key.

    Within a batch a key's observations are taken in time order; a missing value moves nothing.
    """
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, c, s, nu = state.get if state.exists else (0.0, 1e6, 1.0, 1.0)
        for pdf in frames:
            pdf = pdf.sort_values(time)
            rows = []
            for t, y in zip(pdf[time], pdf[value].to_numpy(float), strict=True):
                r, forecast = c / discount, m
                if np.isfinite(y):
                    q = r + s
                    e, a = y - m, r / q
                    nu = discount * nu + 1
                    ratio = 1 + (e * e / q - 1) / nu
                    m, c, s = m + a * e, ratio * (r - a * a * q), max(s * ratio, 1e-12)
                rows.append((k[0], t, forecast, m))
            yield pd.DataFrame(rows, columns=["key", "ts", "forecast", "level"])
        state.update((float(m), float(c), float(s), float(nu)))

    return stream.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"key {kind}, ts timestamp, forecast double, level double", "m double, c double, s double, nu double", "append", GroupStateTimeout.NoTimeout)
