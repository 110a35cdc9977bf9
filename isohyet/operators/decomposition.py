"""Decomposition of keyed series: a task decomposes a series (or one noisy trial of one), modes come back as long rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .kernels import emd as K, filters as L


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns)


def _rows(pdf: pd.DataFrame, keys: list[str], time: str, parts: list[tuple[int, bool, np.ndarray]]) -> pd.DataFrame:
    head = {k: pdf[k].iloc[0] for k in keys}
    return pd.concat([pd.DataFrame({**head, time: pdf[time].to_numpy(), "component": c, "is_residual": r, "value": v}) for c, r, v in parts], ignore_index=True)


def _modes(pdf: pd.DataFrame, keys: list[str], time: str, modes: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    imfs, rest = K.with_residue(modes, s)
    return _rows(pdf, keys, time, [*((i + 1, False, m) for i, m in enumerate(imfs)), (len(imfs) + 1, True, rest)])


def _prepared(pdf: pd.DataFrame, time: str, value: str) -> tuple[pd.DataFrame, np.ndarray | None]:
    pdf = pdf.sort_values(time).reset_index(drop=True)
    s = L.interpolated(pdf[value].to_numpy(float), most=0.999999)
    return pdf, s


def emd(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", **options) -> DataFrame:
    """component from 1, the residue flagged and last; components of a series add up to it (gaps interpolated)."""
    schema = f"{_kinds(df, [*keys, time])}, component int, is_residual boolean, value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s = _prepared(pdf, time, value)
        if s is None:
            return pd.DataFrame({c: [] for c in [*keys, time, "component", "is_residual", "value"]}, dtype=object)
        return _modes(pdf, keys, time, K.emd(s, **options), s)

    return df.select(*keys, time, value).groupBy(*keys).applyInPandas(run, schema)


def eemd(df: DataFrame, keys: list[str], trials: int = 2000, seed: int = 12345, width: float = 0.05, noise: str = "normal", per_task: int = 50, time: str = "date", value: str = "value", **options) -> DataFrame:
    """Ensemble means of each component over trials with added noise, and their deviation and count.

    Trials are dealt out: a task has `per_task` trials of a series, and sends only sums; noise depends on (seed, trial).
    A component that a trial lacks counts in the others' mean only. The residue is the series minus the components.
    """
    schema = f"{_kinds(df, [*keys, time])}, component int, total double, squares double, n long, original double"
    parts = -(-trials // per_task)
    dealt = df.select(*keys, time, value).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s = _prepared(pdf, time, value)
        if s is None:
            return pd.DataFrame({c: [] for c in [*keys, time, "component", "total", "squares", "n", "original"]}, dtype=object)
        sums: dict[int, list] = {}
        first = int(pdf["part"].iloc[0]) * per_task
        for k in range(first, min(first + per_task, trials)):
            for i, m in enumerate(K.trial(s, k, seed, width, noise, **options)):
                t = sums.setdefault(i + 1, [np.zeros(len(s)), np.zeros(len(s)), 0])
                t[0] += m
                t[1] += m * m
                t[2] += 1
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.concat([pd.DataFrame({**head, time: pdf[time].to_numpy(), "component": c, "total": t[0], "squares": t[1], "n": t[2], "original": s}) for c, t in sums.items()], ignore_index=True)

    out = dealt.groupBy(*keys, "part").applyInPandas(run, schema).groupBy(*keys, time, "component").agg(F.sum("total").alias("t"), F.sum("squares").alias("q"), F.sum("n").alias("count"), F.first("original").alias("original"))
    mean = F.col("t") / F.col("count")
    out = out.select(*keys, time, "component", F.lit(False).alias("is_residual"), mean.alias("value"), F.sqrt(F.greatest(F.col("q") / F.col("count") - mean * mean, F.lit(0.0))).alias("deviation"), "count", "original")
    rest = out.groupBy(*keys, time).agg((F.max("component") + 1).alias("component"), F.lit(True).alias("is_residual"), (F.first("original") - F.sum("value")).alias("value"), F.lit(0.0).alias("deviation"), F.max("count").alias("count"))
    return out.drop("original").unionByName(rest)


def ceemdan(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", **options) -> DataFrame:
    schema = f"{_kinds(df, [*keys, time])}, component int, is_residual boolean, value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s = _prepared(pdf, time, value)
        if s is None:
            return pd.DataFrame({c: [] for c in [*keys, time, "component", "is_residual", "value"]}, dtype=object)
        modes = K.ceemdan(s, **options)
        return _rows(pdf, keys, time, [(i + 1, i == len(modes) - 1, m) for i, m in enumerate(modes)])

    return df.select(*keys, time, value).groupBy(*keys).applyInPandas(run, schema)


def emd2d(images: DataFrame, keys: list[str], value: str = "value", max_imf: int = -1, radial: bool = False) -> DataFrame:
    """Modes of images (keys, y, x, value) as (component, y, x, value); they add up. radial takes cubic radial surfaces."""
    schema = f"{_kinds(images, keys)}, component int, y int, x int, value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index="y", columns="x", values=value)
        z = grid.to_numpy(float)
        z = np.where(np.isfinite(z), z, np.nanmean(z))
        yy, xx = np.meshgrid(grid.index, grid.columns, indexing="ij")
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.concat([pd.DataFrame({**head, "component": i + 1, "y": yy.ravel(), "x": xx.ravel(), "value": m.ravel()}) for i, m in enumerate(K.emd2d(z, max_imf, radial=radial))], ignore_index=True)

    return images.select(*keys, "y", "x", value).groupBy(*keys).applyInPandas(run, schema)


def stl(df: DataFrame, keys: list[str], period: int = 12, seasonal: int = 13, trend: int | None = 121, robust: bool = False, time: str = "date", value: str = "value", most_missing: float = 1.0) -> DataFrame:
    """Components 1 trend, 2 seasonal, and the remainder; series with a larger share of gaps than most_missing give none."""
    schema = f"{_kinds(df, [*keys, time])}, component int, is_residual boolean, value double"
    options = {"low_pass": 25, "inner": 1, "outer": 3, "robust": True} if robust else {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time).reset_index(drop=True)
        s = L.interpolated(pdf[value].to_numpy(float), min(most_missing, 0.999999))
        if s is None or len(s) < 2 * period:
            return pd.DataFrame({c: [] for c in [*keys, time, "component", "is_residual", "value"]}, dtype=object)
        t, c, r = L.stl(s, period, seasonal, trend, **options)
        return _rows(pdf, keys, time, [(1, False, t), (2, False, c), (3, True, r)])

    return df.select(*keys, time, value).groupBy(*keys).applyInPandas(run, schema)


def significance(modes: DataFrame, keys: list[str], time: str = "date", test: str = "aposteriori", alpha: float = 0.95) -> DataFrame:
    """significant: 1 for components whose energy is not that of white noise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf[~pdf["is_residual"]].pivot_table(index=time, columns="component", values="value")
        head = {k: pdf[k].iloc[0] for k in keys}
        found = K.white_noise_check(wide.to_numpy(float).T, test, 1, alpha) if wide.shape[1] else {}
        return pd.DataFrame([{**head, "component": int(c), "significant": v} for c, v in zip(wide.columns, found.values(), strict=True)], columns=[*keys, "component", "significant"])

    return modes.groupBy(*keys).applyInPandas(run, f"{_kinds(modes, keys)}, component int, significant int")


def instantaneous_frequency(modes: DataFrame, keys: list[str], step: float, time: str = "date", compact: bool = True) -> DataFrame:
    """Cycles per unit of step of each component, from the phase of its analytic signal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        v = pdf["value"].to_numpy(float)
        f = K.instantaneous_frequency(v, np.arange(len(v)) * step, order=compact) if len(v) > 7 else np.full(len(v), np.nan)
        return pdf[[*keys, time, "component"]].assign(frequency=f if compact or len(v) <= 7 else np.r_[f, f[-1]])

    return modes.where("not is_residual").groupBy(*keys, "component").applyInPandas(run, f"{_kinds(modes, [*keys, time])}, component int, frequency double")


def cut_overflow(modes: DataFrame, keys: list[str], most: int, time: str = "date") -> DataFrame:
    """Components above `most` are added to it; the residue stays."""
    to = F.when(F.col("is_residual"), F.col("component")).otherwise(F.least("component", F.lit(most)))
    return modes.groupBy(*keys, time, to.alias("component"), "is_residual").agg(F.sum("value").alias("value"))


def cut_unmatched(modes: DataFrame, keys: list[str], over: str, time: str = "date") -> DataFrame:
    """Components that not every `over` of their keys has are added to the nearest lower one that all have (the first, if none)."""
    inner = [k for k in keys if k != over]
    imfs = modes.where("not is_residual")
    need = imfs.groupBy(*inner).agg(F.count_distinct(over).alias("__n"))
    every = imfs.groupBy(*inner, "component").agg(F.count_distinct(over).alias("__have")).join(need, inner).where("__have = __n")
    kept = every.groupBy(*inner).agg(F.sort_array(F.collect_set("component")).alias("__kept"))
    j = modes.join(kept, inner, "left")
    lower = F.array_max(F.filter("__kept", lambda c: c <= F.col("component")))
    to = F.when(F.col("is_residual"), F.col("component")).otherwise(F.coalesce(lower, F.array_min("__kept"), F.lit(1)))
    return j.withColumn("__to", to).groupBy(*keys, time, F.col("__to").alias("component"), "is_residual").agg(F.sum("value").alias("value"))


def merge_components(modes: DataFrame, keys: list[str], groups: list[tuple[int, int]], time: str = "date") -> DataFrame:
    """Components in each (low, high] become one; components are numbered anew from 1, the residue stays last."""
    to = F.col("component")
    for low, high in groups:
        to = F.when((F.col("component") > low) & (F.col("component") <= high), F.lit(low + 1)).otherwise(to)
    grouped = modes.withColumn("__to", to).groupBy(*keys, time, "is_residual", "__to").agg(F.sum("value").alias("value"))
    order = W.partitionBy(*keys, time).orderBy("is_residual", "__to")
    return grouped.withColumn("component", F.dense_rank().over(order)).drop("__to")
