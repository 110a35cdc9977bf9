"""The daily weather generator and multi-site repair on keyed tables; what aggregates can say is said in SQL functions."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.calendar import doy365, is_leap_day
from .ensemble import hash_key
from .kernels import weather as K


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns)


def occurrence(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", threshold: float = K.WET) -> DataFrame:
    """p00 and p10 of the wet-day chain for each of the 26 fortnights of the 365-day year. The day before the first is dry."""
    days = df.where(~is_leap_day(F.col(time)) & F.col(value).isNotNull() & (F.col(value) >= 0))
    wet = (F.col(value) > threshold).cast("int")
    days = days.withColumns({"__wet": wet, "__before": F.coalesce(F.lag(wet).over(W.partitionBy(*keys).orderBy(time)), F.lit(0))})
    days = days.withColumn("fortnight", F.floor((doy365(F.col(time)) - 1) / 14).cast("int")).where("fortnight < 26")
    n = lambda a, b: F.count_if((F.col("__before") == a) & (F.col("__wet") == b))
    out = days.groupBy(*keys, "fortnight").agg(n(0, 0).alias("a00"), n(0, 1).alias("a01"), n(1, 0).alias("a10"), n(1, 1).alias("a11"))
    return out.withColumns({"p00": F.try_divide("a00", F.col("a00") + F.col("a01")), "p10": F.try_divide("a10", F.col("a10") + F.col("a11"))})


def harmonics(df: DataFrame, keys: list[str], place: str, n: int, value: str = "value", level: int = 2) -> DataFrame:
    """Mean, and sine and cosine coefficients with amplitude and phase, of the least-squares harmonics of a whole cycle of n steps (place 1 .. n).

    On a whole cycle the harmonics are orthogonal, so the coefficients are plain sums.
    """
    t = F.col(place) * (2 * np.pi / n)
    aggs = [F.avg(value).alias("mean")]
    for j in range(1, level + 1):
        aggs += [(F.sum(F.col(value) * F.sin(t * j)) * 2 / n).alias(f"s{j}"), (F.sum(F.col(value) * F.cos(t * j)) * 2 / n).alias(f"c{j}")]
    out = df.groupBy(*keys).agg(*aggs)
    for j in range(1, level + 1):
        phase = F.atan(F.try_divide(f"c{j}", f"s{j}"))
        out = out.withColumns({f"phase{j}": phase, f"amplitude{j}": F.try_divide(F.col(f"s{j}"), F.cos(phase))})
    return out


def state_moments(df: DataFrame, keys: list[str], wet: str = "wet", time: str = "date", value: str = "value") -> DataFrame:
    """Mean and deviation (ddof 1) of each day of the 365-day year on wet and dry days, 0 where there is none."""
    d = df.where(~is_leap_day(F.col(time))).groupBy(*keys, doy365(F.col(time)).alias("doy"), wet)
    return d.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


#: The generator's variables and how their months are met.
RULES = {"PRE": ("sum", "scaling"), "MAXTEM": ("mean", "translation"), "MINTEM": ("mean", "translation"), "RHU": ("mean", "scaling"), "RS": ("sum", "scaling"), "WIN": ("mean", "scaling")}


def _matrices(pdf: pd.DataFrame, variables: list[str]) -> tuple[int, dict[str, np.ndarray]]:
    d = pd.to_datetime(pdf["date"])
    pdf = pdf[~((d.dt.month == 2) & (d.dt.day == 29))].sort_values("date")
    years = len(pdf) // 365
    return years, {v: pdf[v].to_numpy(float)[: years * 365].reshape(years, 365) for v in variables if v in pdf}


def fit_generator(daily: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Parameters per key, as a JSON text, from whole years of daily rows (date and the variables)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        years, obs = _matrices(pdf, variables)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "model": json.dumps(_plain(K.fit(obs))) if years else None}])

    return daily.select(*keys, "date", *variables).groupBy(*keys).applyInPandas(run, f"{_kinds(daily, keys)}, model string")


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x.tolist() if isinstance(x, (np.ndarray, np.generic)) else x


def _model(text: str) -> dict:
    m = json.loads(text)
    months = lambda d: {int(k): (v[0], v[1]) for k, v in d.items()}
    m["occurrence"], m["rain"] = np.array(m["occurrence"]), months(m["rain"])
    m["draws"] = {v: {int(s): months(x) for s, x in d.items()} for v, d in m["draws"].items()}
    for s in m["cycles"].values():
        s.update({k: np.array(v) for k, v in s.items()})
    if t := m.get("temperature"):
        t["a"], t["b"] = np.array(t["a"]), np.array(t["b"])
        for s in ("high", "low"):
            t[s] = {k: np.array(v) for k, v in t[s].items()}
    return m


def generate(models: DataFrame, targets: DataFrame, keys: list[str], variables: list[str], rules: dict[str, tuple[str, str]] | None = None, seed: int = 0) -> DataFrame:
    """Daily rows for the months of targets (keys, date at month start, variables), whole years; 29 February repeats the day before.

    Fitted or scenario months may be the targets alike. The seed and the keys alone decide the draws.
    """
    rules = RULES if rules is None else rules
    names = list(variables)
    rows = targets.select(*keys, "date", *names).join(models, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        first, years = pd.Timestamp(pdf["date"].iloc[0]).year, len(pdf) // 12
        head = {k: pdf[k].iloc[0] for k in keys}
        out = K.generate(_model(pdf["model"].iloc[0]), {v: pdf[v].to_numpy(float)[: 12 * years] for v in names}, years, rules, (seed, *(hash_key(str(v)) for v in head.values())))
        days = pd.date_range(f"{first}-01-01", f"{first + years - 1}-12-31")
        plain = days[~((days.month == 2) & (days.day == 29))]
        frame = pd.DataFrame({v: out.get(v, np.full(len(plain), np.nan)) for v in names}, index=plain).reindex(days).ffill()
        return frame.rename_axis("date").reset_index().assign(date=lambda d: d["date"].dt.date, **head)[[*keys, "date", *names]]

    return rows.groupBy(*keys).applyInPandas(run, f"{_kinds(targets, keys)}, date date, " + ", ".join(f"{v} double" for v in names))


def multi_site(obs: DataFrame, gen: DataFrame, keys: list[str], station: str = "station", time: str = "date", value: str = "value", fill: bool = False, threshold: float = 0.1, rate: float = 1e3, seed: int = 0) -> DataFrame:
    """gen's values put in an order in time that gives its stations the observed rank correlation, per key (say variable and month)."""
    both = obs.select(*keys, F.lit("obs").alias("__side"), station, time, value).unionByName(gen.select(*keys, F.lit("gen").alias("__side"), station, time, value))
    schema = f"{_kinds(gen, [*keys, station, time])}, {value} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {s: g.pivot_table(index=time, columns=station, values=value).dropna() for s, g in pdf.groupby("__side")}
        names = sorted(set(side.get("obs", pd.DataFrame()).columns) & set(side.get("gen", pd.DataFrame()).columns))
        if len(names) < 2:
            return pd.DataFrame({c: [] for c in [*keys, station, time, value]}, dtype=object)
        obs, out = side["obs"][names].to_numpy(), side["gen"][names].to_numpy()
        if min(len(obs), len(out)) > 1:  # else there is no order to put them in
            out, _ = K.multi_site(obs, out, fill, threshold, rate, seed)
        long = pd.DataFrame(out, index=side["gen"].index, columns=names).rename_axis(columns=station).stack().rename(value).reset_index()
        return long.assign(**{k: pdf[k].iloc[0] for k in keys})

    return both.groupBy(*keys).applyInPandas(run, schema)
