"""Filters, gap filling, scaling, calendar aggregation and bias correction of keyed series. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import calendar as C


def select_time(df: DataFrame, start, end, time: str = "date", leap: bool = False) -> DataFrame:
    """Rows with start <= date <= end; leap drops every 29 February."""
    df = df.where(F.col(time).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df.where(~C.is_leap_day(F.col(time))) if leap else df


def fill_month_mean(df: DataFrame, keys: list[str], time: str = "date", value: str = "value") -> DataFrame:
    """Missing values become the mean of their calendar month in their series."""
    w = W.partitionBy(*keys, F.month(time))
    return df.withColumn(value, F.coalesce(C.to_null(F.col(value)), F.avg(C.to_null(F.col(value))).over(w)))


def drop_sparse(df: DataFrame, by: list[str], value: str = "value", threshold: float = 0.05) -> DataFrame:
    """Without the columns (long form: groups `by`) whose share of missing values is above threshold."""
    dense = df.groupBy(*by).agg(F.avg(F.col(value).isNull().cast("double")).alias("__missing")).where(F.col("__missing") <= threshold)
    return df.join(dense.select(*by), by, "left_semi")


def whole_years(df: DataFrame, keys: list[str], time: str = "date") -> DataFrame:
    """From each series' first January to its last December."""
    w = W.partitionBy(*keys)
    first = F.min(F.when(F.month(time) == 1, F.col(time))).over(w)
    last = F.max(F.when(F.month(time) == 12, F.col(time))).over(w)
    return df.withColumns({"__a": first, "__b": last}).where(F.col(time).between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def common_times(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without rows whose keys and time the other lacks."""
    return a.join(b.select(*on).distinct(), on, "left_semi"), b.join(a.select(*on).distinct(), on, "left_semi")


def in_every(df: DataFrame, keys: list[str], item: str, over: str, value: str = "value") -> DataFrame:
    """Rows of the items that are present and not all missing in every `over` of their keys."""
    need = df.groupBy(*keys).agg(F.count_distinct(over).alias("__n"))
    have = df.where(F.col(value).isNotNull()).groupBy(*keys, item).agg(F.count_distinct(over).alias("__have"))
    match = have.join(need, keys).where("__have = __n").select(*keys, item)
    return df.join(match, [*keys, item], "left_semi")


def min_max(df: DataFrame, keys: list[str], value: str = "value", reverse: bool = False, bounds: tuple[float, float] | None = None) -> DataFrame:
    """value scaled to [0, 1] within its keys or by given (min, max); reversed if asked. Null where there is no spread."""
    w = W.partitionBy(*keys)
    low, high = (F.lit(x) for x in bounds) if bounds else (F.min(value).over(w), F.max(value).over(w))
    up = F.try_divide(high - F.col(value), high - low) if reverse else F.try_divide(F.col(value) - low, high - low)
    return df.withColumn("scaled", up)


def fit_scaler(dfs: list[DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """The scaler of several tables at once: keys with their min and max over all, for the columns they share."""
    shared = [c for c in dfs[0].columns if all(c in d.columns for d in dfs)]
    every = dfs[0].select(*shared)
    for d in dfs[1:]:
        every = every.unionByName(d.select(*shared))
    return every.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def apply_scaler(df: DataFrame, scaler: DataFrame, keys: list[str], value: str = "value", inverse: bool = False) -> DataFrame:
    joined = df.join(scaler, keys)
    out = F.col(value) * (F.col("high") - F.col("low")) + F.col("low") if inverse else F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low"))
    return joined.withColumn("scaled", out).drop("low", "high")


def joint_min_max(df: DataFrame, keys: list[str], columns: list[str], cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """All columns scaled by their common minimum and maximum.

    Bounds are aggregated and joined back, so that no task holds all rows of a key. cut may write the bounds and read them
    again: few ones are then broadcast by their size, and the rows are not shuffled.
    """
    least, most = (f(*columns) if len(columns) > 1 else F.col(columns[0]) for f in (F.least, F.greatest))
    names = [f"__key{i}" for i in range(len(keys))]
    bounds = cut(df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min(least).alias("__low"), F.max(most).alias("__high")))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    joined = df.join(bounds, same, "left") if keys else df.crossJoin(bounds)
    low, high = F.col("__low"), F.col("__high")
    return joined.withColumns({c: F.try_divide(F.col(c) - low, high - low) for c in columns}).drop(*names, "__low", "__high")


def split_years(df: DataFrame, keys: list[str], time: str = "date", train: float = 0.7, group: int = 10) -> DataFrame:
    """is_train: the i-th year of a series trains if i modulo group is below train * group."""
    i = F.dense_rank().over(W.partitionBy(*keys).orderBy(F.year(time))) - 1
    return df.withColumn("is_train", F.pmod(i, F.lit(group)) < train * group)


def guard_series(df: DataFrame, keys: list[str], value: str = "value", infinite_to_mean: bool = False) -> DataFrame:
    """Without series that are all missing, infinite or zero; NaN becomes the mean, infinity 0 (or the mean)."""
    w, v = W.partitionBy(*keys), F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    kept = df.withColumns({"__use": F.count_if(finite & (v != 0)).over(w), "__mean": F.avg(F.when(finite, v)).over(w)}).where("__use > 0")
    fixed = F.when(finite, v).when(F.abs(v) == float("inf"), F.col("__mean") if infinite_to_mean else F.lit(0.0)).otherwise(F.col("__mean"))
    return kept.withColumn(value, fixed).drop("__use", "__mean")


def monthly(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", how: Callable[[Column], Column] = F.avg) -> DataFrame:
    """One value a month, at its first day; a sum of nothing is null."""
    return df.groupBy(*keys, F.trunc(time, "MM").alias("date")).agg(how(C.to_null(F.col(value))).alias("value"))


def by_rule(df: DataFrame, keys: list[str], var: str = "var", summed: tuple[str, ...] = ("PRE", "RS"), time: str = "date", value: str = "value") -> DataFrame:
    """Monthly values by variable: sums for `summed`, means for the rest."""
    how = F.when(F.col(var).isin(*summed), F.sum(value)).otherwise(F.avg(value))
    return df.groupBy(*keys, var, F.trunc(time, "MM").alias("date")).agg(how.alias("value"))


def seasons(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", how: Callable[[Column], Column] = F.avg) -> DataFrame:
    """The monthly climatology aggregated by season, in the order Spring to Winter."""
    months = df.groupBy(*keys, F.month(time).alias("month")).agg(F.avg(value).alias("value"))
    by = months.groupBy(*keys, C.season(F.col("month")).alias("season"), C.season_order(F.col("month")).alias("season_order"))
    return by.agg(how(F.col("value")).alias("value"))


def season_means(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", total: bool = False) -> DataFrame:
    """Season means of each year; three times that if total."""
    out = F.avg(value) * 3 if total else F.avg(value)
    return df.groupBy(*keys, F.year(time).alias("year"), C.season(F.month(time)).alias("season")).agg(out.alias("value"))


def yearly(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", how: Callable[[Column], Column] = F.avg, empty: float | None = None) -> DataFrame:
    """One value a year; `empty` stands for a year without values (0 for sums as pandas has it)."""
    v = how(C.to_null(F.col(value)))
    return df.groupBy(*keys, F.year(time).alias("year")).agg((v if empty is None else F.coalesce(v, F.lit(empty))).alias("value"))


def multi_year_mean(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", mode: str = "year") -> DataFrame:
    """Mean over years of yearly sums, or of each month's or each day's sums."""
    unit = {"year": [], "month": [F.month(time).alias("unit")], "day": [F.dayofyear(time).alias("unit")]}[mode]
    per = df.groupBy(*keys, F.year(time).alias("year"), *unit).agg(F.sum(value).alias("v"))
    return per.groupBy(*keys, *(["unit"] if unit else [])).agg(F.avg("v").alias("value"))


def moving_average(df: DataFrame, keys: list[str], n: int, time: str = "date", value: str = "value") -> DataFrame:
    """Means of n consecutive values, at the last of them; N - n + 1 rows a series."""
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(-(n - 1), 0)
    out = df.withColumns({"moving": F.avg(value).over(w), "__n": F.count(F.lit(1)).over(w)})
    return out.where(F.col("__n") == n).drop("__n")


def correct_monthly(daily: DataFrame, target: DataFrame, keys: list[str], time: str = "date", value: str = "value", how: str = "sum", corrector: str = "scaling") -> DataFrame:
    """Daily values moved so that their month meets the target: + (target - aggregate), or x target / aggregate; no factor is 0."""
    agg = {"sum": F.sum, "mean": F.avg}[how]
    w = W.partitionBy(*keys, F.trunc(time, "MM"))
    wanted = target.select(*keys, F.trunc(time, "MM").alias("__month"), F.col(value).alias("__target"))
    rows = daily.withColumns({"__month": F.trunc(time, "MM"), "__agg": agg(value).over(w)}).join(wanted, [*keys, "__month"])
    if corrector == "scaling":
        out = F.col(value) * F.coalesce(F.try_divide("__target", "__agg"), F.lit(0.0))
    else:
        out = F.col(value) + F.coalesce(F.col("__target") - F.col("__agg"), F.lit(0.0))
    return rows.withColumn("corrected", out).drop("__month", "__agg", "__target")


def climatology_anomaly(steps: DataFrame, climate: DataFrame, keys: list[str], length: int = 16, time: str = "date", value: str = "value") -> DataFrame:
    """Each step's value minus the mean climatology of the `length` days up to its own; days before 1 wrap to the year's end.

    climate: keys, doy (1 .. 365), value. Each step meets `length` rows of it, by equality. The climatology grows with the
    keys, and Spark takes rows exploded from a small table for few: it is merged, never broadcast.
    """
    days = steps.withColumn("__back", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    days = days.withColumn("doy", (F.pmod(C.doy365(F.col(time)) - 1 - F.col("__back"), F.lit(365)) + 1).cast("int"))
    mean = days.join(climate.select(*keys, F.col("doy").cast("int").alias("doy"), F.col(value).alias("__normal")).hint("merge"), [*keys, "doy"])
    return mean.groupBy(*keys, time).agg((F.first(value) - F.avg("__normal")).alias("anomaly"))
