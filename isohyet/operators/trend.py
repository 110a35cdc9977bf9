"""Trend, change-point and dependence statistics of keyed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import calendar as C, series as S


def mann_kendall(df: DataFrame, keys: list[str], time: str = "date", value: str = "value") -> DataFrame:
    """S, its variance, Z, Kendall's tau, Sen's slope and the significance class of each series; null for constant or empty ones."""
    x = S.gather(df, keys, time, value).withColumn("__x", S.filled(F.col("series")))
    out = x.withColumn("t", S.trend("__x")).select(*keys, "__x", F.size("series").alias("n"), "t.*")
    out = out.withColumns({k: F.when(F.col("__x").isNotNull(), F.col(k)) for k in ("s", "var_s", "sen")})
    out = out.withColumn("z", F.when(F.col("__x").isNotNull(), S.mk_z(F.col("s"), F.col("var_s"))))
    return out.withColumns({"tau": S.mk_tau(F.col("s"), F.col("n")), "class": C.significance(F.col("z"))}).drop("__x")


def sen_interval(df: DataFrame, z: float = 1.96) -> DataFrame:
    """Adds c = z * sqrt(var_s), the half width in ranks of Sen's interval."""
    return df.withColumn("c", z * F.sqrt("var_s"))


def pettitt(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", prewhiten: bool = False) -> DataFrame:
    """The change point of each series; prewhiten takes out trend and lag-1 correlation first (trend-free pre-whitening)."""
    x = S.gather(df, keys, time, value).withColumn("__x", S.filled(F.col("series"))).where("__x is not null")
    if prewhiten:
        x = x.withColumn("__x", S.prewhitened("__x"))
    # The signs of a value minus each other one sum to the values below it minus those above: both follow from its rank.
    rows = x.select(*keys, F.posexplode("__x").alias("__place", "__v"))
    series, tied = W.partitionBy(*keys), W.partitionBy(*keys, "__v")
    rows = rows.withColumn("sign", 2.0 * (F.rank().over(series.orderBy("__v")) - 1) + F.count(F.lit(1)).over(tied) - F.count(F.lit(1)).over(series))
    upto = series.orderBy("__place").rowsBetween(W.unboundedPreceding, 0)
    u = F.sum(F.when(F.col("__place") > 0, F.col("sign")).otherwise(0.0)).over(upto)
    rows = rows.withColumn("u", u).where("__place > 0")
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.abs("u").alias("size"), (1 - F.col("__place")).alias("back"), "u")).alias("best"), (F.count(F.lit(1)) + 1).cast("double").alias("n"))
    return best.select(*keys, S.pettitt(F.col("best"), F.col("n")).alias("p")).select(*keys, "p.*")


def sequential_mk(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", textbook: bool = False) -> DataFrame:
    """UF, UB and whether they cross, a row a step (place from 0)."""
    x = S.gather(df, keys, time, value).withColumn("__x", S.filled(F.col("series"))).where("__x is not null")
    x = x.withColumn("u", S.sequential_mk(F.col("__x"), textbook))
    rows = x.select(*keys, F.posexplode(F.arrays_zip("u.uf", "u.ub")).alias("place", "u")).select(*keys, "place", "u.uf", "u.ub")
    gap = F.col("uf") - F.col("ub")
    turned = gap * F.lag(gap).over(W.partitionBy(*keys).orderBy("place")) < 0
    return rows.withColumn("crossing", F.coalesce(turned, F.lit(False)))


def slowing_points(df: DataFrame, keys: list[str], ac: str, trigger: int, time: str = "date", value: str = "value") -> DataFrame:
    """Least `ac` at the crossings after `trigger` whose Sen slope before exceeds the one after; null if there is none."""
    x = S.gather(df, keys, time, value).withColumn("__x", S.filled(F.col("series")))
    x = x.join(S.gather(df, keys, time, ac, "ac"), keys).where("__x is not null")
    return x.select(*keys, S.slowing(trigger)("__x", "ac").alias("least_ac"))


def split_at(df: DataFrame, keys: list[str], place: str, point: str) -> DataFrame:
    """part: before, point or after, by the place of a row against its series' point."""
    part = F.when(F.col(place) < F.col(point), "before").when(F.col(place) > F.col(point), "after").otherwise("point")
    return df.withColumn("part", part)


def ols(y: Column, x: Column) -> dict[str, Column]:
    """Aggregates of the line y = intercept + slope x: slope, intercept, r2, t of the slope, degrees of freedom."""
    n, sxx, syy, slope = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_slope(y, x)
    left = F.greatest(syy - slope * F.regr_sxy(y, x), F.lit(0.0))
    t = F.try_divide(F.abs(slope), F.sqrt(F.try_divide(F.try_divide(left, n - 2), sxx)))
    return {"slope": slope, "intercept": F.regr_intercept(y, x), "r2": F.regr_r2(y, x), "t": t, "df": n - 2}


def linear_slope(df: DataFrame, keys: list[str], y: str = "value", x: str = "place") -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in ols(F.col(y), F.col(x)).items()])


def with_place(df: DataFrame, keys: list[str], time: str = "date") -> DataFrame:
    """place: the row's number in its series, from 0."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(time)) - 1)


def hurst(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", least: int = 20) -> DataFrame:
    """Rescaled-range exponent: chunks of k = 4 .. N/2 values without the ragged end; null below `least` values."""
    rows = with_place(df.where(F.col(value).isNotNull()), keys, time).withColumn("n", F.count("*").over(W.partitionBy(*keys))).where(F.col("n") >= least)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(4), F.floor(F.col("n") / 2).cast("int")))).withColumn("chunk", F.floor(F.col("place") / F.col("k")))
    rows = rows.where((F.col("chunk") + 1) * F.col("k") <= F.col("n"))
    chunk = W.partitionBy(*keys, "k", "chunk")
    rows = rows.withColumn("mean", F.avg(value).over(chunk))
    rows = rows.withColumn("cum", F.sum(F.col(value) - F.col("mean")).over(chunk.orderBy("place")))
    ulp = 2.220446049250313e-16
    rs = rows.groupBy(*keys, "k", "chunk").agg(((F.max("cum") - F.min("cum") + ulp) / (F.stddev_pop(value) + ulp)).alias("rs"))
    rs = rs.groupBy(*keys, "k").agg(F.avg("rs").alias("rs"))
    return rs.groupBy(*keys).agg(F.regr_slope(F.log("rs"), F.log(F.col("k").cast("double"))).alias("hurst"))


def class_shares(df: DataFrame, cls: str, zone: str | None = None, classes: tuple[int, ...] = (-2, -1, 0, 1, 2)) -> DataFrame:
    """Share of each class, for all (zone null) and, with a zone, for each."""
    shares = [F.try_divide(F.count_if(F.col(cls) == c), F.count(cls)).alias(f"share_{'m' if c < 0 else 'p' if c else ''}{abs(c)}") for c in classes]
    return df.where(F.col(zone).isNotNull()).rollup(zone).agg(*shares) if zone else df.agg(*shares)


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """r with its t and degrees of freedom, from pairs without nulls."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.where(both).groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    return out.withColumns({"t": F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))), "df": F.col("n") - 2})


def lag_one(df: DataFrame, keys: list[str], time: str = "date", value: str = "value") -> DataFrame:
    """nxt: the next value of the series."""
    return df.withColumn("nxt", F.lead(value).over(W.partitionBy(*keys).orderBy(time)))


def lag_one_fit(df: DataFrame, keys: list[str], time: str = "date", value: str = "value") -> DataFrame:
    """Slope and intercept of each value on the one before."""
    return lag_one(df, keys, time, value).groupBy(*keys).agg(F.regr_slope("nxt", value).alias("slope"), F.regr_intercept("nxt", value).alias("intercept"))


def rolling_autocorrelation(df: DataFrame, keys: list[str], window: int, time: str = "date", value: str = "value", centre: bool = False) -> DataFrame:
    """Slope and intercept of the next value on the value, over window + 1 steps from each; incomplete tails are dropped.

    centre subtracts the mean of the whole table first, which only changes intercepts.
    """
    if centre:
        mean = df.agg(F.avg(value).alias("m"))
        df = df.withColumn(value, F.col(value) - mean.scalar())
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(0, window)
    out = lag_one(df, keys, time, value).withColumns({"ac": F.regr_slope("nxt", value).over(w), "intercept": F.regr_intercept("nxt", value).over(w), "__n": F.count("nxt").over(w)})
    return out.where(F.col("__n") == window + 1).drop("__n", "nxt")


def residual_variance(df: DataFrame, keys: list[str], value: str = "value", alpha: str = "ac") -> DataFrame:
    """var_y: variance of the series over 1 - alpha^2 of the step."""
    return df.withColumn("var_y", F.try_divide(F.var_pop(value).over(W.partitionBy(*keys)), 1 - F.col(alpha) * F.col(alpha)))


def empirical_ac(df: DataFrame, keys: list[str], window: int, time: str = "date", value: str = "value") -> DataFrame:
    """Rolling lag-1 Pearson correlation over `window` pairs from each step, 0 where there is none."""
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(0, window - 1)
    out = lag_one(df, keys, time, value).withColumns({"r": F.corr("nxt", value).over(w), "__n": F.count(F.lit(1)).over(w)})
    return out.where(F.col("__n") == window).withColumn("r", F.when(F.isnan("r") | F.col("r").isNull(), 0.0).otherwise(F.col("r"))).drop("__n", "nxt")


def empirical_std(df: DataFrame, keys: list[str], window: int, time: str = "date", value: str = "value") -> DataFrame:
    """Rolling population deviation over `window` steps from each."""
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(0, window - 1)
    out = df.withColumns({"sd": F.stddev_pop(value).over(w), "__n": F.count(F.lit(1)).over(w)})
    return out.where(F.col("__n") == window).drop("__n")


def warning_runs(df: DataFrame, keys: list[str], mean: str, upper: str, place: str = "place", warm_up: int = 0, trailing: int = 6, hits: int = 6) -> DataFrame:
    """Steps after the warm-up at which the mean is above the median upper bound, `hits` times at least in the trailing window."""
    late = df.where(F.col(place) >= warm_up)
    late = late.withColumn("__bound", F.median(upper).over(W.partitionBy(*keys)))
    w = W.partitionBy(*keys).orderBy(place).rangeBetween(-trailing, 0)
    out = late.withColumn("__hits", F.count_if(F.col(mean) > F.col("__bound")).over(w))
    return out.where((F.col(mean) > F.col("__bound")) & (F.col("__hits") >= hits)).drop("__hits", "__bound")


def spearman_pairs(df: DataFrame, by: list[str], key: str, time: str = "date", value: str = "value") -> DataFrame:
    """Rank correlation (ties share their mean rank) of every two series of `key` with common times: a, b, rho."""
    w = W.partitionBy(*by, key)
    tie = W.partitionBy(*by, key, value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("rk", F.rank().over(w.orderBy(value)) + (F.count("*").over(tie) - 1) / 2)
    a = ranked.select(*by, F.col(key).alias("a"), time, F.col("rk").alias("ra"))
    b = ranked.select(*by, F.col(key).alias("b"), time, F.col("rk").alias("rb"))
    return a.join(b, [*by, time]).where("a < b").groupBy(*by, "a", "b").agg(F.corr("ra", "rb").alias("rho"))


def doy_detrend(df: DataFrame, keys: list[str], time: str = "date", value: str = "value") -> DataFrame:
    """Per day of the year: the value without the mean and the linear fit over the day's occurrences."""
    day = W.partitionBy(*keys, C.doy365(F.col(time)))
    rows = df.withColumn("__k", F.row_number().over(day.orderBy(time)))
    fit = F.regr_intercept(value, "__k").over(day) + F.regr_slope(value, "__k").over(day) * F.col("__k")
    return rows.withColumn("residual", F.coalesce(F.col(value) - fit, F.col(value) - F.avg(value).over(day))).drop("__k")


def report(df: DataFrame, keys: list[str], time: str = "date", value: str = "value", first_year: int = 0) -> DataFrame:
    """Texts of the trend test, Sen's slope, the change year and the slopes before and after it."""
    mk = mann_kendall(df, keys, time, value)
    point = pettitt(df, keys, time, value).select(*keys, "k", "p", F.col("class").alias("change_class"))
    rows = with_place(df, keys, time).join(point, keys)
    halves = rows.groupBy(*keys).agg(F.regr_slope(F.when(F.col("place") < F.col("k"), F.col(value)), "place").alias("before"), F.regr_slope(F.when(F.col("place") > F.col("k"), F.col(value)), "place").alias("after"))
    out = mk.join(point, keys).join(halves, keys)
    return out.select(*keys, F.format_string("%.3f", "z").alias("mk"), F.format_string("%.4f", "sen").alias("slope"), (F.col("k") + first_year).alias("change"), F.format_string("%.4f", "before").alias("before"), F.format_string("%.4f", "after").alias("after"))
