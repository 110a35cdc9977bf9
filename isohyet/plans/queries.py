"""One query an operator over the bundled tables, with DuckDB SQL that gives the same rows where SQL can.

Values are rounded to six places where sums of floats could end differently.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import calendar as C, display as V, landscape as L
from ..operators import composites as CO, decomposition as D, downscaling as DS, dynamic as DY, ensemble as E, kriging as KR, polygons as PG, skill as K, spatial as SP, temporal as T, trend as R, weather as G
from ..sources import netcdf, rasters, sinks, tables
from . import inputs as I, pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Means of a few amounts can end exactly between two rounded values, where engines differ: this moves them off.
NUDGE = 0.0000123


def rounded(df: DataFrame, *columns: str, places: int = 6, nudge: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + nudge, places) for c in columns})


# Trends. -----------------------------------------------------------------------------------------------------------

MK = f"""WITH {I.MONTHLY}, o AS (SELECT station, value, row_number() OVER (PARTITION BY station ORDER BY date) AS i FROM m),
pair AS (SELECT a.station, sign(b.value - a.value) AS s, (b.value - a.value) / (b.i - a.i) AS slope FROM o a JOIN o b ON a.station = b.station AND a.i < b.i),
st AS (SELECT station, sum(s) AS s, median(slope) AS sen FROM pair GROUP BY 1),
tie AS (SELECT station, sum(t * (t - 1) * (2 * t + 5)) AS t FROM (SELECT station, count(*) AS t FROM o GROUP BY station, value) GROUP BY 1),
n AS (SELECT station, count(*) AS n FROM o GROUP BY 1),
z AS (SELECT station, n, s, (n * (n - 1) * (2 * n + 5) - t) / 18.0::DOUBLE AS var_s, sen FROM st JOIN tie USING (station) JOIN n USING (station)),
w AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(var_s) END AS z, s / (n * (n - 1) / 2.0::DOUBLE) AS tau FROM z)"""
CLASS = "CAST(sign(z) * CASE WHEN abs(z) > 2.58 THEN 2 WHEN abs(z) > 1.96 THEN 1 ELSE 0 END AS INTEGER)"


@query(MK + f" SELECT station, CAST(n AS INTEGER) AS n, CAST(s AS DOUBLE) AS s, round(var_s, 6) AS var_s, round(sen, 6) AS sen, round(z, 6) AS z, round(tau, 6) AS tau, {CLASS} AS class FROM w")
def mann_kendall_sen(spark, sf):
    """Monthly means, gaps filled, trend and class of each station."""
    df = T.fill_month_mean(I.monthly(spark, sf), ["station"])
    return rounded(R.mann_kendall(df, ["station"]), "var_s", "sen", "z", "tau")


@query(MK + f", c AS (SELECT station, {CLASS} AS cls, station % 4 AS zone FROM w) SELECT zone, " + ", ".join(f"round(avg(CASE WHEN cls = {c} THEN 1.0 ELSE 0.0 END), 6) AS share_{'m' if c < 0 else 'p' if c else ''}{abs(c)}" for c in (-2, -1, 0, 1, 2)) + " FROM c GROUP BY ROLLUP (zone)")
def class_shares(spark, sf):
    """Shares of significance classes, by zone and overall."""
    mk = R.mann_kendall(I.monthly(spark, sf), ["station"]).withColumn("zone", F.col("station") % 4)
    out = R.class_shares(mk, "class", "zone")
    return rounded(out, *[c for c in out.columns if c != "zone"])


@query(f"""WITH {I.MONTHLY}, o AS (SELECT station, value, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY station) AS n FROM m),
st AS (SELECT a.station, a.i, a.n, sum(sign(a.value - b.value)) AS s FROM o a JOIN o b ON a.station = b.station WHERE a.i >= 1 GROUP BY ALL),
u AS (SELECT station, i - 1 AS k, n, sum(s) OVER (PARTITION BY station ORDER BY i) AS u FROM st),
best AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY abs(u) DESC, k) AS r FROM u),
p AS (SELECT station, CAST(k AS INTEGER) AS k, CAST(u AS DOUBLE) AS u, 2 * exp(-6 * u * u / (CAST(n AS DOUBLE) * n * n + n * n)) AS p FROM best WHERE r = 1)
SELECT station, k, u, round(p, 6) AS p, CAST(CASE WHEN p < 0.01 THEN 2 WHEN p < 0.05 THEN 1 ELSE 0 END AS INTEGER) AS class FROM p""")
def pettitt_change_point(spark, sf):
    """T4."""
    return rounded(R.pettitt(I.monthly(spark, sf), ["station"]), "p")


@query(f"""WITH {I.MONTHLY}, q AS (SELECT station, value, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS i FROM m),
sn AS (SELECT a.station, median((b.value - a.value) / (b.i - a.i)) AS sen FROM q a JOIN q b ON a.station = b.station AND a.i < b.i GROUP BY 1),
fl AS (SELECT station, i, sen, value - sen * i AS flat FROM q JOIN sn USING (station)), ce AS (SELECT *, flat - avg(flat) OVER (PARTITION BY station) AS c, lag(flat) OVER (PARTITION BY station ORDER BY i) AS prev FROM fl),
rr AS (SELECT station, sum(c * c1) / sum(c * c) AS r FROM (SELECT station, c, lag(c) OVER (PARTITION BY station ORDER BY i) AS c1 FROM ce) GROUP BY 1),
o AS (SELECT station, i - 1 AS i, flat - r * prev + sen * i AS value, count(*) OVER (PARTITION BY station) AS n FROM ce JOIN rr USING (station) WHERE i > 0),
st AS (SELECT a.station, a.i, a.n, sum(sign(a.value - b.value)) AS s FROM o a JOIN o b ON a.station = b.station WHERE a.i >= 1 GROUP BY ALL),
u AS (SELECT station, i - 1 AS k, n, sum(s) OVER (PARTITION BY station ORDER BY i) AS u FROM st),
best AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY abs(u) DESC, k) AS r FROM u),
p AS (SELECT station, CAST(k AS INTEGER) AS k, CAST(u AS DOUBLE) AS u, 2 * exp(-6 * u * u / (CAST(n AS DOUBLE) * n * n + n * n)) AS p FROM best WHERE r = 1)
SELECT station, k, u, round(p, 6) AS p, CAST(CASE WHEN p < 0.01 THEN 2 WHEN p < 0.05 THEN 1 ELSE 0 END AS INTEGER) AS class FROM p""")
def pettitt_prewhitened(spark, sf):
    """T4 after trend-free pre-whitening."""
    return rounded(R.pettitt(I.monthly(spark, sf), ["station"], prewhiten=True), "p")


SEQ = f"""WITH {I.MONTHLY}, o AS (SELECT station, value, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY station) AS n FROM m),
both_ AS (SELECT station, i, n, value, 0 AS rev FROM o UNION ALL SELECT station, n - 1 - i, n, value, 1 FROM o),
r AS (SELECT a.rev, a.station, a.i, a.n, sum(CASE WHEN b.value < a.value THEN 1 ELSE 0 END) AS c FROM both_ a LEFT JOIN both_ b ON a.station = b.station AND a.rev = b.rev AND b.i < a.i GROUP BY ALL),
s AS (SELECT *, sum(c) OVER (PARTITION BY rev, station ORDER BY i) AS s, CAST(i + 1 AS DOUBLE) AS k FROM r),
f AS (SELECT rev, station, i, n, CASE WHEN i = 0 THEN 0 ELSE (s - k * (k + 1) / 4) / sqrt(k * (k - 1) * (2 * k + 5) / 72) END AS f FROM s),
u AS (SELECT a.station, a.i AS place, a.f AS uf, -b.f AS ub FROM f a JOIN f b ON a.station = b.station AND a.rev = 0 AND b.rev = 1 AND b.i = a.n - 1 - a.i)"""


@query(SEQ + " SELECT station, CAST(place AS INTEGER) AS place, round(uf, 6) AS uf, round(ub, 6) AS ub, coalesce((uf - ub) * lag(uf - ub) OVER (PARTITION BY station ORDER BY place) < 0, false) AS crossing FROM u")
def sequential_mann_kendall(spark, sf):
    """T5."""
    return rounded(R.sequential_mk(I.monthly(spark, sf), ["station"]), "uf", "ub")


@query(SEQ.replace("WITH m AS", "WITH m0 AS").replace(", o AS", """, mr AS (SELECT station, date, value, regr_slope(nxt, value) OVER w AS ac, count(nxt) OVER w AS pairs
  FROM (SELECT *, lead(value) OVER (PARTITION BY station ORDER BY date) AS nxt FROM m0) WINDOW w AS (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)),
m AS (SELECT station, date, value, ac FROM mr WHERE pairs = 9), o AS""", 1) + """, q AS (SELECT station, value, ac, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS i FROM m),
c AS (SELECT station, place AS k FROM (SELECT *, (uf - ub) * lag(uf - ub) OVER (PARTITION BY station ORDER BY place) AS turn FROM u) WHERE turn < 0 AND place > 5),
b AS (SELECT c.station, k, median((y.value - x.value) / (y.i - x.i)) AS sen FROM c JOIN q x ON x.station = c.station JOIN q y ON y.station = c.station AND x.i < y.i AND y.i < k GROUP BY ALL),
fa AS (SELECT c.station, k, median((y.value - x.value) / (y.i - x.i)) AS sen FROM c JOIN q x ON x.station = c.station JOIN q y ON y.station = c.station AND x.i < y.i AND x.i > k GROUP BY ALL),
l AS (SELECT b.station, min(q.ac) AS least FROM b JOIN fa ON b.station = fa.station AND b.k = fa.k AND b.sen > fa.sen JOIN q ON q.station = b.station AND q.i = b.k GROUP BY 1)
SELECT station, round(least, 6) AS least_ac FROM (SELECT DISTINCT station FROM q) LEFT JOIN l USING (station)""")
def slowing_points(spark, sf):
    """Least autocorrelation at crossings where the trend falls."""
    ac = R.rolling_autocorrelation(I.monthly(spark, sf), ["station"], 8)
    return rounded(R.slowing_points(ac, ["station"], "ac", 5), "least_ac")


@query(f"""WITH {I.MONTHLY}, o AS (SELECT station, value, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS i FROM m),
a AS (SELECT station, count(*) AS n, regr_slope(value, i) AS b, regr_intercept(value, i) AS c, regr_r2(value, i) AS r2, regr_sxx(value, i) AS sxx, regr_syy(value, i) AS syy, regr_sxy(value, i) AS sxy FROM o GROUP BY 1)
SELECT station, round(b, 6) AS slope, round(c, 6) AS intercept, round(r2, 6) AS r2, round(abs(b) / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS t, CAST(n - 2 AS BIGINT) AS df FROM a""")
def linear_slope(spark, sf):
    """T7."""
    return rounded(R.linear_slope(R.with_place(I.monthly(spark, sf), ["station"]), ["station"]), "slope", "intercept", "r2", "t")


@query(f"""WITH {I.MONTHLY}, o AS (SELECT station, value, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY station) AS n FROM m),
k AS (SELECT station, value, i, n, unnest(generate_series(4, n // 2)) AS k FROM o WHERE n >= 20),
c AS (SELECT *, i // k AS chunk FROM k WHERE (i // k + 1) * k <= n),
d AS (SELECT *, avg(value) OVER (PARTITION BY station, k, chunk) AS mean FROM c),
q AS (SELECT *, sum(value - mean) OVER (PARTITION BY station, k, chunk ORDER BY i) AS cum FROM d),
r AS (SELECT station, k, chunk, (max(cum) - min(cum) + 2.220446049250313e-16) / (stddev_pop(value) + 2.220446049250313e-16) AS rs FROM q GROUP BY ALL),
a AS (SELECT station, k, avg(rs) AS rs FROM r GROUP BY ALL) SELECT station, round(regr_slope(ln(rs), ln(k)), 6) AS hurst FROM a GROUP BY 1""")
def hurst_exponent(spark, sf):
    """T8."""
    return rounded(R.hurst(I.monthly(spark, sf), ["station"]), "hurst")


@query(f"""WITH {I.PAIRS}, a AS (SELECT model, corr(obs, sim) AS r, count(*) AS n FROM p GROUP BY 1)
SELECT model, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t, n - 2 AS df FROM a""")
def pearson(spark, sf):
    """T11, E10."""
    return rounded(rounded(R.pearson(I.pairs(spark, sf), ["model"], "obs", "sim"), "r"), "t", places=4)


@query(f"""WITH {I.PAIRS}, c AS (SELECT model, corr(obs, sim) AS xy, corr(obs, tax) AS xc, corr(sim, tax) AS yc FROM p GROUP BY 1)
SELECT model, round((xy - xc * yc) / sqrt((1 - xc * xc) * (1 - yc * yc)), 6) AS r FROM c""")
def partial_correlation(spark, sf):
    """T12."""
    return rounded(K.partial_correlation(I.pairs(spark, sf), ["model"], "obs", "sim", "tax"), "r")


LAG = f"WITH {I.MONTHLY}, o AS (SELECT *, lead(value) OVER (PARTITION BY station ORDER BY date) AS nxt FROM m)"


@query(LAG + " SELECT station, round(regr_slope(nxt, value), 6) AS slope, round(regr_intercept(nxt, value), 4) AS intercept FROM o GROUP BY 1")
def lag_one_fit(spark, sf):
    """T13."""
    return rounded(rounded(R.lag_one_fit(I.monthly(spark, sf), ["station"]), "slope"), "intercept", places=4)


ROLL = LAG + ", w AS (SELECT station, date, value, regr_slope(nxt, value) OVER x AS ac, regr_intercept(nxt, value) OVER x AS intercept, count(nxt) OVER x AS n FROM o WINDOW x AS (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING))"


@query(ROLL + " SELECT station, date, value, round(ac, 6) AS ac, round(intercept, 3) AS intercept FROM w WHERE n = 25")
def rolling_autocorrelation(spark, sf):
    """T14."""
    return rounded(rounded(R.rolling_autocorrelation(I.monthly(spark, sf), ["station"], 24), "ac"), "intercept", places=3)


@query(ROLL + ", k AS (SELECT * FROM w WHERE n = 25) SELECT station, date, round(var_pop(value) OVER (PARTITION BY station) / nullif(1 - ac * ac, 0), 2) AS var_y FROM k")
def residual_variance(spark, sf):
    """T15."""
    ac = R.rolling_autocorrelation(I.monthly(spark, sf), ["station"], 24)
    return rounded(R.residual_variance(ac, ["station"]).select("station", "date", "var_y"), "var_y", places=2)


@query(LAG + ", w AS (SELECT station, date, corr(nxt, value) OVER x AS r, stddev_pop(value) OVER x AS sd, count(*) OVER x AS n FROM o WINDOW x AS (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) SELECT station, date, round(coalesce(r, 0), 6) AS r, round(sd, 4) AS sd FROM w WHERE n = 12")
def empirical_indicators(spark, sf):
    """T16, T17."""
    m = I.monthly(spark, sf)
    a, s = R.empirical_ac(m, ["station"], 12), R.empirical_std(m, ["station"], 12)
    return rounded(rounded(a.join(s.select("station", "date", "sd"), ["station", "date"]).select("station", "date", "r", "sd"), "r"), "sd", places=4)


@query()
def conditional_drift(spark, sf):
    """T18."""
    return rounded(DY.drift(I.monthly(spark, sf), ["station"], 48), "drift")


@query()
def low_index_steps(spark, sf):
    """T19."""
    steps = I.monthly(spark, sf).withColumn("date", F.date_add(F.lit("1995-01-01").cast("date"), F.months_between("date", F.lit("1995-01-01").cast("date")).cast("int") * 16))
    return DY.low_steps(steps, ["station"], 0.8)


@query(f"""WITH {I.MONTHLY}, o AS (SELECT station, value, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS place FROM m), l AS (SELECT *, value * 0.98 AS upper FROM o WHERE place >= 12),
b AS (SELECT *, median(upper) OVER (PARTITION BY station) AS bound FROM l), h AS (SELECT *, sum(CASE WHEN value > bound THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY place RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS hits FROM b)
SELECT station, CAST(place AS INTEGER) AS place FROM h WHERE value > bound AND hits >= 4""")
def early_warning_runs(spark, sf):
    """T20."""
    rows = R.with_place(I.monthly(spark, sf), ["station"]).withColumn("upper", F.col("value") * 0.98)
    return R.warning_runs(rows, ["station"], "value", "upper", warm_up=12, trailing=5, hits=4).select("station", "place")


@query(MK + f""", q AS (SELECT station, value, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS i FROM m), qs AS (SELECT x.station, x.i, sum(sign(x.value - y.value)) AS s FROM q x JOIN q y ON x.station = y.station WHERE x.i >= 1 GROUP BY ALL),
qu AS (SELECT station, i - 1 AS k, sum(s) OVER (PARTITION BY station ORDER BY i) AS u FROM qs), qk AS (SELECT station, arg_min(k, (-abs(u), k)) AS k FROM qu GROUP BY 1),
qh AS (SELECT station, any_value(k) AS k, regr_slope(CASE WHEN i < k THEN value END, CASE WHEN i < k THEN i END) AS before, regr_slope(CASE WHEN i > k THEN value END, CASE WHEN i > k THEN i END) AS after FROM q JOIN qk USING (station) GROUP BY 1)
SELECT station, printf('%.3f', z) AS mk, printf('%.4f', sen) AS slope, CAST(k + 1995 AS INTEGER) AS change, coalesce(printf('%.4f', before), 'null') AS before, coalesce(printf('%.4f', after), 'null') AS after FROM w JOIN qh USING (station)""")
def statistics_report(spark, sf):
    """T21, F18."""
    return R.report(I.monthly(spark, sf), ["station"], first_year=1995)


@query(f"""WITH {I.MONTHLY}, r AS (SELECT station, date, rank() OVER (PARTITION BY station ORDER BY value) + (count(*) OVER (PARTITION BY station, value) - 1) / 2.0::DOUBLE AS rk FROM m)
SELECT a.station AS a, b.station AS b, round(corr(a.rk, b.rk), 6) AS rho FROM r a JOIN r b ON a.date = b.date AND a.station < b.station GROUP BY ALL""")
def spearman_matrix(spark, sf):
    """T22."""
    return rounded(R.spearman_pairs(I.monthly(spark, sf), [], "station"), "rho")


@query()
def chain_diagnostics(spark, sf):
    """T23."""
    return rounded(DY.chain_times(R.with_place(I.monthly(spark, sf), ["station"]), ["station"]), "integrated", "exponential", "sign_tau")


@query(f"""WITH {I.DAILY}, x AS (SELECT station, var, date, value, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY var, dayofyear(date) ORDER BY station))
SELECT station, var, date, round(coalesce(value - (regr_intercept(value, k) OVER w + regr_slope(value, k) OVER w * k), value - avg(value) OVER w), 5) AS residual FROM x WINDOW w AS (PARTITION BY var, dayofyear(date))""")
def day_of_year_detrend(spark, sf):
    """C17: users stand for the years of one series."""
    d = I.daily(spark, sf)
    day = W.partitionBy("var", C.doy365(F.col("date")))
    rows = d.withColumn("k", F.row_number().over(day.orderBy("station")))
    fit = F.regr_intercept("value", "k").over(day) + F.regr_slope("value", "k").over(day) * F.col("k")
    return rounded(rows.withColumn("residual", F.coalesce(F.col("value") - fit, F.col("value") - F.avg("value").over(day))).select("station", "var", "date", "residual"), "residual", places=5)


# Time. -------------------------------------------------------------------------------------------------------------

@query(f"WITH {I.MONTHLY} SELECT * FROM m WHERE date BETWEEN DATE '1996-02-01' AND DATE '1999-12-31'")
def select_period(spark, sf):
    """F1."""
    return T.select_time(I.monthly(spark, sf), "1996-02-01", "1999-12-31", leap=True)


HOLES = f"WITH {I.MONTHLY}, h AS (SELECT station, date, CASE WHEN (station + month(date) + year(date)) % 7 = 0 THEN NULL ELSE value END AS value FROM m)"


def _holes(spark, sf):
    hole = (F.col("station") + F.month("date") + F.year("date")) % 7 == 0
    return I.monthly(spark, sf).withColumn("value", F.when(~hole, F.col("value")))


@query(HOLES + " SELECT station, date, round(coalesce(value, avg(value) OVER (PARTITION BY station, month(date))) + 0.0000123, 4) AS value FROM h")
def fill_month_mean(spark, sf):
    """F2, F3."""
    return rounded(T.fill_month_mean(_holes(spark, sf), ["station"]), "value", places=4, nudge=NUDGE)


@query(HOLES + ", s AS (SELECT station FROM h GROUP BY 1 HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.14) SELECT h.* FROM h SEMI JOIN s USING (station)")
def drop_sparse(spark, sf):
    """F4."""
    return T.drop_sparse(_holes(spark, sf), ["station"], threshold=0.14)


@query(f"WITH {I.MONTHLY}, b AS (SELECT *, min(CASE WHEN month(date) = 1 THEN date END) OVER w AS lo, max(CASE WHEN month(date) = 12 THEN date END) OVER w AS hi FROM m WINDOW w AS (PARTITION BY station)) SELECT station, date, value FROM b WHERE date BETWEEN lo AND hi")
def whole_years(spark, sf):
    """F5."""
    return T.whole_years(I.monthly(spark, sf), ["station"])


@query(f"WITH {I.MONTHLY}, a AS (SELECT * FROM m WHERE station % 2 = 0), b AS (SELECT * FROM m WHERE value > 150000) SELECT a.* FROM a SEMI JOIN b ON a.date = b.date AND a.station = b.station")
def common_times(spark, sf):
    """F6, J1, J11."""
    m = I.monthly(spark, sf)
    return T.common_times(m.where("station % 2 = 0"), m.where("value > 150000"), ["station", "date"])[0]


@query(f"""WITH {I.DAILY}, x AS (SELECT *, CASE WHEN day(date) <= 10 THEN 'historical' WHEN day(date) <= 20 THEN 'low' ELSE 'high' END AS scenario FROM d),
n AS (SELECT station, count(DISTINCT scenario) AS n FROM x GROUP BY 1), k AS (SELECT station, var, count(DISTINCT scenario) AS k FROM x WHERE value IS NOT NULL GROUP BY ALL)
SELECT x.station, x.var, x.date, x.scenario, x.value FROM x JOIN n USING (station) JOIN k ON x.station = k.station AND x.var = k.var WHERE n = k""")
def match_predictors(spark, sf):
    """F7."""
    day = F.dayofmonth("date")
    d = I.daily(spark, sf).withColumn("scenario", F.when(day <= 10, "historical").when(day <= 20, "low").otherwise("high"))
    return T.in_every(d, ["station"], "var", "scenario").select("station", "var", "date", "scenario", "value")


@query("SELECT event_id, CASE WHEN value <> 100.0 AND abs(value) <= 300 THEN value END AS value FROM events")
def clean_ranges(spark, sf):
    """F8, S4."""
    e = I.table(spark, sf, "events")
    return e.select("event_id", C.clean(F.col("value"), 100.0, limit=300.0).alias("value"))


@query(f"WITH {I.MONTHLY} SELECT station, date, round((max(value) OVER w - value) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled FROM m WINDOW w AS (PARTITION BY station)")
def min_max_reversed(spark, sf):
    """F10, F11."""
    return rounded(T.min_max(I.monthly(spark, sf), ["station"], reverse=True).select("station", "date", "scaled"), "scaled")


@query(f"WITH {I.PAIRS}, b AS (SELECT *, min(least(obs, sim)) OVER w AS lo, max(greatest(obs, sim)) OVER w AS hi FROM p WINDOW w AS (PARTITION BY model)) SELECT model, round(sum((obs - lo) / nullif(hi - lo, 0)), 4) AS obs, round(sum((sim - lo) / nullif(hi - lo, 0)), 4) AS sim FROM b GROUP BY 1")
def joint_min_max(spark, sf):
    """F12."""
    p = T.joint_min_max(I.pairs(spark, sf), ["model"], ["obs", "sim"], I.cut)
    return p.groupBy("model").agg(F.round(F.sum("obs"), 4).alias("obs"), F.round(F.sum("sim"), 4).alias("sim"))


@query(f"WITH {I.MONTHLY}, s AS (SELECT station, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1) SELECT station, date, round((value - lo) / nullif(hi - lo, 0), 6) AS scaled FROM m JOIN s USING (station) WHERE year(date) < 1998")
def saved_scaler(spark, sf):
    """Fitted on history and scenario, applied to history."""
    m = I.monthly(spark, sf)
    old, new = m.where(F.year("date") < 1998), m.where(F.year("date") >= 1998).withColumn("extra", F.lit(1))
    return rounded(T.apply_scaler(old, T.fit_scaler([old, new], ["station"]), ["station"]).select("station", "date", "scaled"), "scaled")


@query(f"WITH {I.MONTHLY}, y AS (SELECT *, dense_rank() OVER (PARTITION BY station ORDER BY year(date)) - 1 AS i FROM m) SELECT station, date, i % 5 < 3.5 AS is_train FROM y")
def split_by_year(spark, sf):
    """F15."""
    return T.split_years(I.monthly(spark, sf), ["station"], train=0.7, group=5).select("station", "date", "is_train")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS value FROM customer")
def clamp_negative(spark, sf):
    """F16."""
    return I.table(spark, sf, "customer").select("c_custkey", C.non_negative(F.col("c_acctbal")).alias("value"))


@query(HOLES + ", u AS (SELECT *, sum(CASE WHEN value <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY station) AS u, avg(value) OVER (PARTITION BY station) AS mean FROM h) SELECT station, date, round(coalesce(value, mean) + 0.0000123, 4) AS value FROM u WHERE u > 0")
def guard_series(spark, sf):
    """F17."""
    return rounded(T.guard_series(_holes(spark, sf), ["station"]), "value", places=4, nudge=NUDGE)


@query(f"WITH {I.MONTHLY}, o AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS place FROM m) SELECT station, CAST(place AS INTEGER) AS place, CASE WHEN place < 40 THEN 'before' WHEN place > 40 THEN 'after' ELSE 'point' END AS part FROM o")
def split_at_point(spark, sf):
    """F18."""
    return R.split_at(R.with_place(I.monthly(spark, sf), ["station"]).withColumn("k", F.lit(40)), ["station"], "place", "k").select("station", "place", "part")


@query(f"WITH {I.DAILY} SELECT station, var, CAST(date_trunc('month', date) AS DATE) AS date, round(CASE WHEN var IN ('click', 'view') THEN sum(value) ELSE avg(value) END + 0.0000123, 4) AS value FROM d GROUP BY station, var, CAST(date_trunc('month', date) AS DATE)")
def monthly_by_rule(spark, sf):
    """A1, A2, S3."""
    return rounded(T.by_rule(I.daily(spark, sf), ["station"], summed=("click", "view")), "value", places=4, nudge=NUDGE)


SEASON = "CASE WHEN month BETWEEN 3 AND 5 THEN 'Spring' WHEN month BETWEEN 6 AND 8 THEN 'Summer' WHEN month BETWEEN 9 AND 11 THEN 'Autumn' ELSE 'Winter' END"


@query(f"WITH {I.MONTHLY}, c AS (SELECT station, month(date) AS month, avg(value) AS value FROM m GROUP BY ALL) SELECT station, {SEASON} AS season, CAST(CASE WHEN month IN (12, 1, 2) THEN 3 ELSE floor(month / 3) - 1 END AS INTEGER) AS season_order, round(avg(value) + 0.0000123, 4) AS value FROM c GROUP BY ALL")
def season_climatology(spark, sf):
    """A3, A4."""
    return rounded(T.seasons(I.monthly(spark, sf), ["station"]), "value", places=4, nudge=NUDGE)


@query(f"WITH {I.MONTHLY}, x AS (SELECT station, year(date) AS year, month(date) AS month, value FROM m) SELECT station, CAST(year AS INTEGER) AS year, {SEASON} AS season, round(avg(value) * 3 + 0.0000123, 4) AS value FROM x GROUP BY ALL")
def season_means(spark, sf):
    """A6."""
    return rounded(T.season_means(I.monthly(spark, sf), ["station"], total=True), "value", places=4, nudge=NUDGE)


@query(f"WITH {I.MONTHLY} SELECT station, CAST(year(date) AS INTEGER) AS year, round(coalesce(sum(value), 0) + 0.0000123, 4) AS value FROM m GROUP BY ALL")
def yearly_sums(spark, sf):
    """A5, A7, A9."""
    return rounded(T.yearly(I.monthly(spark, sf), ["station"], how=F.sum, empty=0.0), "value", places=4, nudge=NUDGE)


@query(f"WITH {I.MONTHLY}, y AS (SELECT station, year(date) AS year, month(date) AS unit, sum(value) AS v FROM m GROUP BY ALL) SELECT station, CAST(unit AS INTEGER) AS unit, round(avg(v) + 0.0000123, 4) AS value FROM y GROUP BY station, unit")
def multi_year_mean(spark, sf):
    """A8."""
    return rounded(T.multi_year_mean(I.monthly(spark, sf), ["station"], mode="month"), "value", places=4, nudge=NUDGE)


@query(f"WITH {I.MONTHLY}, w AS (SELECT station, date, value, avg(value) OVER x AS moving, count(*) OVER x AS n FROM m WINDOW x AS (PARTITION BY station ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT station, date, value, round(moving + 0.0000123, 4) AS moving FROM w WHERE n = 12")
def moving_average(spark, sf):
    """A10."""
    return rounded(T.moving_average(I.monthly(spark, sf), ["station"], 12), "moving", places=4, nudge=NUDGE)


@query(f"""WITH {I.DAILY}, t AS (SELECT station, var, date_trunc('month', date) AS month, 1000.0 + station AS target FROM d GROUP BY ALL), a AS (SELECT *, sum(value) OVER (PARTITION BY station, var, date_trunc('month', date)) AS agg FROM d)
SELECT a.station, a.var, a.date, round(value * coalesce(target / nullif(agg, 0), 0), 4) AS corrected FROM a JOIN t ON a.station = t.station AND a.var = t.var AND date_trunc('month', a.date) = t.month""")
def monthly_correction(spark, sf):
    """A11."""
    d = I.daily(spark, sf)
    target = d.select("station", "var", F.trunc("date", "MM").alias("date")).distinct().withColumn("value", F.lit(1000.0) + F.col("station"))
    return rounded(T.correct_monthly(d, target, ["station", "var"]).select("station", "var", "date", "corrected"), "corrected", places=4)


@query("""WITH s AS (SELECT station, DATE '2001-01-01' + CAST(16 * k AS INTEGER) AS date, station * 10.0 + k AS value FROM (SELECT s_suppkey AS station FROM supplier), (SELECT unnest(range(0, 23)) AS k)),
b AS (SELECT station, date, value, unnest(range(0, 16)) AS back FROM s), c AS (SELECT station, date, value, (dayofyear(date) - 1 - back + 365) % 365 + 1 AS doy FROM b)
SELECT station, date, round(max(value) - avg(doy * 0.5 + station), 6) AS anomaly FROM c GROUP BY ALL""")
def climatology_anomaly(spark, sf):
    """A12."""
    s = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station"))
    steps = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(22)))).select("station", F.date_add(F.lit("2001-01-01").cast("date"), F.col("k") * 16).alias("date"), (F.col("station") * 10.0 + F.col("k")).alias("value"))
    normal = s.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(365)))).withColumn("value", F.col("doy") * 0.5 + F.col("station"))
    return rounded(T.climatology_anomaly(steps, normal, ["station"]), "anomaly")


@query("SELECT o_orderkey, CAST(day(last_day(o_orderdate)) AS INTEGER) AS days, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap, CAST(o_orderdate AS DATE) AS again FROM orders")
def calendar_helpers(spark, sf):
    """A13, P14."""
    d = F.to_date("o_orderdate")
    return I.table(spark, sf, "orders").select("o_orderkey", C.days_in_month(d).alias("days"), C.is_leap(F.year(d)).alias("leap"), C.day_to_date(F.year(d), F.dayofyear(d)).alias("again"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 12 = 0 THEN 1 ELSE factorial(CAST(p_size % 12 AS INTEGER)) / (factorial(2) * factorial(CAST(p_size % 12 - 2 AS INTEGER))) END AS BIGINT) AS ways FROM part WHERE p_size % 12 >= 2")
def combinations(spark, sf):
    """P14."""
    n = F.col("p_size") % 12
    return I.table(spark, sf, "part").where(n >= 2).select("p_partkey", C.combinations(n, F.lit(2)).alias("ways"))


# Skill. ------------------------------------------------------------------------------------------------------------

@query(f"""WITH {I.PAIRS} SELECT model, round(stddev_pop(sim) / avg(sim), 6) AS cov, round(1 - sum((obs - sim) ** 2) / (var_pop(obs) * count(*)), 6) AS nse, round(100 * sum(sim - obs) / sum(obs), 6) AS pbias, round(avg(sim), 4) AS mean, round(var_pop(sim), 2) AS variance,
round(stddev_pop(sim), 4) AS std, round(stddev_pop(sim) / stddev_pop(obs), 6) AS std_ratio, round(sqrt(avg(sim * sim)), 4) AS rms, round(avg((obs - sim) ** 2), 2) AS mse, round(sqrt(avg((obs - sim) ** 2)), 4) AS rmse, round(avg(abs(obs - sim)), 4) AS mae, round(sqrt(avg((obs - sim) ** 2)) / stddev_pop(obs), 6) AS rsr, round(corr(obs, sim), 6) AS cc FROM p GROUP BY 1""")
def skill_metrics(spark, sf):
    """E1 to E8, E10."""
    out = rounded(K.metrics(I.pairs(spark, sf), ["model"]), "cov", "nse", "pbias", "std_ratio", "rsr", "cc")
    return rounded(rounded(out, "mean", "std", "rms", "rmse", "mae", places=4), "variance", "mse", places=2)


@query(f"""WITH {I.PAIRS}, z AS (SELECT model, (obs - 38000) / 15000 AS o, (sim - 38000) / 15000 AS s FROM p),
c AS (SELECT model, sum(CASE WHEN o <= -2 AND s <= -2 THEN 1.0 ELSE 0 END) AS hd, sum(CASE WHEN o <= -2 AND NOT s <= -2 THEN 1.0 ELSE 0 END) AS md, sum(CASE WHEN NOT o <= -2 AND s <= -2 THEN 1.0 ELSE 0 END) AS fd,
sum(CASE WHEN o >= 2 AND s >= 2 THEN 1.0 ELSE 0 END) AS hw, sum(CASE WHEN o >= 2 AND NOT s >= 2 THEN 1.0 ELSE 0 END) AS mw, sum(CASE WHEN NOT o >= 2 AND s >= 2 THEN 1.0 ELSE 0 END) AS fw FROM z GROUP BY 1)
SELECT model, round(CAST(hd / nullif(hd + md, 0) AS DOUBLE), 6) AS pod_dry, round(CAST(fd / nullif(hd + fd, 0) AS DOUBLE), 6) AS far_dry, round(CAST(hw / nullif(hw + mw, 0) AS DOUBLE), 6) AS pod_wet, round(CAST(fw / nullif(hw + fw, 0) AS DOUBLE), 6) AS far_wet FROM c""")
def recognition_scores(spark, sf):
    """E9."""
    z = lambda c: ((F.col(c) - 38000) / 15000).alias(c)
    return rounded(K.recognition(I.pairs(spark, sf).select("model", z("obs"), z("sim")), ["model"]), "pod_dry", "far_dry", "pod_wet", "far_wet")


@query(f"""WITH {I.PAIRS}, l AS (SELECT obs, 'sim' AS model, sim AS s FROM p UNION ALL SELECT obs, 'tax', tax FROM p),
a AS (SELECT model, stddev_pop(s) / avg(s) AS "CoV", corr(obs, s) AS "CC", 1 - sum((obs - s) ** 2) / (var_pop(obs) * count(*)) AS "NSE", 100 * sum(s - obs) / sum(obs) AS "PBIAS" FROM l GROUP BY 1),
u AS (SELECT model, unnest(['CoV', 'CC', 'NSE', 'PBIAS']) AS metric, unnest(["CoV", "CC", "NSE", "PBIAS"]) AS v FROM a)
SELECT metric, round(max(CASE WHEN model = 'sim' THEN v END), 6) AS sim, round(max(CASE WHEN model = 'tax' THEN v END), 6) AS tax FROM u GROUP BY 1""")
def metric_report(spark, sf):
    """K6."""
    return rounded(K.report(I.pairs(spark, sf).select("obs", "sim", "tax"), "obs", ["sim", "tax"]), "sim", "tax")


# Joins and assembly. -----------------------------------------------------------------------------------------------

@query(f"WITH {I.DAILY}, a AS (SELECT * FROM d WHERE var = 'click'), b AS (SELECT * FROM d WHERE var = 'view') SELECT coalesce(a.station, b.station) AS station, coalesce(a.date, b.date) AS date, a.value AS click, b.value AS view FROM a FULL JOIN b ON a.station = b.station AND a.date = b.date")
def outer_columns(spark, sf):
    """J2, J3."""
    d = I.daily(spark, sf)
    side = lambda v: d.where(F.col("var") == v).select("station", "date", F.col("value").alias(v))
    return side("click").join(side("view"), ["station", "date"], "full")


@query(f"WITH {I.MONTHLY} SELECT *, 'historical' AS scenario FROM m WHERE year(date) < 1998 UNION ALL SELECT *, 'future' FROM m WHERE year(date) >= 1998")
def append_scenarios(spark, sf):
    """J4, J10."""
    m = I.monthly(spark, sf)
    return m.where(F.year("date") < 1998).withColumn("scenario", F.lit("historical")).unionByName(m.where(F.year("date") >= 1998).withColumn("scenario", F.lit("future")))


@query(f"WITH {I.ENSEMBLE}, w AS (SELECT station, date, max(CASE WHEN gcm = 'A' THEN value END) AS \"A\", max(CASE WHEN gcm = 'N' THEN value END) AS \"N\", max(CASE WHEN gcm = 'R' THEN value END) AS \"R\" FROM e GROUP BY ALL) SELECT * FROM w WHERE \"A\" IS NOT NULL AND \"N\" IS NOT NULL AND \"R\" IS NOT NULL")
def assemble_ensemble(spark, sf):
    """J6, S5."""
    return E.assemble(I.ensemble(spark, sf), ["station"], ["A", "N", "R"])


@query(f"""WITH {I.GRID}, {I.STATIONS}, d AS (SELECT station, y, x, sqrt((lat - y) ** 2 + (lon - x) ** 2) AS distance FROM s, g WHERE cls <> 1), r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY distance, y, x) AS k FROM d)
SELECT station, y, x, round(distance, 6) AS distance FROM r WHERE k = 1""")
def nearest_cell(spark, sf):
    """Cells of class 1 have no data."""
    g = I.grid(spark, sf).withColumns({"lat": F.col("y").cast("double"), "lon": F.col("x").cast("double")})
    return rounded(SP.nearest_cell(I.stations(spark, sf), g, usable=F.col("cls") != 1), "distance")


@query(f"WITH {I.GRID} SELECT cls, round(avg(a.value + b.value), 4) AS mean, count(*) AS n FROM g a JOIN (SELECT y, x, value * 2 AS value FROM g WHERE x > 3) b USING (y, x) GROUP BY 1")
def overlay_zones(spark, sf):
    """J8, J9."""
    g = I.grid(spark, sf)
    both = SP.overlay([g.select("y", "x", "value"), g.where("x > 3").select("y", "x", (F.col("value") * 2).alias("other"))])
    return SP.zonal(both, g.select("y", "x", "cls"), "cls", [F.round(F.avg(F.col("value") + F.col("other")), 4).alias("mean"), F.count("*").alias("n")])


@query(f"WITH {I.GRID} SELECT y, x, CASE WHEN cls IN (1, 2, 3) AND value <> 0 THEN value END AS value FROM g")
def class_mask(spark, sf):
    """S10, S11."""
    g = I.grid(spark, sf)
    return SP.mask(g.select("y", "x", "value"), g, "cls", [1, 2, 3])


MASKED = f"""{I.CUBE}, {I.LAND_USE}, ms AS (SELECT y, x, time, CASE WHEN cls IN (0, 1, 2) AND value <> 0 THEN value END AS value FROM cb LEFT JOIN lu USING (y, x)),
cp AS (SELECT y, x, CAST(date_trunc('year', time) AS DATE) + CAST((dayofyear(time) - 1) // 16 * 16 AS INTEGER) AS time, avg(value) AS value FROM ms GROUP BY ALL)"""


@query(f"WITH {MASKED} SELECT y, x, time, round(value + {NUDGE}, 4) AS value FROM cp")
def composites(spark, sf):
    """A cube of the wanted classes in composites of 16 days, in two lots of dates; the second changes its own buckets only."""
    cube = SP.mask(I.cube(spark, sf), I.land_use(spark, sf), "cls", [0, 1, 2])
    path = I.scratch(spark, "composites")
    for k, dates in enumerate((F.col("time") < "1998-07-01", F.col("time") >= "1998-07-01")):
        table = CO.update(spark, path, cube.where(dates), ["y", "x"], 16, f"{path}-work{k}")
    return rounded(CO.means(table, ["y", "x"]), "value", places=4, nudge=NUDGE)


@query(f"""WITH {I.CUBE}, d AS (SELECT time, (row_number() OVER (ORDER BY time) - 1) // 30 AS k FROM (SELECT DISTINCT time FROM cb)), f AS (SELECT time, min(time) OVER (PARTITION BY k) AS first FROM d)
SELECT y, x, first AS time, round(avg(value) + {NUDGE}, 4) AS value FROM cb JOIN f USING (time) GROUP BY ALL""")
def consecutive_composites(spark, sf):
    """Means of every 30 rasters."""
    return rounded(CO.consecutive(I.cube(spark, sf), ["y", "x"], 30), "value", places=4, nudge=NUDGE)


@query(f"""WITH {MASKED}, gd AS (SELECT y, x, time, coalesce(value, avg(value) OVER (PARTITION BY y, x)) AS value FROM (SELECT *, count(value) OVER (PARTITION BY y, x) AS used FROM cp) WHERE used > 0),
dy AS (SELECT *, dayofyear(time) - CASE WHEN month(time) > 2 AND dayofyear(make_date(year(time), 12, 31)) = 366 THEN 1 ELSE 0 END AS doy FROM gd),
dk AS (SELECT *, row_number() OVER (PARTITION BY y, x, doy ORDER BY time) AS k FROM dy),
fl AS (SELECT y, x, time, coalesce(value - (regr_intercept(value, k) OVER p + regr_slope(value, k) OVER p * k), value - avg(value) OVER p) AS value FROM dk WINDOW p AS (PARTITION BY y, x, doy)),
nx AS (SELECT *, lead(value) OVER (PARTITION BY y, x ORDER BY time) AS nxt FROM fl),
ra AS (SELECT y, x, time, regr_slope(nxt, value) OVER w AS ac, count(nxt) OVER w AS pairs FROM nx WINDOW w AS (PARTITION BY y, x ORDER BY time ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)),
m AS (SELECT y * 10 + x AS station, time AS date, ac AS value FROM ra WHERE pairs = 25), """ + MK[MK.index("o AS (SELECT") :] + f" SELECT CAST(station // 10 AS INTEGER) AS y, CAST(station % 10 AS INTEGER) AS x, CAST(n AS INTEGER) AS n, CAST(s AS DOUBLE) AS s, round(var_s, 6) AS var_s, round(sen, 6) AS sen, round(z, 6) AS z, round(tau, 6) AS tau, {CLASS} AS class FROM w")
def pixel_resilience(spark, sf):
    """The pixel chain on composites: residuals by day of the year, rolling lag-1 coefficients, their trend."""
    cube = SP.mask(I.cube(spark, sf), I.land_use(spark, sf), "cls", [0, 1, 2])
    stack = CO.means(CO.sums(cube, ["y", "x"], 16), ["y", "x"])
    return rounded(pipelines.pixel_resilience(stack, 24), "var_s", "sen", "z", "tau")


@query("SELECT CAST(i AS INTEGER) AS lat_index, round(10 + i * 0.5, 6) AS lat FROM range(21) t(i)")
def grid_coordinates(spark, sf):
    """S12."""
    return rounded(SP.linspace(21, 10.0, 20.0, "lat", spark), "lat")


# Grids. ------------------------------------------------------------------------------------------------------------

BANDS = f"{I.GRID}, b AS (SELECT y, x, (value % 97) / 100 AS ac, value % 700 AS npp, CASE WHEN cls % 8 = 7 THEN 10 ELSE cls % 8 END AS use, value % 900 AS p, value % 600 AS et, value % 1100 AS fp, value % 83 AS ad FROM g)"


def _bands(spark, sf):
    v, c = F.col("value"), F.col("cls")
    return I.grid(spark, sf).select("y", "x", (v % 97 / 100).alias("ac"), (v % 700).alias("npp"), F.when(c % 8 == 7, 10).otherwise(c % 8).alias("use"), (v % 900).alias("p"), (v % 600).alias("et"), (v % 1100).alias("fp"), (v % 83).alias("ad"))


@query(f"""WITH {BANDS}, r AS (SELECT *, fp - ad AS net, p - et AS past, CASE WHEN use <= 5 THEN 0.0002 * fp + 0.78 WHEN use = 6 THEN -1.23 + 2.59 * (1 - exp(-0.008 * (fp - ad))) ELSE 0.93 + 1.38 * exp(-0.005 * (fp - ad)) END AS rate FROM b),
q AS (SELECT *, fp - npp * rate AS bal, ac > CASE WHEN use <= 5 THEN 0.05 WHEN use = 6 THEN 0.16 ELSE 0.6 END AS slow, CASE WHEN use <= 5 THEN 400 WHEN use = 6 THEN 315 ELSE 175 END AS cut FROM r)
SELECT y, x, CAST(CASE WHEN use NOT IN (1, 2, 3, 4, 5, 6, 10) THEN NULL WHEN net < 175 THEN 1 WHEN bal + ad < 0 AND net < cut AND bal < past AND slow THEN 1 WHEN slow AND CASE WHEN use <= 5 THEN bal > past ELSE bal < past END THEN 2 ELSE 3 END AS INTEGER) AS class FROM q""")
def carrying_capacity(spark, sf):
    """P1."""
    b = _bands(spark, sf)
    return b.select("y", "x", L.capacity_class(*[F.col(c) for c in ("ac", "npp", "use", "p", "et", "fp", "ad")]).alias("class"))


@query(f"""WITH {BANDS}, r AS (SELECT *, fp - npp * CASE WHEN use <= 5 THEN 0.0004 * fp + 0.75 WHEN use = 6 THEN -0.10 + 1.51 * (1 - exp(-0.006 * fp)) ELSE 0.95 + 1.41 * exp(-0.005 * fp) END AS bal FROM b),
q AS (SELECT *, CASE WHEN use <= 5 THEN 0.1880 + 1.4952e-4 * bal + 6.1648e-6 * bal * bal WHEN use = 6 THEN 0.3874 - 0.0003 * bal ELSE 0.0003 + 5.7250e-7 * bal - 1.9083e-8 * bal * bal END AS want FROM r)
SELECT y, x, CAST(CASE WHEN use NOT IN (1, 2, 3, 4, 5, 6, 10) THEN NULL WHEN fp < 175 THEN 1 WHEN CASE WHEN use <= 5 THEN fp < 400 WHEN use = 6 THEN fp < 315 OR fp >= 400 ELSE fp >= 315 END THEN 1 WHEN ac > CASE WHEN use <= 5 THEN 0.3 WHEN use = 6 THEN 0.4 ELSE 0.5 END AND want > ac THEN 2 ELSE 3 END AS INTEGER) AS class FROM q""")
def carrying_capacity_response(spark, sf):
    """P2."""
    b = _bands(spark, sf)
    return b.select("y", "x", L.capacity_class_by_response(*[F.col(c) for c in ("ac", "npp", "use", "fp")]).alias("class"))


@query(f"""WITH {BANDS}, q AS (SELECT *, fp - ad AS net, p >= fp AND ac > CASE WHEN use <= 5 THEN 0.429 WHEN use = 6 THEN 0.489 ELSE 0.437 END AS risk FROM b), d AS (SELECT *, net < CASE WHEN use <= 5 THEN 400 WHEN use = 6 THEN 315 ELSE 175 END AS dry FROM q)
SELECT y, x, CAST(CASE WHEN use NOT IN (1, 2, 3, 4, 5, 6, 10) THEN NULL WHEN net < 175 THEN 1 WHEN dry AND risk THEN 1 WHEN dry THEN 2 WHEN risk THEN 3 ELSE 4 END AS INTEGER) AS class FROM d""")
def carrying_capacity_rain(spark, sf):
    """P3."""
    b = _bands(spark, sf)
    return b.select("y", "x", L.capacity_class_by_rain(*[F.col(c) for c in ("ac", "use", "p", "et", "fp", "ad")]).alias("class"))


@query(f"WITH {I.GRID}, t AS (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x FROM range(37) p(a), range(61) q(b)) SELECT t.y, t.x, value FROM t JOIN g ON g.y = least(CAST(floor((t.y + 0.5) * 50 / 37) AS INTEGER), 49) AND g.x = least(CAST(floor((t.x + 0.5) * 40 / 61) AS INTEGER), 39)")
def resample_nearest(spark, sf):
    """P4, P5."""
    return SP.resample(I.grid(spark, sf), (50, 40), (37, 61), ["value"])


@query(f"""WITH {I.GRID}, t AS (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x, (a + 0.5::DOUBLE) * 50 / 33 - 0.5 AS py, (b + 0.5::DOUBLE) * 40 / 57 - 0.5 AS px FROM range(33) p(a), range(57) q(b)),
o AS (SELECT *, floor(py) + unnest([0, 1]) AS cy FROM t), u AS (SELECT *, floor(px) + unnest([0, 1]) AS cx FROM o),
w AS (SELECT y, x, (1 - abs(py - cy)) * (1 - abs(px - cx)) AS w, greatest(least(CAST(cy AS INTEGER), 49), 0) AS sy, greatest(least(CAST(cx AS INTEGER), 39), 0) AS sx FROM u)
SELECT w.y, w.x, round(sum(value * w) / sum(w), 5) AS value FROM w JOIN g ON g.y = sy AND g.x = sx GROUP BY ALL""")
def resample_bilinear(spark, sf):
    """P4 by two linear weights."""
    return rounded(SP.resample(I.grid(spark, sf), (50, 40), (33, 57), ["value"], "bilinear"), "value", places=5)


@query()
def resample_cubic(spark, sf):
    """P4 over 4 x 4 cells."""
    return rounded(SP.resample(I.grid(spark, sf), (50, 40), (100, 80), ["value"], "cubic"), "value", places=5)


@query(f"""WITH {I.GRID}, ring(v, a, b, c, d) AS (VALUES (1, 2, 2, 30, 4), (1, 30, 4, 20, 40), (1, 20, 40, 2, 2), (2, 10, 10, 18, 10), (2, 18, 10, 18, 20), (2, 18, 20, 10, 20), (2, 10, 20, 10, 10)),
p AS (SELECT y, x, v FROM g, ring WHERE (b > y + 0.5) <> (d > y + 0.5) AND x + 0.5 < (c - a) * (y + 0.5 - b) / nullif(d - b, 0)::DOUBLE + a GROUP BY y, x, v HAVING count(*) % 2 = 1)
SELECT g.y, g.x, CAST(max(v) AS DOUBLE) AS burned FROM g LEFT JOIN p ON g.y = p.y AND g.x = p.x GROUP BY g.y, g.x""")
def burn_polygons(spark, sf):
    """P6."""
    g = I.grid(spark, sf).withColumns({"lat": F.col("y") + 0.5, "lon": F.col("x") + 0.5})
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    rings = {1: ring((2, 2), (30, 4), (20, 40)), 2: ring((10, 10), (18, 10), (18, 20), (10, 20))}
    polygons = [spark.range(1).select(F.lit(k).alias("order"), F.lit(float(k)).alias("value"), F.array(r).alias("rings")) for k, r in rings.items()]
    return PG.rasterize(g, polygons[0].union(polygons[1]), cut=I.cut).select("y", "x", "burned")


@query(f"""WITH {I.GRID}, c AS (SELECT c_custkey AS k, (c_custkey * 73 % 400) / 10.0::DOUBLE + 0.0371 AS cx, (c_custkey * 37 % 500) / 10.0::DOUBLE + 0.0173 AS cy, 0.5::DOUBLE + c_nationkey / 5.0::DOUBLE AS r FROM customer),
o AS (SELECT k, cx, cy, r, 0 AS ring FROM c UNION ALL SELECT k, cx, cy, r / 2, 1 FROM c),
e AS (SELECT k, cx - r AS a, cy AS b, cx AS c, cy - r AS d FROM o UNION ALL SELECT k, cx, cy - r, cx + r, cy FROM o UNION ALL SELECT k, cx + r, cy, cx, cy + r FROM o UNION ALL SELECT k, cx, cy + r, cx - r, cy FROM o),
p AS (SELECT y, x, k FROM g, e WHERE (b > y + 0.5) <> (d > y + 0.5) AND x + 0.5 < (c - a) * (y + 0.5 - b) / nullif(d - b, 0)::DOUBLE + a GROUP BY y, x, k HAVING count(*) % 2 = 1)
SELECT g.y, g.x, CAST(max(k) AS DOUBLE) AS burned FROM g LEFT JOIN p ON g.y = p.y AND g.x = p.x GROUP BY g.y, g.x""")
def burn_polygon_table(spark, sf):
    """A polygon with a hole for each customer; the last one by key counts."""
    g = I.grid(spark, sf).withColumns({"lat": F.col("y") + 0.5, "lon": F.col("x") + 0.5})
    k = F.col("c_custkey")
    c = I.table(spark, sf, "customer").select(k, (k * 73 % 400 / F.lit(10.0) + 0.0371).alias("cx"), (k * 37 % 500 / F.lit(10.0) + 0.0173).alias("cy"), (F.col("c_nationkey") / F.lit(5.0) + 0.5).alias("r"))
    x, y, r = F.col("cx"), F.col("cy"), F.col("r")
    ring = lambda r: F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in ((x - r, y), (x, y - r), (x + r, y), (x, y + r))])
    return PG.rasterize(g, c.select(k.alias("order"), k.cast("double").alias("value"), F.array(ring(r), ring(r / 2)).alias("rings")), cut=I.cut).select("y", "x", "burned")


@query()
def thiessen_mean(spark, sf):
    """P7."""
    s = I.stations(spark, sf).dropDuplicates(["lat", "lon"])
    values = s.select("station", F.lit("2001-01-01").cast("date").alias("date"), "value")
    return rounded(SP.thiessen_mean(values, s.withColumn("station", F.col("station").cast("string")), [(0, 0), (40, 0), (40, 50), (0, 50)]), "mean")


@query()
def ordinary_kriging(spark, sf):
    """From each cell's 12 nearest stations."""
    s = I.stations(spark, sf).groupBy("lat", "lon").agg(F.avg("value").alias("value")).withColumn("date", F.lit("2001-01-01").cast("date"))
    g = I.grid(spark, sf).select("y", "x", F.col("y").cast("double").alias("lat"), F.col("x").cast("double").alias("lon"))
    return rounded(KR.ordinary_kriging(s, ["date"], g, I.cut), "estimate", places=4)


@query(f"""WITH RECURSIVE {I.GRID}, b AS (SELECT y, x, value % 900 + 100 AS p, value % 80 + 20 AS r, value % 500 + 600 AS et0 FROM g),
s(y, x, p, r, et0, low, high, k) AS (SELECT y, x, p, r, et0, 0.05::DOUBLE, 50.0::DOUBLE, 0 FROM b WHERE p - r < least(p, et0) AND p > r
  UNION ALL SELECT y, x, p, r, et0, CASE WHEN p - r - p * et0 / pow(pow(p, (low + high) / 2) + pow(et0, (low + high) / 2), 2 / (low + high)) > 0 THEN (low + high) / 2 ELSE low END,
    CASE WHEN p - r - p * et0 / pow(pow(p, (low + high) / 2) + pow(et0, (low + high) / 2), 2 / (low + high)) > 0 THEN high ELSE (low + high) / 2 END, k + 1 FROM s WHERE k < 60)
SELECT b.y, b.x, b.p, b.r, b.et0, round((low + high) / 2, 6) AS n FROM b LEFT JOIN s ON b.y = s.y AND b.x = s.x AND k = 60""")
def budyko_parameter(spark, sf):
    """P9."""
    b = I.grid(spark, sf).select("y", "x", (F.col("value") % 900 + 100).alias("p"), (F.col("value") % 80 + 20).alias("r"), (F.col("value") % 500 + 600).alias("et0"))
    return rounded(b.withColumn("n", L.budyko_n(F.col("p"), F.col("r"), F.col("et0"))), "n")


@query(f"""WITH {I.GRID}, b AS (SELECT y, x, value % 900 + 100 AS p, value % 500 + 600 AS et0, 1.5 + cls / 50.0::DOUBLE AS n FROM g), f AS (SELECT *, et0 / p AS phi FROM b)
SELECT y, x, round((1 + 2 * phi + 3 * n * phi * phi) / (1 + phi + n * phi * phi), 6) AS ep, round(-(phi + 2 * n * phi * phi) / (1 + phi + n * phi * phi), 6) AS ee, round(n * phi * phi / (1 + phi + n * phi * phi), 6) AS en FROM f""")
def budyko_elasticities(spark, sf):
    """P10."""
    b = I.grid(spark, sf).select("y", "x", (F.col("value") % 900 + 100).alias("p"), (F.col("value") % 500 + 600).alias("et0"), (1.5 + F.col("cls") / 50.0).alias("n"))
    return rounded(b.withColumns(L.elasticities(F.col("n"), F.col("p"), F.col("et0"))).select("y", "x", "ep", "ee", "en"), "ep", "ee", "en")


@query(f"WITH {I.GRID}, v AS (SELECT y, x, value / 2200 AS t FROM g), k AS (SELECT *, least(floor(t * 2), 1) AS i FROM v WHERE t BETWEEN 0 AND 1) SELECT y, x, round(CASE WHEN i = 0 THEN t * 2 ELSE 1 END, 6) AS red, round(CASE WHEN i = 0 THEN 0.5 * t * 2 ELSE 0.5 + 0.5 * (t * 2 - 1) END, 6) AS green FROM k")
def colours(spark, sf):
    """P12."""
    g = I.grid(spark, sf).withColumn("c", V.interpolate([(0, 0, 0), (1, 0.5, 0), (1, 1, 1)], F.col("value") / 2200)).where("c is not null")
    return g.select("y", "x", F.round(F.col("c")[0], 6).alias("red"), F.round(F.col("c")[1], 6).alias("green"))


@query("SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x, true AS inside FROM range(20) p(a), range(30) q(b)")
def random_table(spark, sf):
    """P14."""
    return V.random_integers(spark, 20, 30, -5, 5, 3).select("y", "x", F.col("value").between(-5, 5).alias("inside"))


# Ensembles. --------------------------------------------------------------------------------------------------------

QUICK = f"WITH {I.ENSEMBLE}, sd AS (SELECT station, gcm, stddev_pop(value - obs) AS sd FROM e GROUP BY ALL), w AS (SELECT station, gcm, (1 / nullif(sd, 0)) / sum(1 / nullif(sd, 0)) OVER (PARTITION BY station) AS weight FROM sd)"


@query(QUICK + " SELECT station, gcm, round(weight, 6) AS weight FROM w")
def quick_weights(spark, sf):
    """M6."""
    return rounded(E.quick_weights(I.ensemble(spark, sf), ["station"]), "weight")


@query(QUICK + " SELECT station, date, round(greatest(sum(value * weight), 0), 4) AS estimate FROM e JOIN w USING (station, gcm) GROUP BY ALL")
def weighted_ensemble(spark, sf):
    """M10, F16."""
    return rounded(pipelines.weighted_ensemble(I.ensemble(spark, sf), ["station"], conditional=True), "estimate", places=4)


@query(QUICK + """, s AS (SELECT station, gcm, var_samp(value) AS s2, avg(value) AS m FROM e GROUP BY ALL), g AS (SELECT *, sum(weight * m) OVER (PARTITION BY station) AS grand FROM s JOIN w USING (station, gcm)),
i AS (SELECT station, gcm, weight * s2 AS inner_, weight * (m - grand) ** 2 AS inter FROM g) SELECT station, gcm, round(inner_, 2) AS "inner", round(inter, 2) AS inter, round(sum(inner_ + inter) OVER (PARTITION BY station), 2) AS bma FROM i""")
def uncertainty_parts(spark, sf):
    """U1, U2."""
    e = I.ensemble(spark, sf)
    return rounded(E.uncertainty(e, E.quick_weights(e, ["station"]), ["station"]), "inner", "inter", "bma", places=2)


@query(QUICK + ", j AS (SELECT station, date, value, weight FROM e JOIN w USING (station, gcm)), mm AS (SELECT station, date, sum(weight * value) AS mean, sum(weight) AS sw, sum(weight * value * value) AS q FROM j GROUP BY ALL) SELECT station, date, round(mean, 3) AS mean, round(q - 2 * mean * mean + mean * mean * sw, 0) AS variance FROM mm")
def time_variance(spark, sf):
    """U3's deviation of each time."""
    e = I.ensemble(spark, sf)
    return rounded(rounded(E.time_variance(e, E.quick_weights(e, ["station"]), ["station"]), "mean", places=3), "variance", places=0)


#: Dates that all three members have; sums of squares and products about the means, o for the observations.
WIDE = f"""WITH {I.ENSEMBLE}, wide AS (SELECT station, date, max(value) FILTER (gcm = 'A') AS a, max(value) FILTER (gcm = 'N') AS n, max(value) FILTER (gcm = 'R') AS r, max(obs) AS o FROM e GROUP BY ALL HAVING count(*) = 3)"""


@query(WIDE + """, er AS (SELECT station, a - o AS a, n - o AS n, r - o AS r FROM wide),
c AS (SELECT station, covar_samp(a, a) AS aa, covar_samp(n, n) AS nn, covar_samp(r, r) AS rr, covar_samp(a, n) AS an, covar_samp(a, r) AS ar, covar_samp(n, r) AS nr FROM er GROUP BY 1),
i AS (SELECT station, (nn * rr - nr * nr) - (an * rr - ar * nr) + (an * nr - ar * nn) AS a, -(an * rr - nr * ar) + (aa * rr - ar * ar) - (aa * nr - ar * an) AS n, (an * nr - nn * ar) - (aa * nr - an * ar) + (aa * nn - an * an) AS r FROM c)
SELECT station, gcm, round(w, 6) AS weight FROM (SELECT station, unnest(['', 'A', 'N', 'R']) AS gcm, unnest([0.0::DOUBLE, a / (a + n + r), n / (a + n + r), r / (a + n + r)]) AS w FROM i)""")
def lagrange_weights(spark, sf):
    """M7."""
    return rounded(E.fitted_weights(I.ensemble(spark, sf), ["station"], "lagrange"), "weight")


@query()
def ridge_weights(spark, sf):
    """M8."""
    return rounded(E.fitted_weights(I.ensemble(spark, sf), ["station"], "ridge"), "weight")


@query()
def averaged_weights(spark, sf):
    """M9, B5, B7."""
    return rounded(E.fitted_weights(I.ensemble(spark, sf), ["station"], "bma"), "weight")


#: Posterior of the eight subsets: residual sums as ratios of determinants of the sums of products.
POSTERIOR = WIDE + """, c AS (SELECT station, count(*) AS t, 3 + 0 AS k, regr_sxx(a, a) AS aa, regr_sxx(n, n) AS nn, regr_sxx(r, r) AS rr, regr_sxx(o, o) AS oo, regr_sxy(a, n) AS an, regr_sxy(a, r) AS ar, regr_sxy(n, r) AS nr, regr_sxy(a, o) AS ao, regr_sxy(n, o) AS no, regr_sxy(r, o) AS ro FROM wide GROUP BY 1),
inv AS (SELECT *, aa * (nn * rr - nr * nr) - an * (an * rr - nr * ar) + ar * (an * nr - nn * ar) AS det FROM c),
rss AS (SELECT station, t, oo, unnest(['', 'A', 'N', 'R', 'A+N', 'A+R', 'N+R', 'A+N+R']) AS models, unnest([0, 1, 1, 1, 2, 2, 2, 3]) AS k, unnest([oo, oo - ao * ao / aa, oo - no * no / nn, oo - ro * ro / rr,
  oo - (ao * ao * nn - 2 * ao * no * an + no * no * aa) / (aa * nn - an * an), oo - (ao * ao * rr - 2 * ao * ro * ar + ro * ro * aa) / (aa * rr - ar * ar), oo - (no * no * rr - 2 * no * ro * nr + ro * ro * nn) / (nn * rr - nr * nr),
  oo - (ao * ao * (nn * rr - nr * nr) + no * no * (aa * rr - ar * ar) + ro * ro * (aa * nn - an * an) + 2 * ao * no * (ar * nr - an * rr) + 2 * ao * ro * (an * nr - ar * nn) + 2 * no * ro * (an * ar - aa * nr)) / det]) AS rest FROM inv),
lg AS (SELECT *, greatest(t, 9) AS g FROM rss),
l AS (SELECT station, models, k, -0.5::DOUBLE * ln(t) - (t - 1) / 2.0::DOUBLE * ln(rest) + (t - k - 1) / 2.0::DOUBLE * ln(1 + g) - (t - 1) / 2.0::DOUBLE * ln(1 + g * rest / oo) + k * ln(1 / 3.0::DOUBLE) + (3 - k) * ln(2 / 3.0::DOUBLE) AS lp FROM lg),
x AS (SELECT station, models, k, exp(lp - max(lp) OVER (PARTITION BY station)) AS w FROM l),
post AS (SELECT station, models, k, w / sum(w) OVER (PARTITION BY station) AS probability FROM x)"""


@query(POSTERIOR + " SELECT station, models, round(probability, 6) AS probability FROM post")
def model_posterior(spark, sf):
    """B1, B2: every subset's probability."""
    return rounded(E.posterior(I.ensemble(spark, sf), ["station"]), "probability").withColumn("models", F.array_join("models", "+"))


@query(POSTERIOR + " SELECT station, CAST(k AS INTEGER) AS size, round(sum(probability), 6) AS probability FROM post GROUP BY ALL")
def posterior_total(spark, sf):
    """B2: probabilities of the models' sizes."""
    return rounded(E.size_distribution(E.posterior(I.ensemble(spark, sf), ["station"]), ["station"]), "probability")


@query(POSTERIOR + " SELECT station, gcm, round(sum(probability), 6) AS inclusion FROM post, (SELECT unnest(['A', 'N', 'R']) AS gcm) WHERE contains(models, gcm) GROUP BY ALL")
def posterior_inclusion(spark, sf):
    """B2."""
    return rounded(E.inclusion(E.posterior(I.ensemble(spark, sf), ["station"]), ["station"]), "inclusion")


@query(POSTERIOR + " SELECT station, round(sum(CASE WHEN contains(models, 'A') AND contains(models, 'R') THEN probability ELSE 0 END), 6) AS probability FROM post GROUP BY 1")
def joint_inclusion(spark, sf):
    """B2: the probability that two members are both in."""
    return rounded(E.joint_inclusion(E.posterior(I.ensemble(spark, sf), ["station"]), ["station"], ["A", "R"]), "probability")


@query()
def predictive_interval(spark, sf):
    """The averaged prediction's mean and 90 % interval at each time, without draws."""
    return rounded(E.predictive_interval(I.ensemble(spark, sf), ["station"]), "mean", "low", "high", places=3)


@query()
def chain_posterior(spark, sf):
    """Subsets by eight walks a station, with the walks' agreement."""
    post, agreement = E.posterior_by_chains(I.ensemble(spark, sf), ["station"])
    return rounded(post.withColumn("models", F.array_join("models", "+")).join(agreement, "station"), "probability", "rhat", "ess")


@query()
def monte_carlo_interval(spark, sf):
    """U3."""
    e = I.ensemble(spark, sf)
    return rounded(E.monte_carlo_interval(e, E.quick_weights(e, ["station"]), ["station"]), "low", "high", places=3)


# Weather. ----------------------------------------------------------------------------------------------------------

@query(f"""WITH r AS (SELECT user_id % 10 AS station, CAST(ts AS DATE) AS date, {I.mean_sql('value')} AS value FROM events GROUP BY ALL), w AS (SELECT *, CASE WHEN value > 245 THEN 1 ELSE 0 END AS wet FROM r),
b AS (SELECT *, coalesce(lag(wet) OVER (PARTITION BY station ORDER BY date), 0) AS before FROM w), a AS (SELECT station, CAST(floor((dayofyear(date) - 1) / 14) AS INTEGER) AS fortnight, count(*) FILTER (before = 0 AND wet = 0) AS a00, count(*) FILTER (before = 0 AND wet = 1) AS a01, count(*) FILTER (before = 1 AND wet = 0) AS a10, count(*) FILTER (before = 1 AND wet = 1) AS a11 FROM b GROUP BY ALL)
SELECT *, round(a00 / nullif(a00 + a01, 0), 6) AS p00, round(a10 / nullif(a10 + a11, 0), 6) AS p10 FROM a""")
def rain_occurrence(spark, sf):
    """G2."""
    e = I.table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("station"), F.to_date("ts").alias("date")).agg(I.mean_of("value").alias("value"))
    return rounded(G.occurrence(e, ["station"], threshold=245.0), "p00", "p10")


@query(f"""WITH {I.MONTHLY}, c AS (SELECT station, month(date) AS k, avg(value) AS value FROM m GROUP BY ALL),
s AS (SELECT station, avg(value) AS mean, sum(value * sin(k * 2 * pi() / 12)) / 6 AS s1, sum(value * cos(k * 2 * pi() / 12)) / 6 AS c1, sum(value * sin(2 * k * 2 * pi() / 12)) / 6 AS s2, sum(value * cos(2 * k * 2 * pi() / 12)) / 6 AS c2 FROM c GROUP BY 1)
SELECT station, round(mean, 3) AS mean, round(s1, 3) AS s1, round(c1, 3) AS c1, round(s2, 3) AS s2, round(c2, 3) AS c2, round(s1 / cos(atan(c1 / s1)), 3) AS amplitude1, round(s2 / cos(atan(c2 / s2)), 3) AS amplitude2, round(atan(c1 / s1), 4) AS phase1, round(atan(c2 / s2), 4) AS phase2 FROM s""")
def seasonal_harmonics(spark, sf):
    """G5."""
    c = I.monthly(spark, sf).groupBy("station", F.month("date").alias("k")).agg(F.avg("value").alias("value"))
    return rounded(rounded(G.harmonics(c, ["station"], "k", 12), "mean", "s1", "c1", "s2", "c2", "amplitude1", "amplitude2", places=3), "phase1", "phase2", places=4)


@query(f"WITH {I.DAILY}, w AS (SELECT *, CASE WHEN station % 2 = 0 THEN 1 ELSE 0 END AS wet FROM d) SELECT var, CAST(dayofyear(date) AS INTEGER) AS doy, CAST(wet AS INTEGER) AS wet, round(avg(value) + 0.0000123, 4) AS mean, round(coalesce(stddev_samp(value), 0) + 0.0000123, 4) AS sd FROM w GROUP BY ALL")
def wet_dry_moments(spark, sf):
    """G6."""
    d = I.daily(spark, sf).withColumn("wet", (F.col("station") % 2 == 0).cast("int"))
    return rounded(G.state_moments(d, ["var"]), "mean", "sd", places=4, nudge=NUDGE)


def _weather(spark, sf):
    """Three synthetic years of six variables for each station."""
    s = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("station"))
    d = s.withColumn("date", F.explode(F.sequence(F.lit("2001-01-01").cast("date"), F.lit("2003-12-31").cast("date"))))
    day = F.datediff("date", F.lit("2001-01-01").cast("date")).cast("long")
    u = lambda k: ((F.col("station").cast("long") * 7919 + day * 104_729 + k * 1_299_709 + day * day * (31 + k) + F.col("station").cast("long") * day * 17) % 10_007) / 10_007.0
    wave = F.sin(F.dayofyear("date") * (2 * 3.141592653589793 / 365))
    return d.select("station", "date", F.when(u(1) < 0.3, -6 * F.log(u(2) + 0.0001)).otherwise(0.0).alias("PRE"), (20 + 8 * wave + 4 * u(3)).alias("MAXTEM"), (9 + 7 * wave + 4 * u(4)).alias("MINTEM"), (0.4 + 0.3 * u(5)).alias("RHU"), (15 + 5 * wave + u(6)).alias("RS"), (1 + 4 * u(7)).alias("WIN"))


def _u(k: int) -> str:
    return f"((station * 7919 + day * 104729 + {k * 1_299_709} + day * day * {31 + k} + station * day * 17) % 10007) / 10007.0::DOUBLE"


WEATHER = f"""days AS (SELECT CAST(n_nationkey AS BIGINT) AS station, CAST(DATE '2001-01-01' + CAST(day AS INTEGER) AS DATE) AS date, CAST(day AS BIGINT) AS day FROM nation, range(1095) r(day)),
waves AS (SELECT *, sin(dayofyear(date) * (2 * 3.141592653589793::DOUBLE / 365)) AS wave FROM days),
weather AS (SELECT station, date, CASE WHEN {_u(1)} < 0.3 THEN -6 * ln({_u(2)} + 0.0001::DOUBLE) ELSE 0.0::DOUBLE END AS PRE, 20 + 8 * wave + 4 * {_u(3)} AS MAXTEM, 9 + 7 * wave + 4 * {_u(4)} AS MINTEM,
  0.4::DOUBLE + 0.3::DOUBLE * {_u(5)} AS RHU, 15 + 5 * wave + {_u(6)} AS RS, 1 + 4 * {_u(7)} AS WIN FROM waves)"""
TEXTS = f"""{WEATHER}, texts AS (SELECT station, date, 'PRE' AS var, printf('%.1f', PRE) AS line FROM weather UNION ALL SELECT station, date, 'RHU', printf('%.3f', RHU) FROM weather UNION ALL SELECT station, date, 'RS', printf('%.2f', RS) FROM weather
  UNION ALL SELECT station, date, 'WIN', printf('%.1f', WIN) FROM weather UNION ALL SELECT station, date, 'TEM', printf('%.1f', MAXTEM) || ',' || printf('%.1f', MINTEM) FROM weather)"""


VARIABLES = ["PRE", "MAXTEM", "MINTEM", "RHU", "RS", "WIN"]


@query()
def weather_generator(spark, sf):
    """No SQL: fitted on days, generated for their months, A11 in it."""
    return _generated(_weather(spark, sf))


def _generated(d):
    months = d.groupBy("station", F.trunc("date", "MM").alias("date")).agg(*[(F.sum(v) if G.RULES[v][0] == "sum" else F.avg(v)).alias(v) for v in VARIABLES])
    return rounded(G.generate(G.fit_generator(d, ["station"], VARIABLES), months, ["station"], VARIABLES, seed=7), *VARIABLES)


@query("WITH s AS (SELECT n_nationkey AS station FROM nation), k AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month) SELECT station, CAST(y AS INTEGER) AS year, month, 1 AS met FROM s, k, (SELECT unnest([2001, 2002, 2003]) AS y)")
def generated_months(spark, sf):
    """Generated daily temperatures are ordered, and rain stays non-negative, in every month."""
    return _months_met(weather_generator(spark, sf))


def _months_met(g):
    return g.groupBy("station", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.min(((F.col("MINTEM") <= F.col("MAXTEM")) & (F.col("PRE") >= 0) & (F.col("RHU") <= 0.95)).cast("int")).alias("met"))


@query()
def multi_site_shuffle(spark, sf):
    """R1 to R3, of all stations; months a station lacks have the mean of its other such months, or of all its months."""
    m = I.monthly(spark, sf)
    m = m.select("station").distinct().crossJoin(m.select("date").distinct()).join(m, ["station", "date"], "left")
    means = [F.avg("value").over(W.partitionBy("station", *k)) for k in ([F.month("date")], [])]
    m = m.withColumn("value", F.coalesce("value", *means)).withColumn("var", F.lit("PRE"))
    gen = m.withColumn("value", F.pmod(F.xxhash64("station", "date"), F.lit(1000)) / 10.0)
    return rounded(G.multi_site(m, gen, ["var"]), "value")


@query(f"WITH {I.MONTHLY}, n AS (SELECT date FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT station) FROM m)) SELECT station, count(*) AS n FROM m SEMI JOIN n USING (date) GROUP BY 1")
def shuffle_keeps_values(spark, sf):
    """R2: each station keeps its generated values."""
    return _values_kept(I.monthly(spark, sf))


def _values_kept(m):
    m = m.withColumn("var", F.lit("PRE"))
    gen = m.withColumn("value", F.pmod(F.xxhash64("station", "date"), F.lit(1000)) / 10.0)
    out = G.multi_site(m, gen, ["var"]).select("station", F.round("value", 4).alias("value"))
    return out.join(gen.select("station", F.round("value", 4).alias("value")).distinct(), ["station", "value"]).groupBy("station").agg(F.count("*").alias("n"))


# Decomposition. ----------------------------------------------------------------------------------------------------

#: One sifting of each series with linear envelopes. Both ends are seen as a left one: j counts from the end, knots beyond it are mirrors.
SIFT = f"""WITH {I.MONTHLY}, o AS (SELECT station, date, value AS s, CAST(row_number() OVER w - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY station) AS n, lag(value) OVER w AS b, lead(value) OVER w AS a FROM m WINDOW w AS (PARTITION BY station ORDER BY date)),
ext AS (SELECT station, i, n, s, CASE WHEN s > b AND s > a THEN 'x' ELSE 'n' END AS kind FROM o WHERE (s > b AND s > a) OR (s < b AND s < a)),
enough AS (SELECT station FROM ext GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (kind = 'x') > 0 AND count(*) FILTER (kind = 'n') > 0),
sided AS (SELECT station, side, kind, s, CASE side WHEN 'L' THEN i ELSE n - 1 - i END AS j, n FROM ext, (SELECT unnest(['L', 'R']) AS side)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY station, side, kind ORDER BY j) AS r FROM sided),
edge AS (SELECT station, side, s FROM o, (SELECT unnest(['L', 'R']) AS side) WHERE (side = 'L' AND i = 0) OR (side = 'R' AND i = n - 1)),
firsts AS (SELECT station, side, min(j) FILTER (kind = 'x') AS tx, min(j) FILTER (kind = 'n') AS tn, max(s) FILTER (kind = 'x' AND r = 1) AS vx, max(s) FILTER (kind = 'n' AND r = 1) AS vn, max(n) AS n FROM ranked GROUP BY ALL),
cases AS (SELECT f.*, e.s AS at_edge, CASE WHEN tx < tn THEN CASE WHEN e.s > vn THEN 'A' ELSE 'B' END ELSE CASE WHEN e.s < vx THEN 'C' ELSE 'D' END END AS c FROM firsts f JOIN edge e USING (station, side) JOIN enough USING (station)),
picked AS (SELECT r.station, r.side, r.kind, 2 * CASE c WHEN 'A' THEN tx WHEN 'C' THEN tn ELSE 0 END - j AS j, r.s FROM ranked r JOIN cases USING (station, side)
    WHERE r BETWEEN CASE WHEN (c = 'A' AND kind = 'x') OR (c = 'C' AND kind = 'n') THEN 2 ELSE 1 END AND CASE WHEN (c = 'A' AND kind = 'x') OR (c = 'C' AND kind = 'n') THEN 3 WHEN (c = 'B' AND kind = 'n') OR (c = 'D' AND kind = 'x') THEN 1 ELSE 2 END
  UNION ALL SELECT station, side, CASE c WHEN 'B' THEN 'n' ELSE 'x' END, 0, at_edge FROM cases WHERE c IN ('B', 'D')),
outside AS (SELECT station, side FROM picked GROUP BY ALL HAVING count(*) FILTER (kind = 'x' AND j <= 0) > 0 AND count(*) FILTER (kind = 'n' AND j <= 0) > 0),
mirrors AS (SELECT * FROM picked SEMI JOIN outside USING (station, side) UNION ALL SELECT station, side, kind, -j, s FROM ranked JOIN cases USING (station, side) ANTI JOIN outside USING (station, side) WHERE r <= 2),
knots AS (SELECT station, kind, i AS t, s AS v FROM ext UNION ALL SELECT station, kind, CASE side WHEN 'L' THEN j ELSE n - 1 - j END, m.s FROM mirrors m JOIN (SELECT station, max(n) AS n FROM ext GROUP BY 1) USING (station)),
points AS (SELECT o.*, kind FROM o JOIN enough USING (station), (SELECT unnest(['x', 'n']) AS kind)),
before AS (SELECT p.*, k.t AS t0, k.v AS v0 FROM points p ASOF LEFT JOIN knots k ON p.station = k.station AND p.kind = k.kind AND p.i >= k.t),
both_ AS (SELECT x.*, k.t AS t1, k.v AS v1 FROM before x ASOF LEFT JOIN knots k ON x.station = k.station AND x.kind = k.kind AND x.i <= k.t),
env AS (SELECT station, date, s, kind, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (i - t0) / (t1 - t0) END AS e FROM both_),
mean AS (SELECT station, date, any_value(s) AS s, avg(e) AS e FROM env GROUP BY ALL),
modes AS (SELECT station, date, 1 AS component, false AS is_residual, s - e AS value FROM mean UNION ALL SELECT station, date, 2, true, e FROM mean UNION ALL SELECT station, date, 1, true, s FROM o ANTI JOIN enough USING (station))
SELECT station, date, CAST(component AS INTEGER) AS component, is_residual, round(value + 0.0000123, 3) AS value FROM modes"""


def _modes(modes: DataFrame) -> DataFrame:
    return modes.select("station", "date", "component", "is_residual", F.round(F.col("value") + NUDGE, 3).alias("value"))


@query(SIFT)
def emd_sift(spark, sf):
    """Extrema, mirrors, linear envelopes, one sifting."""
    return _modes(D.emd(I.monthly(spark, sf), ["station"], kind="linear", fixe=1, max_imf=1))


@query(SIFT)
def eemd_sift(spark, sf):
    """The ensemble's mean, dealt out in tasks, is the series' own where the noise has no width."""
    out = D.eemd(I.monthly(spark, sf), ["station"], trials=6, per_task=4, width=0.0, kind="linear", fixe=1, max_imf=1).where("not is_residual")
    return _modes(out.withColumn("is_residual", F.col("component") == F.max("component").over(W.partitionBy("station", "date"))))


@query(SIFT)
def ceemdan_sift(spark, sf):
    """The first mode without noise."""
    return _modes(D.ceemdan(I.monthly(spark, sf), ["station"], trials=3, epsilon=0.0, kind="linear", fixe=1, max_imf=1))


def _total(modes: DataFrame) -> DataFrame:
    return modes.groupBy("station", "date").agg(F.round(F.sum("value") + NUDGE, 3).alias("total"))


SUM_SQL = f"WITH {I.MONTHLY} SELECT station, date, round(value + 0.0000123, 3) AS total FROM m"


@query(SUM_SQL)
def emd_sum(spark, sf):
    """Whole decompositions add up to the series."""
    return _total(D.emd(I.monthly(spark, sf), ["station"]))


@query(SUM_SQL)
def emd_rilling_sum(spark, sf):
    """C12."""
    return _total(D.emd(I.monthly(spark, sf), ["station"], stop="rilling"))


@query()
def eemd_modes(spark, sf):
    """C7."""
    return rounded(D.eemd(I.monthly(spark, sf), ["station"], trials=100, per_task=10), "value", "deviation", places=4)


@query()
def ceemdan_modes(spark, sf):
    """C8."""
    return rounded(D.ceemdan(I.monthly(spark, sf), ["station"], trials=20), "value", places=4)


@query(SUM_SQL)
def stl_sum(spark, sf):
    """C15."""
    return _total(D.stl(I.monthly(spark, sf), ["station"]))


#: Modes of known values: scenario b has fewer than a for some stations; the residue is the last.
KNOWN = f"""WITH {I.MONTHLY}, f AS (SELECT station, date, value, scenario, 3 + station % 4 - CASE scenario WHEN 'b' THEN station % 3 ELSE 0 END AS k FROM m, (SELECT unnest(['a', 'b']) AS scenario)),
modes AS (SELECT station, scenario, date, CAST(unnest(range(1, k + 2)) AS INTEGER) AS component, k, value FROM f), bands AS (SELECT station, scenario, date, component, component = k + 1 AS is_residual, k, value * component / 10.0::DOUBLE AS value FROM modes)"""


def _known_modes(spark, sf):
    m = I.monthly(spark, sf).withColumn("scenario", F.explode(F.array(F.lit("a"), F.lit("b"))))
    m = m.withColumn("k", 3 + F.col("station") % 4 - F.when(F.col("scenario") == "b", F.col("station") % 3).otherwise(0))
    m = m.withColumn("component", F.explode(F.sequence(F.lit(1), (F.col("k") + 1).cast("int"))))
    return m.select("station", "scenario", "date", "component", (F.col("component") == F.col("k") + 1).alias("is_residual"), (F.col("value") * F.col("component") / 10.0).alias("value"))


@query(KNOWN + """, over AS (SELECT station, scenario, date, least(component, CASE WHEN is_residual THEN 99 ELSE 4 END) AS component, is_residual, least(k, 4) AS k, sum(value) AS value FROM bands GROUP BY ALL),
least_ AS (SELECT station, min(k) AS most FROM over GROUP BY 1), matched AS (SELECT station, scenario, date, CASE WHEN is_residual THEN component ELSE least(component, most) END AS component, is_residual, value FROM over JOIN least_ USING (station)),
merged AS (SELECT station, scenario, date, is_residual, CASE WHEN component > 2 AND component <= 4 THEN 3 ELSE component END AS c, sum(value) AS value FROM matched GROUP BY ALL)
SELECT station, scenario, date, CAST(dense_rank() OVER (PARTITION BY station, scenario, date ORDER BY is_residual, c) AS INTEGER) AS component, is_residual, round(value + 0.0000123, 3) AS value FROM merged""")
def merged_modes(spark, sf):
    """Components cut at four, then at what both scenarios have, then two of them merged."""
    keys = ["station", "scenario"]
    out = D.merge_components(D.cut_unmatched(D.cut_overflow(_known_modes(spark, sf), keys, 4), keys, "scenario"), keys, [(2, 4)])
    return out.select("station", "scenario", "date", "component", "is_residual", F.round(F.col("value") + NUDGE, 3).alias("value"))


def _significance_sql(test: str) -> str:
    """Three bands of each series: what a running mean of three leaves, what one of nine leaves of that, and the residue."""
    limit = "abs(e + lt) > spread" if test == "apriori" else "e + (first(-lt + unit * exp(lt) / 2 - e) OVER (PARTITION BY station ORDER BY component)) > spread - lt"
    return f"""WITH {I.MONTHLY}, a AS (SELECT station, date, value, avg(value) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a3, avg(value) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS a9 FROM m),
b AS (SELECT station, date, 1 AS component, value - a3 AS v FROM a UNION ALL SELECT station, date, 2, a3 - a9 FROM a),
c AS (SELECT *, v >= 0 AND v > lag(v) OVER w AND v > lead(v) OVER w AS peak FROM b WINDOW w AS (PARTITION BY station, component ORDER BY date)),
d AS (SELECT station, component, count(*) AS n, ln(count(*) / greatest(count(*) FILTER (peak), 1)::DOUBLE) AS lt, ln(sum(v * v) / count(*)) AS e FROM c GROUP BY ALL),
u AS (SELECT *, 1.959963984540054::DOUBLE * sqrt(2.0::DOUBLE / n) AS unit, 1.959963984540054::DOUBLE * sqrt(2.0::DOUBLE / n) * exp(lt / 2) AS spread FROM d)
SELECT station, CAST(component AS INTEGER) AS component, CAST({limit} AS INTEGER) AS significant FROM u"""


def _running(spark, sf):
    w = lambda k: W.partitionBy("station").orderBy("date").rowsBetween(-k, k)
    m = I.monthly(spark, sf).withColumns({"a3": F.avg("value").over(w(1)), "a9": F.avg("value").over(w(4))})
    bands = F.array(*[F.struct(F.lit(k).alias("component"), F.lit(k == 3).alias("is_residual"), v.alias("value")) for k, v in ((1, F.col("value") - F.col("a3")), (2, F.col("a3") - F.col("a9")), (3, F.col("a9")))])
    return m.select("station", "date", F.explode(bands).alias("b")).select("station", "date", "b.*")


@query(_significance_sql("aposteriori"))
def significant_bands(spark, sf):
    """C13, energies moved to the first band's upper limit."""
    return D.significance(_running(spark, sf), ["station"])


@query(_significance_sql("apriori"))
def significant_bands_apriori(spark, sf):
    """C13, energies as they are."""
    return D.significance(_running(spark, sf), ["station"], test="apriori")


@query()
def emd_components(spark, sf):
    """C1."""
    return rounded(D.emd(I.monthly(spark, sf), ["station"]), "value", places=4)


@query()
def stl_robust_residual(spark, sf):
    """C16."""
    return rounded(D.stl(I.monthly(spark, sf), ["station"], 12, 7, None, robust=True, most_missing=0.05).where("is_residual").select("station", "date", "value"), "value", places=4)


@query()
def mode_significance(spark, sf):
    """C13."""
    return D.significance(D.emd(I.monthly(spark, sf), ["station"]), ["station"])


@query()
def mode_frequency(spark, sf):
    """C14."""
    return rounded(D.instantaneous_frequency(D.emd(I.monthly(spark, sf), ["station"]), ["station"], 1.0), "frequency")


@query()
def emd2d_grid(spark, sf):
    """The modes of the whole grid."""
    return rounded(D.emd2d(I.grid(spark, sf).withColumn("image", F.lit(1)), ["image"]), "value", places=4).drop("image")


@query()
def bemd_grid(spark, sf):
    """C11: the modes of the whole grid."""
    return rounded(D.emd2d(I.grid(spark, sf).withColumn("image", F.lit(1)), ["image"], radial=True), "value", places=4).drop("image")


# Filters and downscaling. ------------------------------------------------------------------------------------------

@query()
def dynamic_model(spark, sf):
    """D1k."""
    m = R.lag_one(I.monthly(spark, sf), ["station"]).withColumn("lag", F.lag("value").over(W.partitionBy("station").orderBy("date")))
    m = T.min_max(m, ["station"]).withColumn("lag", F.coalesce(F.lag("scaled").over(W.partitionBy("station").orderBy("date")), "scaled"))
    out = DY.forward_filter(m.select("station", "date", F.col("scaled").alias("value"), "lag"), ["station"], ["lag"])
    return out.select("station", "date", F.round(F.element_at("m", 3), 6).alias("ac"), F.round("nu", 6).alias("nu"), F.round("likelihood", 6).alias("likelihood"))


@query()
def dynamic_lag_coefficient(spark, sf):
    """D2k."""
    m = T.min_max(I.monthly(spark, sf), ["station"]).select("station", "date", F.col("scaled").alias("value"))
    return rounded(DY.lag_coefficient(m, ["station"]), "ac", "variance")


def _predictors(spark, sf):
    m = I.monthly(spark, sf).withColumn("date", F.to_date("date"))
    t = F.months_between("date", F.lit("1995-01-01").cast("date"))
    m = m.withColumns({"x1": t / 80, "x2": F.sin(F.month("date") * 0.5236), "x3": F.cos(F.month("date") * 0.5236), "x4": F.pmod(F.xxhash64("station", "date"), F.lit(100)) / 100.0})
    return T.split_years(T.min_max(m, ["station"]).withColumn("y", F.col("scaled")), ["station"])


@query()
def downscaling_linear(spark, sf):
    """M1, M2, M4, M5."""
    rows, names = _predictors(spark, sf), ["x1", "x2", "x3", "x4"]
    c = DS.fit_linear(rows, ["station"], names, ["y"], 3)
    return rounded(DS.predict_linear(rows, c, ["station"], names, conditional=True).where("target is null").select("station", "date", "prediction"), "prediction")


@query()
def downscaling_perceptron(spark, sf):
    """M3."""
    rows = _predictors(spark, sf)
    return rounded(DS.perceptron(rows, ["station"], ["x1", "x2", "x3", "x4"], "y", layers=(32, 16), epochs=60, subsets=[["x1", "x2", "x3"], ["x2", "x4"]]), "prediction", places=4)


@query()
def factor_attribution(spark, sf):
    """P11."""
    li = I.table(spark, sf, "part").select((F.col("p_size") % 4).alias("zone"), "p_size", "p_retailprice", (F.col("p_partkey") % 100).cast("double").alias("k"))
    return rounded(DS.attribution(li.select("zone", F.col("p_size").cast("double").alias("size"), "k", F.col("p_retailprice").alias("y")), ["zone"], ["size", "k"], "y", trees=20), "mean_shap", "share")


@query(f"WITH {TEXTS} SELECT var || station AS file, date, line FROM texts UNION ALL SELECT var || station, CAST(min(date) - 1 AS DATE), strftime(min(date), '%Y%m%d') FROM texts GROUP BY var, station")
def swat_lines(spark, sf):
    """K1, K2."""
    return sinks.weather_lines(_weather(spark, sf))


# Files: written by a sink into the shared folder and read again. ------------------------------------------------------

@query(f"WITH {WEATHER} SELECT CAST(station AS VARCHAR) AS station, date, var, value FROM (SELECT station, date, CAST(printf('%.1f', PRE) AS DOUBLE) AS PRE, CAST(printf('%.3f', RHU) AS DOUBLE) AS RHU, CAST(printf('%.2f', RS) AS DOUBLE) AS RS, CAST(printf('%.1f', WIN) AS DOUBLE) AS WIN, CAST(printf('%.1f', MAXTEM) AS DOUBLE) AS MAXTEM, CAST(printf('%.1f', MINTEM) AS DOUBLE) AS MINTEM FROM weather) UNPIVOT (value FOR var IN (PRE, RHU, RS, WIN, MAXTEM, MINTEM))")
def gauge_files(spark, sf):
    """S3, K1, K2: one text file a station and variable, first day on top."""
    folder = I.scratch(spark, "gauges")
    sinks.write_files(sinks.weather_files(_weather(spark, sf)), folder)
    return tables.gauges(spark, folder)


@query(f"WITH {I.DAILY}, w AS (SELECT station, date, max(value) FILTER (var = 'click') AS click, max(value) FILTER (var = 'view') AS view FROM d GROUP BY ALL), v AS (SELECT station, date, 'click' AS var, click AS value FROM w UNION ALL SELECT station, date, 'view', view FROM w) SELECT CAST(station AS VARCHAR) AS station, date, var, CASE WHEN value < 1000 THEN value END AS value FROM v")
def observation_files(spark, sf):
    """One CSV a station, missing values as -99, of two variables."""
    folder = I.scratch(spark, "observations")
    wide = I.daily(spark, sf).groupBy("station", "date").pivot("var", ["click", "view"]).agg(F.first("value"))
    line = F.concat_ws(",", F.col("date").cast("string"), *[F.coalesce(F.col(v).cast("string"), F.lit("-99")) for v in ("click", "view")])
    files = wide.groupBy("station").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    sinks.write_files(files.select(F.concat(F.col("station").cast("string"), F.lit(".csv")).alias("name"), F.concat(F.lit("Date,click,view\n"), F.array_join("lines", "\n")).cast("binary").alias("content")), folder)
    return tables.observations(spark, folder, ["click", "view"])


@query(f"WITH {I.STATIONS} SELECT CAST(station AS VARCHAR) AS station, lat, lon, value AS elevation FROM s")
def station_file(spark, sf):
    """S13."""
    folder = I.scratch(spark, "stations")
    I.stations(spark, sf).select(F.col("station").alias("Station"), F.col("lat").alias("LAT"), F.col("lon").alias("LONG"), F.col("value").alias("ELEVATION")).write.csv(folder, header=True)
    return tables.stations(spark, folder)


@query(f"""WITH {I.GRID}, f(time) AS (VALUES (DATE '2001-01-10'), (DATE '2001-01-11'), (DATE '2001-01-12'), (DATE '2001-01-13')), d AS (SELECT max(y) AS my, max(x) AS mx FROM g)
SELECT CAST(r.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, 50.0::DOUBLE - r.y AS lat, 100.0::DOUBLE + c.x AS lon, time, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value
FROM d, range(0, my + 1) r(y), range(0, mx + 1) c(x), f LEFT JOIN g ON g.y = r.y AND g.x = c.x""")
def tiff_files(spark, sf):
    """GeoTIFFs of each compression, in strips and in tiles, written and read: all cells, those that no part fills as well."""
    folder = I.scratch(spark, "tiffs")
    g = I.grid(spark, sf).select("y", "x", (50.0 - F.col("y")).alias("lat"), (100.0 + F.col("x")).alias("lon"), "value")
    layouts = [{}, {"compression": "lzw", "predictor": 2, "tile": 16}, {"compression": "deflate", "predictor": 3, "rows": 7}, {"compression": "packbits", "tile": 32}]
    for k, layout in enumerate(layouts):
        sinks.write_files(sinks.tiffs(g.withColumn("name", F.lit(f"price_2001011{k}.tif")), ["name"], **layout), folder)
    return rasters.tiff_stack(spark, folder).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


def _model_files(spark, sf) -> str:
    """A folder of NetCDF files, one an order priority: daily sums by nation (5 x 5 cells) and status (levels), in a calendar without leap days."""
    folder = I.scratch(spark, "models")
    o = I.table(spark, sf, "orders").join(I.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")
    level = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    sums = o.where(~C.is_leap_day(day)).groupBy(F.substring("o_orderpriority", 1, 1).alias("model"), ((F.year(day) - 1995) * 365 + C.doy365(day) - 1).alias("step"), level.alias("level"), F.col("c_nationkey").alias("nation"))
    sums = sums.agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.lit(100.0)).alias("value"))

    def build(pdf):
        model = pdf["model"].iloc[0]
        cube = np.full((int(pdf["step"].max()) + 1, 3, 25), 1e20)
        cube[pdf["step"], pdf["level"], pdf["nation"]] = pdf["value"]
        time = np.arange(len(cube), dtype=float), {"units": "days since 1995-01-01", "calendar": "noleap"}
        raw = netcdf.write_netcdf({
            "lat": (["lat"], np.arange(5) * 12.0, {}), "lon": (["lon"], np.arange(5) * 9.0 + 1, {}), "plev": (["plev"], np.array([850.0, 500.1, 250.0]), {"units": "hPa"}),
            "time": (["time"], *time), "ta": (["time", "plev", "lat", "lon"], cube.reshape(-1, 3, 5, 5), {"_FillValue": 1e20}),
        }, record="time" if model in "135" else None, version=5 if model in "12" else 2)
        return pd.DataFrame([{"name": f"ta_day_M{model}.nc", "content": raw}])

    sinks.write_files(sums.groupBy("model").applyInPandas(build, "name string, content binary"), folder)
    return folder


@query(f"""WITH {I.STATIONS}, od AS (SELECT substr(o_orderpriority, 1, 1) AS model, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS status, c_nationkey AS nation, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
v AS (SELECT model, date, CASE status WHEN 'O' THEN 85000.0::DOUBLE ELSE 50000.0::DOUBLE END AS level, nation // 5 AS y, nation % 5 AS x, value FROM od WHERE status IN ('O', 'F') AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND NOT (month(date) = 2 AND day(date) = 29)),
near AS (SELECT station, y, x, row_number() OVER (PARTITION BY station ORDER BY sqrt((lat - y * 12) ** 2 + (lon - x * 9 - 1) ** 2), y, x) AS k FROM s, (SELECT DISTINCT y, x FROM v))
SELECT station, model, level, CAST(date_trunc('month', date) AS DATE) AS date, round(avg(value) + {NUDGE}, 4) AS value, count(*) AS n FROM near JOIN v USING (y, x) WHERE k = 1 GROUP BY ALL""")
def netcdf_stations(spark, sf):
    """Five models' files read by the data source, period and levels pushed down; each station has the monthly means of its nearest cell with data."""
    folder = _model_files(spark, sf)
    netcdf.register(spark)
    cube = spark.read.format("netcdf").options(variable="ta", levels="50000,85000").load(folder)
    cube = T.select_time(cube, "1996-01-01", "2000-12-31").where("value is not null").withColumn("model", F.regexp_extract("path", "M(.)[.]nc$", 1))
    cells = cube.select("y", "x", "lat", "lon").distinct()
    near = SP.nearest_cell(I.stations(spark, sf), cells, tile=12.0).select("station", "y", "x")
    monthly = cube.groupBy("y", "x", "model", "level", F.trunc("date", "MM").alias("date")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return rounded(near.join(monthly, ["y", "x"]).select("station", "model", "level", "date", "value", "n"), "value", places=4, nudge=NUDGE)


@query("SELECT r_name || '.tif' AS name, r_regionkey % 2 = 0 AS ok FROM region")
def checked_files(spark, sf):
    """Files that cannot be opened are told from those that can."""
    folder = I.scratch(spark, "checked")
    good = rasters.write_tiff(np.ones((2, 2)), np.array([1.0, 0.0]), np.array([0.0, 1.0]))
    r = I.table(spark, sf, "region")
    sinks.write_files(r.select(F.concat("r_name", F.lit(".tif")).alias("name"), F.when(F.col("r_regionkey") % 2 == 0, F.lit(good)).otherwise(F.lit(b"not a picture")).alias("content")), folder)
    found = tables.files(spark, folder, ".tif").join(rasters.check(spark, folder, ".tif"), "path")
    return found.select(F.regexp_extract(F.url_decode("path"), "([^/]+)$", 1).alias("name"), "ok")


@query("SELECT 'v' || (s_suppkey % 3) AS variable, CASE WHEN s_suppkey % 2 = 0 THEN 'day' ELSE 'Amon' END AS \"table\", 'src' || s_nationkey AS source, CAST(1900 + s_suppkey % 150 AS VARCHAR) || '0101' AS start, CAST(1910 + s_suppkey % 150 AS VARCHAR) || '1231' AS \"end\" FROM supplier WHERE s_suppkey % 5 <> 4 AND 1910 + s_suppkey % 150 >= 1950 AND 1900 + s_suppkey % 150 <= 2020")
def model_catalogue(spark, sf):
    """Files by their names, of the wanted tables and years."""
    k = F.col("s_suppkey")
    table = F.when(k % 5 == 4, "Omon").when(k % 2 == 0, "day").otherwise("Amon")
    text = lambda c: c.cast("string")
    name = F.concat_ws("_", F.concat(F.lit("v"), text(k % 3)), table, F.concat(F.lit("src"), text(F.col("s_nationkey"))), F.lit("historical"), F.lit("r1i1p1f1"), F.lit("gn"), F.concat(text(1900 + k % 150), F.lit("0101-"), text(1910 + k % 150), F.lit("1231")))
    paths = I.table(spark, sf, "supplier").select(F.concat(F.lit("/models/"), name, F.lit(".nc")).alias("path"))
    return tables.catalogue(paths, to_year=2020).select("variable", "table", "source", "start", "end")


@query(f"WITH {I.ENSEMBLE} SELECT station, date, max(value) FILTER (gcm = 'A') AS a, max(value) FILTER (gcm = 'N') AS n, max(value) FILTER (gcm = 'R') AS r FROM e GROUP BY ALL")
def predictor_columns(spark, sf):
    """Frames appended, a column a predictor."""
    e = I.ensemble(spark, sf).select("station", "date", F.lower("gcm").alias("predictor"), "value")
    frames = [e.where("date < '1997-01-01'"), e.where("date >= '1997-01-01'")]
    return tables.predictors(frames, ["station"], ["a", "n", "r"])


@query()
def grid_tiffs(spark, sf):
    """K3: each grid as the bytes of a GeoTIFF."""
    g = I.grid(spark, sf).select(F.lit("price").alias("band"), "y", "x", (50.0 - F.col("y")).alias("lat"), (100.0 + F.col("x")).alias("lon"), "value")
    return sinks.tiffs(g, ["band"]).select("band", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("digest"))
