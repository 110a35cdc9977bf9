"""Invariants of operators on small tables."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import calendar as C, landscape as L
from isohyet.operators import composites as CO, decomposition as D, ensemble as E, kriging as KR, spatial as SP, temporal as T, trend as R, weather as G
from isohyet.operators.kernels import bayes, ranks
from isohyet.plans import inputs
from isohyet.sources import sinks


def series(spark, values, key="s"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "station string, k int, value double").withColumn("date", F.add_months(F.lit("2000-01-01").cast("date"), F.col("k"))).drop("k")


def test_trend_of_a_line(spark):
    r = R.mann_kendall(series(spark, [1.0 + 0.5 * k for k in range(30)]), ["station"]).first()
    assert (r.s, r.sen, r.tau) == (435.0, 0.5, 1.0) and r["class"] == 2


@pytest.mark.parametrize("values", [[3.0] * 12, [None] * 5])
def test_trend_of_nothing(spark, values):
    r = R.mann_kendall(series(spark, values), ["station"]).first()
    assert r.s is None and r.z is None and r["class"] is None


def test_gap_is_the_mean(spark):
    a = R.mann_kendall(series(spark, [1.0, None, 3.0, 8.0]), ["station"]).first()
    b = R.mann_kendall(series(spark, [1.0, 4.0, 3.0, 8.0]), ["station"]).first()
    assert a.z == b.z


def test_change_point(spark):
    r = R.pettitt(series(spark, [0.0 + k * 0.01 for k in range(20)] + [5.0 + k * 0.01 for k in range(20)]), ["station"]).first()
    assert r.k in (18, 19) and r["class"] == 2


def test_significance_bounds(spark):
    z = [-3.0, -2.58, -2.0, -1.96, 0.0, 1.96, 2.0, 2.58, 3.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(C.significance(F.col("z"))).collect()]
    assert got == [-2, -1, -1, 0, 0, 0, 1, 1, 2, None]


def test_correction_meets_targets(spark):
    d = spark.range(1).select(F.explode(F.sequence(F.lit("2001-01-01").cast("date"), F.lit("2001-12-31").cast("date"))).alias("date")).withColumns({"station": F.lit("s"), "value": F.dayofmonth("date").cast("double")})
    target = d.select("station", F.trunc("date", "MM").alias("date")).distinct().withColumn("value", F.month("date") * 10.0)
    for how, corrector in (("sum", "scaling"), ("mean", "translation")):
        out = T.correct_monthly(d, target, ["station"], how=how, corrector=corrector)
        agg = F.sum("corrected") if how == "sum" else F.avg("corrected")
        assert all(r.a == pytest.approx(r.m * 10.0) for r in out.groupBy(F.month("date").alias("m")).agg(agg.alias("a")).collect())


def test_ensemble_trials_do_not_depend_on_partitions(spark):
    r = random.Random(0)
    s = series(spark, [math.sin(k / 3) + r.random() for k in range(60)])
    a, b = (sorted((x.date, x.component, round(x.value, 9)) for x in D.eemd(s.repartition(p), ["station"], trials=12, per_task=t).collect()) for p, t in ((1, 12), (4, 5)))
    assert a == b


def test_merged_components(spark):
    rows = [("s", 1, c, c == 5, float(c)) for c in range(1, 6)]
    modes = spark.createDataFrame(rows, "station string, date int, component int, is_residual boolean, value double")
    got = sorted((r.component, r.is_residual, r.value) for r in D.merge_components(modes, ["station"], [(2, 4)]).collect())
    assert got == [(1, False, 1.0), (2, False, 2.0), (3, False, 7.0), (4, True, 5.0)]
    assert {r.component for r in D.cut_overflow(modes, ["station"], 2).collect()} == {1, 2, 5}


def test_weights(spark):
    rows = [("s", d, g, 10.0 + d + e * ((-1) ** d), 10.0 + d) for d in range(12) for g, e in (("a", 1.0), ("b", 3.0))]
    e = spark.createDataFrame(rows, "station string, date int, gcm string, value double, obs double")
    w = {r.gcm: r.weight for r in E.quick_weights(e, ["station"]).collect()}
    assert w["a"] == pytest.approx(0.75) and sum(w.values()) == pytest.approx(1)
    assert sum(r.probability for r in E.posterior(e, ["station"]).collect()) == pytest.approx(1)
    i = E.monte_carlo_interval(e, E.quick_weights(e, ["station"]), ["station"], 500, conditional=True).collect()
    assert all(0 <= r.low <= r.high for r in i)
    assert E.equal_times(e, ["station"]).count() == 0


def test_nearest_cells(spark):
    r = random.Random(1)
    points = [(i, r.uniform(-10, 60), r.uniform(-20, 80)) for i in range(40)] + [(99, 85.0, 170.0), (100, None, 1.0)]
    cells = [(y, x, y * 1.5, x * 1.5, (y + x) % 3 > 0) for y in range(20) for x in range(20)]
    got = SP.nearest_cell(spark.createDataFrame(points, "station int, lat double, lon double"), spark.createDataFrame(cells, "y int, x int, lat double, lon double, ok boolean"), usable=F.col("ok")).collect()
    assert {g.station for g in got} == {p[0] for p in points if p[1] is not None}
    for g in got:
        p = points[[q[0] for q in points].index(g.station)]
        assert g.distance == pytest.approx(min(math.hypot(p[1] - c[2], p[2] - c[3]) for c in cells if c[4]))


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_resampling_keeps_a_constant(spark, method):
    g = spark.createDataFrame([(y, x, 7.0) for y in range(6) for x in range(5)], "y int, x int, value double")
    out = SP.resample(g, (6, 5), (9, 11), ["value"], method).collect()
    assert len(out) == 99 and all(r.value == pytest.approx(7) for r in out)


def krige(xy, z, to, model):
    """Dense ordinary kriging of all stations to each point."""
    n = len(z)
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = SP.spherical(np.sqrt(((xy[:, None] - xy) ** 2).sum(2)), *model)
    a[n, n] = 0
    b = np.ones((n + 1, len(to)))
    b[:n] = SP.spherical(np.sqrt(((xy[:, None] - to) ** 2).sum(2)), *model)
    return np.maximum((np.linalg.solve(a, b)[:n].T @ z), 0)


def kriged(spark, tmp_path, places, shape=(9, 7), **limits):
    """places: date -> (xy, z). Estimates by cell, and the models."""
    rows = [(d, float(x), float(y), float(v), 1) for d, (xy, z) in places.items() for (x, y), v in zip(xy, z, strict=True)]
    stations = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0, 1), ("a", 1.0, 1.0, None, 1), (None, 1.0, 1.0, 5.0, 1)], "date string, lon double, lat double, value double, x int")
    grid = spark.range(shape[0] * shape[1]).selectExpr(f"cast(id div {shape[1]} as int) as y", f"cast(id % {shape[1]} as int) as x").selectExpr("*", "y * 1.25 as lat", "x * 1.5 as lon")

    def cut(df, n=[0]):  # noqa: B006
        n[0] += 1
        df.write.parquet(f"{tmp_path}/{n[0]}", mode="overwrite")
        return spark.read.parquet(f"{tmp_path}/{n[0]}")

    out = KR.ordinary_kriging(stations, ["date"], grid, cut, **limits)
    models = {r.date: tuple(r.model) for r in KR.variograms(stations.where("date is not null and lon is not null and value is not null").groupBy("date", "lon", "lat").agg(F.avg("value").alias("z")), ["date"]).collect()}
    got = {}
    for r in out.collect():
        assert (r.date, r.y, r.x) not in got
        got[r.date, r.y, r.x] = r.estimate
    return got, models


def test_kriging_from_all_stations_is_dense_kriging(spark, tmp_path):
    r = np.random.default_rng(0)
    places = {"a": (r.random((25, 2)) * 10, r.random(25) * 9), "b": (r.random((14, 2)) * 10, r.random(14) * 9)}
    got, models = kriged(spark, tmp_path, places, k=25, block=7)
    assert len(got) == 2 * 63
    for d, (xy, z) in places.items():
        wanted = krige(xy, z, np.array([(x * 1.5, y * 1.25) for y in range(9) for x in range(7)]), models[d])
        assert [got[d, y, x] for y in range(9) for x in range(7)] == pytest.approx(wanted.tolist(), abs=1e-7)


@pytest.mark.parametrize("limits", [{}, {"block": 16, "part": 9}])
def test_kriging_from_the_nearest(spark, tmp_path, limits):
    """Each cell's 5 nearest stations, wherever they lie: a crowd in a corner, few elsewhere, some far off the grid."""
    r = np.random.default_rng(1)
    xy = np.concatenate([r.random((60, 2)) * 0.5, r.random((8, 2)) * 10, r.random((4, 2)) * 3 + 60])
    z = np.round(r.random(72) * 9, 3)
    got, models = kriged(spark, tmp_path, {"a": (np.concatenate([xy, xy[:1]]), np.r_[z, z[0] + 1])}, k=5, **limits)
    z[0] += 0.5  # the mean of two at one place
    for (_, y, x), v in got.items():
        to = np.array([x * 1.5, y * 1.25])
        near = np.argsort(np.sqrt(((xy - to) ** 2).sum(1)), kind="stable")[:5]
        assert v == pytest.approx(krige(xy[near], z[near], to[None], models["a"])[0], abs=1e-6)
    assert len(got) == 63


def test_kriging_of_few_stations(spark, tmp_path):
    got, _ = kriged(spark, tmp_path, {"a": (np.array([[1.0, 1.0], [4.0, 4.0]]), np.array([2.0, 4.0])), "b": (np.array([[1.0, 2.0]] * 2), np.array([3.0, 5.0])), "c": (np.arange(10).reshape(5, 2) * 1.0, np.full(5, 6.0))}, k=3)
    assert {d: {v for (e, *_), v in got.items() if e == d} for d in "abc"} == {"a": {3.0}, "b": {4.0}, "c": {6.0}}


def test_variogram_of_all_pairs(spark):
    """Bins summed over pairs of blocks are those of all pairs at once."""
    r = np.random.default_rng(4)
    xy, z = r.random((50, 2)) * 8, r.random(50)
    df = spark.createDataFrame([("k", float(x), float(y), float(v)) for (x, y), v in zip(xy, z, strict=True)], "key string, lon double, lat double, z double")
    i, j = np.triu_indices(50, 1)
    h, g = np.sqrt(((xy[i] - xy[j]) ** 2).sum(1)), 0.5 * (z[i] - z[j]) ** 2
    lag = np.minimum((h / np.sqrt((np.ptp(xy, axis=0) ** 2).sum()) * KR.LAGS).astype(int), KR.LAGS - 1)
    n = np.bincount(lag, minlength=KR.LAGS)
    wanted = KR.fitted((np.bincount(lag, h, KR.LAGS) / np.maximum(n, 1))[n > 0], (np.bincount(lag, g, KR.LAGS) / np.maximum(n, 1))[n > 0], len(h))
    for block in (8, 1024):
        assert tuple(KR.variograms(df, ["key"], block=block).first().model) == pytest.approx(wanted)


def test_thiessen_weights():
    import pandas as pd

    s = pd.DataFrame({"station": ["a", "b"], "lat": [0.0, 0.0], "lon": [1.0, 3.0]})
    w = SP.thiessen_weights(s, [(0, -1), (4, -1), (4, 1), (0, 1)])
    assert w["weight"].tolist() == pytest.approx([0.5, 0.5])


def test_budyko(spark):
    row = spark.createDataFrame([(559.42, 166.55, 935.33), (100.0, 120.0, 50.0)], "p double, r double, e double").select("*", L.budyko_n(F.col("p"), F.col("r"), F.col("e")).alias("n")).collect()
    n = row[0].n
    assert row[0].p - row[0].r == pytest.approx(row[0].p * row[0].e / (row[0].p ** n + row[0].e ** n) ** (1 / n), rel=1e-6) and row[1].n is None


def test_weather_fortnights(spark):
    d = spark.range(1).select(F.explode(F.sequence(F.lit("2001-01-01").cast("date"), F.lit("2004-12-31").cast("date"))).alias("date")).withColumns({"station": F.lit(1), "value": (F.pmod(F.xxhash64("date"), F.lit(10)) < 3).cast("double")})
    got = G.occurrence(d, ["station"]).collect()
    assert len(got) == 26 and all(r.a00 + r.a01 + r.a10 + r.a11 == 56 for r in got)


def test_long_series_of_trends(spark):
    """20,000 steps a series: trend, change point and sequential test in seconds each, as the kernels have them."""
    x = np.round(np.random.default_rng(5).gamma(2, 3, 20_000), 1)
    x[12_000:] += 1.0
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "date int, value double").withColumn("station", F.lit("s"))
    r, p = R.mann_kendall(rows, ["station"]).first(), R.pettitt(rows, ["station"]).first()
    assert r.s == ranks.trend_sum(x) and r.sen == ranks.sen_slope(x) and r["class"] == 2
    signs = np.array([np.sign(v - x).sum() for v in x])
    u = np.cumsum(signs[1:])
    assert (p.k, p.u) == (int(np.abs(u).argmax()), u[np.abs(u).argmax()]) and abs(p.k - 12_000) < 200 and p["class"] == 2
    steps = R.sequential_mk(rows, ["station"]).agg(F.count("*"), F.max("uf"), F.count_if("crossing")).first()
    uf, ub = ranks.sequential(x)
    assert tuple(steps) == (20_000, pytest.approx(uf.max()), len(ranks.crossings(uf, ub)))


def test_no_prefix_is_filtered(spark):
    """Pettitt's sums come from ranks: windows, no lambda over a series for each of its steps."""
    plan = R.pettitt(series(spark, [1.0, 2.0, 5.0]), ["station"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(__v#" in plan


def test_keys_of_any_name(spark):
    """Cells are keyed by y and x, whatever columns the statistics make on their way."""
    values = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0, 7.0]
    rows = spark.createDataFrame([(0, 7, k, v) for k, v in enumerate(values)], "y int, x int, date int, value double")
    one = series(spark, values)
    for f in (R.mann_kendall, R.pettitt, R.sequential_mk):
        a, b = f(rows, ["y", "x"]), f(one, ["station"])
        assert a.columns == ["y", "x", *b.columns[1:]] and sorted(tuple(r)[2:] for r in a.collect()) == sorted(tuple(r)[1:] for r in b.collect())


# Composites.
def cells(spark, first, days, seed=0):
    r = np.random.default_rng(seed)
    rows = [(y, x, first + dt.timedelta(days=int(k)), None if (v := float(r.integers(-2, 50))) < 0 else v) for k in days for y in range(2) for x in range(3)]
    return spark.createDataFrame(rows, "y int, x int, time date, value double")


def test_composites_grow_with_the_stack(spark, tmp_path):
    """Dates in three lots, the last between the others: as if all came at once; buckets without new dates keep their files."""
    first, path = dt.date(1999, 12, 1), str(tmp_path / "sums")
    lots = [cells(spark, first, range(0, 60), 1), cells(spark, first, range(90, 130), 2), cells(spark, first, range(60, 90), 3)]
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "sums").glob("bucket=*/*.parquet")}
    seen = []
    for k, lot in enumerate(lots):
        table = CO.update(spark, path, lot, ["y", "x"], 16, str(tmp_path / f"work{k}"))
        seen.append(files())
    got = {(r.y, r.x, r.time): r.value for r in CO.means(table, ["y", "x"]).collect()}
    want = {(r.y, r.x, r.time): r.value for r in CO.means(CO.sums(lots[0].union(lots[1]).union(lots[2]), ["y", "x"], 16), ["y", "x"]).collect()}
    assert got == want and len({t for *_, t in got}) == 10 and dt.date(2000, 1, 1) in {t for *_, t in got}
    same = {b for b in seen[1] if seen[1][b] == seen[2][b]}
    assert same == {b for b in seen[1] if not "bucket=2000-01-17" <= b <= "bucket=2000-02-18"} and len(same) > 3


def test_buckets_of_a_year(spark):
    days = spark.sql("select explode(sequence(date'2000-01-01', date'2001-12-31')) as d").select("d", CO.bucket(F.col("d"), 16).alias("b")).collect()
    for r in days:
        start = dt.date(r.d.year, 1, 1)
        assert r.b == start + dt.timedelta(days=(r.d - start).days // 16 * 16)


def test_consecutive_rasters(spark):
    """Every three rasters of the stack, cells with gaps included."""
    df = cells(spark, dt.date(2001, 1, 1), range(0, 21, 2)).where("not (y = 0 and x = 0 and dayofmonth(time) < 8)")
    got = {(r.y, r.x, r.time): r.value for r in CO.consecutive(df, ["y", "x"], 3).collect()}
    rows, want = df.collect(), {}
    dates = sorted({r.time for r in rows})
    for r in rows:
        want.setdefault((r.y, r.x, dates[dates.index(r.time) // 3 * 3]), []).append(r.value)
    mean = lambda v: sum(v) / len(v) if v else None
    assert got == {k: pytest.approx(mean([x for x in v if x is not None])) if any(x is not None for x in v) else None for k, v in want.items()}


def test_bucketed_tables_meet_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stack = sinks.write_bucketed(cells(spark, dt.date(2001, 1, 1), range(5)), "stack_of_cells", 4)
        use = sinks.write_bucketed(spark.createDataFrame([(y, x, (y + x) % 3) for y in range(2) for x in range(3)], "y int, x int, cls int"), "use_of_cells", 4)
        df = SP.mask(stack, use, "cls", [0, 1])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        rows = df.collect()
        assert len(rows) == 30 and all(r.value is None for r in rows if (r.y + r.x) % 3 == 2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("stack_of_cells", "use_of_cells"):
            spark.sql(f"drop table if exists {t}")


# Bayesian averaging.
def members(spark, k, n=80, used=(0, 2), noise=0.3, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, k))
    y = 1 + x[:, list(used)].sum(axis=1) + noise * r.normal(size=n)
    rows = [("s", t, f"m{j:02d}", float(x[t, j]), float(y[t])) for t in range(n) for j in range(k)]
    return spark.createDataFrame(rows, "station string, date int, gcm string, value double, obs double"), x, y


def test_chains_find_the_posterior(spark):
    """As enumeration has it, within a few standard errors; the chains agree."""
    df, x, y = members(spark, 6, n=25, noise=2.0)
    post, agreement = E.posterior_by_chains(df, ["station"], chains=6, iterations=4000)
    got = {tuple(r.models): r.probability for r in post.collect()}
    exact = {tuple(f"m{j:02d}" for j, v in enumerate(m) if v): p for m, p in bayes.enumerate_models(x, y).items()}
    assert sum(got.values()) == pytest.approx(1) and max(abs(got.get(m, 0) - p) for m, p in exact.items()) < 0.03
    a = agreement.first()
    assert a.chains == 6 and a.rhat < 1.05 and a.ess > 400


def test_chains_of_many_members(spark):
    """Twenty members are beyond enumeration: those that made the series are in nearly every subset visited."""
    df, *_ = members(spark, 20, used=(3, 11, 17))
    post, agreement = E.posterior_by_chains(df, ["station"], chains=4, iterations=3000)
    share = {r.gcm: r.inclusion for r in E.inclusion(post, ["station"]).collect()}
    assert min(share[m] for m in ("m03", "m11", "m17")) > 0.95 and len(share) == 20 and min(share.values()) < 0.9 and agreement.first().rhat < 1.1


def test_predictive_interval(spark):
    """The mass between the bounds by Simpson's rule over the mixture's density, and by draws."""
    df, x, y = members(spark, 3, n=30, noise=1.0)
    rows = {r.date: r for r in E.predictive_interval(df, ["station"], mass=0.8).collect()}
    w, centres, widths, n = bayes.predictive_mixture(x, y, x)
    front = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
    draws = bayes.predictive_draws(x, y, x, 40_000, seed=1)
    for t in (0, 7, 29):
        at = np.linspace(rows[t].low, rows[t].high, 2001)
        d = (w[:, None] / widths[:, t, None] * front * (1 + ((at - centres[:, t, None]) / widths[:, t, None]) ** 2 / n) ** (-(n + 1) / 2)).sum(axis=0)
        assert (at[1] - at[0]) / 3 * (d[0] + d[-1] + 4 * d[1:-1:2].sum() + 2 * d[2:-1:2].sum()) == pytest.approx(0.8, abs=1e-9)
        assert np.quantile(draws[t], [0.1, 0.9]) == pytest.approx([rows[t].low, rows[t].high], abs=0.05) and rows[t].mean == pytest.approx(draws[t].mean(), abs=0.03)
    assert len(rows) == 30


@pytest.mark.parametrize("columns", [["a", "b"], ["a"]])
def test_joint_bounds_hold_no_group_in_a_task(spark, columns):
    """Keys may be null; rows are not gathered by key, and few bounds are broadcast."""
    rows = [("k", 1.0, 3.0), ("k", 2.0, None), ("k", None, 5.0), (None, 4.0, 8.0), (None, 6.0, 6.0), ("one", 7.0, 7.0)]
    df = spark.createDataFrame(rows, "model string, a double, b double")
    out = T.joint_min_max(df, ["model"], columns, inputs.cut)
    bounds = {"k": (1, 5), None: (4, 8), "one": (7, 7)} if len(columns) > 1 else {"k": (1, 2), None: (4, 6), "one": (7, 7)}

    def scaled(v, key):
        low, high = bounds[key]
        return None if v is None or low == high else (v - low) / (high - low)

    assert out.columns == df.columns
    wanted = [(k, scaled(a, k), scaled(b, k) if "b" in columns else b) for k, a, b in rows]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(wanted, key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan
