"""Ordinary kriging from each cell's nearest stations, for any number of stations and cells.

A key's variogram is fitted on binned semivariances of all its pairs: stations are dealt in blocks, each pair of blocks sends
its bins' sums. Cells find their k nearest stations in tiles: a tile's cells meet the stations of it and the eight around by
equality joins, in parts where these are many, and each part sends every cell's k best. A cell is done when its k-th station
is no farther than the tiles that were looked into reach; what is left is looked up again in tiles twice as wide. Then each
cell has a system of its k stations, solved a batch at a time.

Defined results: stations without a value, a place or a key take no part; of those at one place the mean counts. A key with
fewer than k stations uses all. Values below 0 become 0. With under three stations, or equal values, the estimate is the
mean of the k nearest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .spatial import spherical

#: Stations of a block, cells of a task, stations of a part, tile-wide factor between rounds.
BLOCK, CELLS, PART, WIDER = 1024, 4096, 20_000, 2.0
LAGS = 6


def variograms(stations: DataFrame, keys: list[str], lags: int = LAGS, block: int = BLOCK) -> DataFrame:
    """stations: keys, lon, lat, z. Nugget, sill and reach of each key's spherical variogram, as array model (0, 0, 1 without one)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stations.schema if f.name in keys)
    stats = stations.groupBy(*keys).agg(F.sqrt(F.pow(F.max("lon") - F.min("lon"), F.lit(2)) + F.pow(F.max("lat") - F.min("lat"), F.lit(2))).alias("__far"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__blocks"))
    rows = stations.join(stats, keys).withColumn("__b", F.pmod(F.xxhash64("lon", "lat"), F.col("__blocks")).cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    rows = rows.withColumns({"__i": F.least("__b", "__o"), "__j": F.greatest("__b", "__o")})

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__b", "lon", "lat"])
        far, first = pdf["__far"].iloc[0], (pdf["__b"] == pdf["__i"].iloc[0]).to_numpy()
        xy, z = pdf[["lon", "lat"]].to_numpy(float), pdf["z"].to_numpy(float)
        one, two = (first, ~first) if not first.all() else (first, first)
        if not one.any() or not two.any():
            return pd.DataFrame(columns=[*keys, "lag", "n", "h", "g"])
        h = np.sqrt(((xy[one][:, None] - xy[two]) ** 2).sum(2))
        g = 0.5 * (z[one][:, None] - z[two]) ** 2
        at = np.triu_indices(len(h), 1) if first.all() else np.indices(h.shape).reshape(2, -1)
        h, g = h[tuple(at)], g[tuple(at)]
        lag = np.clip((h / max(far, 1e-300) * lags).astype(int), 0, lags - 1)
        n = np.bincount(lag, minlength=lags)
        out = pd.DataFrame({"lag": np.arange(lags), "n": n, "h": np.bincount(lag, h, lags), "g": np.bincount(lag, g, lags)})[n > 0]
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "lag", "n", "h", "g"]]

    sums = rows.groupBy(*keys, "__i", "__j").applyInPandas(bins, f"{kinds}, lag int, n long, h double, g double")
    sums = sums.groupBy(*keys, "lag").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "model": np.array(fitted((pdf["h"] / pdf["n"]).to_numpy(float), (pdf["g"] / pdf["n"]).to_numpy(float), int(pdf["n"].sum())))}])

    models = sums.groupBy(*keys).applyInPandas(fit, f"{kinds}, model array<double>")
    none = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return stats.select(*keys).join(models, keys, "left").select(*keys, F.coalesce("model", none).alias("model"))


def fitted(mid: np.ndarray, semi: np.ndarray, pairs: int) -> tuple[float, float, float]:
    """Nugget, sill and reach by least squares over a grid of reaches; (0, 0, 1) for under three pairs or equal values."""
    if pairs < 3 or not semi.max() > 0:
        return 0.0, 0.0, 1.0
    best = (np.inf, 0.0, semi.max(), mid.max() + 1e-9)
    for reach in np.linspace(mid.min() + 1e-9, 1.5 * mid.max() + 1e-9, 40):
        basis = np.stack([np.ones_like(mid), spherical(mid, 0.0, 1.0, reach)], axis=1)
        nugget, part = np.linalg.lstsq(basis, semi, rcond=None)[0]
        nugget, part = max(nugget, 0.0), max(part, 1e-12)
        loss = ((basis @ [nugget, part] - semi) ** 2).sum()
        if loss < best[0]:
            best = (loss, nugget, nugget + part, reach)
    return best[1:]


def solve(near: np.ndarray, z: np.ndarray, distance: np.ndarray, model: tuple[float, float, float]) -> np.ndarray:
    """Estimates of m points from k stations each: near (m, k, 2), z (m, k), distance (m, k)."""
    m, k = z.shape
    if k < 3 or not model[1] > 0:
        return z.mean(axis=1)
    a = np.ones((m, k + 1, k + 1))
    a[:, :k, :k] = spherical(np.sqrt(((near[:, :, None] - near[:, None]) ** 2).sum(3)), *model)
    a[:, k, k] = 0
    b = np.ones((m, k + 1))
    b[:, :k] = spherical(distance, *model)
    try:
        w = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:  # a singular system among them
        w = np.einsum("mij,mj->mi", np.linalg.pinv(a), b)
    return (w[:, :k] * z).sum(axis=1)


_FOUND = "y int, x int, lat double, lon double, d array<double>, sx array<double>, sy array<double>, sz array<double>"


def _part(k: int, keys: list[str]):
    """Each cell's k nearest stations of a part."""

    def run(cells: pd.DataFrame, stations: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame(columns=[*keys, "__ty", "__tx", "__sub", *(c.split()[0] for c in _FOUND.split(", "))])
        stations = stations.sort_values(["slon", "slat"])
        at, z = stations[["slon", "slat"]].to_numpy(float), stations["z"].to_numpy(float)
        here = cells[["lon", "lat"]].to_numpy(float)
        out = {c: [] for c in ("d", "sx", "sy", "sz")}
        step = max(1, (1 << 21) // max(1, len(at)))
        for a in range(0, len(here), step):
            d = np.sqrt(((here[a : a + step, None] - at) ** 2).sum(2))
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            for c, v in (("d", np.take_along_axis(d, order, 1)), ("sx", at[:, 0][order]), ("sy", at[:, 1][order]), ("sz", z[order])):
                out[c] += list(v)
        return cells[[*keys, "__ty", "__tx", "__sub", "y", "x", "lat", "lon"]].assign(**out)

    return run


def _estimate(k: int, keys: list[str], size: float, last: bool):
    """Parts put together, cells solved that are done; null for the others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = tuple(pdf["model"].iloc[0])
        rows, done = {}, {}
        for r in pdf.itertuples(index=False):
            got = rows.setdefault((r.y, r.x), [r.lat, r.lon, []])
            got[2] += zip(r.d, r.sx, r.sy, r.sz, strict=True)
        for c, (lat, lon, found) in rows.items():
            found = sorted(found)[:k]
            ty, tx = math.floor(lat / size), math.floor(lon / size)
            reach = min(lat - (ty - 1) * size, (ty + 2) * size - lat, lon - (tx - 1) * size, (tx + 2) * size - lon)
            if found and (last or len(found) == k and found[-1][0] <= reach):
                done.setdefault(len(found), []).append((c, found))
        estimates = dict.fromkeys(rows)
        for group in done.values():
            f = np.array([x for _, x in group])
            for (c, _), v in zip(group, solve(f[:, :, 1:3], f[:, :, 3], f[:, :, 0], model), strict=True):
                estimates[c] = max(float(v), 0.0)
        out = pd.DataFrame([(*c, *rows[c][:2], v) for c, v in estimates.items()], columns=["y", "x", "lat", "lon", "estimate"])
        return out.assign(**{n: pdf[n].iloc[0] for n in keys})[[*keys, "y", "x", "lat", "lon", "estimate"]]

    return run


def ordinary_kriging(stations: DataFrame, keys: list[str], grid: DataFrame, cut, value: str = "value", k: int = 12, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Values of stations (keys such as a date, lat, lon, value) on a grid (y, x, lat, lon) for each key.

    cut writes a table to the folder that driver and executors share and reads it again: rounds look at what is left.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stations.schema if f.name in keys)
    usable = stations.where(" and ".join(f"{c} is not null" for c in [*keys, "lat", "lon", value]))
    known = cut(usable.groupBy(*keys, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).agg(F.avg(value).alias("z")))
    models = cut(variograms(known, keys, block=block))
    grid = grid.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    ends = [f(c) for c in ("lat", "lon") for f in (F.min, F.max)]
    mine, theirs = known.agg(*ends, F.countDistinct("lon", "lat")).first(), grid.agg(*ends).first()
    names = [*keys, "y", "x", "estimate"]
    if mine[0] is None or theirs[0] is None:
        return known.select(*keys, F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("estimate")).limit(0)
    extent = max(max(mine[c + 1], theirs[c + 1]) - min(mine[c], theirs[c]) for c in (0, 2)) or 1.0
    size, done = extent / max(1.0, math.sqrt(mine[4] / k)), None
    # The result has every key's whole grid: each key meets all cells, and only cells that are not done go on.
    left = grid.crossJoin(models.select(*keys))
    while True:
        last = size >= extent
        tile = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        cells = left.withColumns({"__ty": tile("lat"), "__tx": tile("lon")})
        tiles = cells.groupBy(*keys, "__ty", "__tx").agg(F.ceil(F.count(F.lit(1)) / CELLS).cast("int").alias("__subs"))
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        placed = known.select(*keys, F.col("lon").alias("slon"), F.col("lat").alias("slat"), "z").withColumns({"__ty": tile("slat"), "__tx": tile("slon")})
        spread = placed.withColumn("__dy", around).withColumn("__dx", around).withColumns({"__ty": F.col("__ty") + F.col("__dy"), "__tx": F.col("__tx") + F.col("__dx")}).drop("__dy", "__dx")
        parts = spread.groupBy(*keys, "__ty", "__tx").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("__parts"))
        tiles = cut(tiles.join(parts, [*keys, "__ty", "__tx"], "left").withColumn("__parts", F.coalesce("__parts", F.lit(1))))
        at = [*keys, "__ty", "__tx"]
        mine_ = cells.join(tiles, at).withColumn("__sub", F.pmod(F.xxhash64("y", "x"), F.col("__subs")).cast("int")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        asked = spread.join(tiles.toDF(*tiles.columns), at).withColumn("__part", F.pmod(F.xxhash64("slon", "slat"), F.col("__parts")).cast("int")).withColumn("__sub", F.explode(F.sequence(F.lit(0), F.col("__subs") - 1)))
        by = [*at, "__sub", "__part"]
        found = mine_.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(_part(k, keys), f"{kinds}, __ty long, __tx long, __sub int, {_FOUND}")
        solved = found.join(models, keys).groupBy(*at, "__sub").applyInPandas(_estimate(k, keys, size, last), f"{kinds}, y int, x int, lat double, lon double, estimate double")
        solved = cut(solved)
        ready = solved.where("estimate is not null").select(*names)
        done = ready if done is None else done.unionByName(ready)
        left = solved.where("estimate is null").drop("estimate")
        if last or left.isEmpty():
            return done
        size *= WIDER
