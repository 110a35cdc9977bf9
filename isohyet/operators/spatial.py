"""Grids as long tables (y, x, bands): overlay, zones, nearest cells, resampling, Thiessen means."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def linspace(n: int, low: float, high: float, name: str, spark) -> DataFrame:
    """n evenly spaced coordinates with their number."""
    step = (high - low) / max(1, n - 1)
    return spark.range(n).select(F.col("id").cast("int").alias(f"{name}_index"), (F.lit(low) + F.col("id") * F.lit(step)).alias(name))


def overlay(grids: list[DataFrame], on: tuple[str, str] = ("y", "x")) -> DataFrame:
    """Bands of several grids on the cells that all have."""
    out = grids[0]
    for g in grids[1:]:
        out = out.join(g, list(on))
    return out


def zonal(values: DataFrame, zones: DataFrame, zone: str, aggregates: list[Column], on: tuple[str, str] = ("y", "x")) -> DataFrame:
    return values.join(zones, list(on)).groupBy(zone).agg(*aggregates)


def mask(cube: DataFrame, classes: DataFrame, cls: str, wanted: list[int], value: str = "value", on: tuple[str, str] = ("y", "x")) -> DataFrame:
    """Cells of other classes lose their values, 0 counts as missing."""
    joined = cube.join(classes.select(*on, cls), list(on), "left")
    keep = F.col(cls).isin(*wanted) & (F.col(value) != 0)
    return joined.withColumn(value, F.when(keep, F.col(value))).drop(cls)


def nearest_cell(points: DataFrame, cells: DataFrame, point: str = "station", lat: str = "lat", lon: str = "lon", tile: float = 2.0, usable: Column | None = None) -> DataFrame:
    """The nearest cell, by planar degrees, of each point: its y, x and distance. Cells that are not `usable` (all missing) do not count.

    Cells and points meet in tiles of `tile` degrees: a point looks into its tile and the eight around it. Where the
    nearest found is farther than a tile, or none is, the point is looked up again in tiles four times as wide.
    """
    cells = (cells.where(usable) if usable is not None else cells).select("y", "x", F.col(lat).alias("c_lat"), F.col(lon).alias("c_lon"))
    left, found, size = points.select(point, lat, lon).where(f"{lat} is not null and {lon} is not null"), None, tile
    while True:
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        p = left.withColumn("__dy", around).withColumn("__dx", around)
        p = p.withColumns({"ty": F.floor(F.col(lat) / size) + F.col("__dy"), "tx": F.floor(F.col(lon) / size) + F.col("__dx")}).drop("__dy", "__dx")
        c = cells.withColumns({"ty": F.floor(F.col("c_lat") / size), "tx": F.floor(F.col("c_lon") / size)})
        d = F.sqrt(F.pow(F.col(lat) - F.col("c_lat"), F.lit(2.0)) + F.pow(F.col(lon) - F.col("c_lon"), F.lit(2.0)))
        near = p.join(c, ["ty", "tx"]).groupBy(point).agg(F.min(F.struct(d.alias("distance"), "y", "x")).alias("n")).select(point, "n.*")
        last = size > 720
        done = near if last else near.where(F.col("distance") <= size)
        found = done if found is None else found.unionByName(done)
        if last:
            return found.select(point, "y", "x", "distance")
        left = left.join(done.select(point), point, "left_anti")
        if left.isEmpty():
            return found.select(point, "y", "x", "distance")
        size *= 4


def target_grid(rows: int, cols: int, spark) -> DataFrame:
    """All (y, x) of a grid; as many rows as the raster has cells."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("y"), (F.col("id") % cols).cast("int").alias("x"))


def _kernel(method: str, t: Column) -> Column:
    a = F.abs(t)
    if method == "bilinear":
        return F.greatest(1 - a, F.lit(0.0))
    # Cubic convolution with a = -0.5.
    return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)


def resample(grid: DataFrame, shape: tuple[int, int], new_shape: tuple[int, int], bands: list[str], method: str = "nearest") -> DataFrame:
    """grid (y, x, bands) on a new number of rows and columns. nearest, bilinear, or cubic over 4 x 4 cells; edges are repeated.

    Each target cell names its source cells and their weights, and meets them by an equality join.
    """
    (h, w), (nh, nw) = shape, new_shape
    target = target_grid(nh, nw, grid.sparkSession)
    if method == "nearest":
        at = target.withColumns({"sy": F.least(F.floor((F.col("y") + 0.5) * h / nh), F.lit(h - 1)).cast("int"), "sx": F.least(F.floor((F.col("x") + 0.5) * w / nw), F.lit(w - 1)).cast("int")})
        return at.join(grid.select(F.col("y").alias("sy"), F.col("x").alias("sx"), *bands), ["sy", "sx"]).select("y", "x", *bands)
    reach = range(0, 2) if method == "bilinear" else range(-1, 3)
    offsets = lambda: F.explode(F.array(*[F.lit(k) for k in reach]))
    at = target.withColumns({"py": (F.col("y") + 0.5) * h / nh - 0.5, "px": (F.col("x") + 0.5) * w / nw - 0.5})
    at = at.withColumn("oy", offsets()).withColumn("ox", offsets())
    at = at.withColumns({"cy": F.floor("py") + F.col("oy"), "cx": F.floor("px") + F.col("ox")})
    at = at.withColumn("weight", _kernel(method, F.col("py") - F.col("cy")) * _kernel(method, F.col("px") - F.col("cx"))).where("weight <> 0")
    inside = lambda c, n: F.greatest(F.least(F.col(c), F.lit(n - 1)), F.lit(0)).cast("int")
    at = at.withColumns({"sy": inside("cy", h), "sx": inside("cx", w)})
    joined = at.join(grid.select(F.col("y").alias("sy"), F.col("x").alias("sx"), *bands), ["sy", "sx"])
    return joined.groupBy("y", "x").agg(*[F.try_divide(F.sum(F.col(b) * F.col("weight")), F.sum(F.when(F.col(b).isNotNull(), F.col("weight")))).alias(b) for b in bands])


def size_for(shape: tuple[int, int], resolution: float, new_resolution: float) -> tuple[int, int]:
    """Rows and columns of a grid at another resolution."""
    return tuple(max(1, math.ceil(n * resolution / new_resolution)) for n in shape)


def inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether points lie in a polygon, by the parity of edges to their right."""
    x0, y0 = ring[:, 0], ring[:, 1]
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
    out = np.zeros(len(x), bool)
    for a, b, c, d in zip(x0, y0, x1, y1, strict=True):
        cross = (b > y) != (d > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= cross & (x < (c - a) * (y - b) / (d - b) + a)
    return out


def clip(poly: list, a: np.ndarray, b: np.ndarray) -> list:
    """The part of a polygon nearer to a than to b."""
    middle, normal, out = (a + b) / 2, b - a, []
    side = [float(np.dot(np.asarray(p) - middle, normal)) for p in poly]
    for k in range(len(poly)):
        p, q, s, t = np.asarray(poly[k]), np.asarray(poly[(k + 1) % len(poly)]), side[k], side[(k + 1) % len(poly)]
        if s <= 0:
            out.append(p)
        if s * t < 0:
            out.append(p + (q - p) * s / (s - t))
    return out


def area_km2(poly: list) -> float:
    """Area of a small polygon of (lon, lat), on the cylinder of its mean latitude."""
    if len(poly) < 3:
        return 0.0
    p = np.asarray(poly, float)
    k = 111.32 * np.cos(np.radians(p[:, 1].mean())), 110.574
    x, y = p[:, 0] * k[0], p[:, 1] * k[1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def thiessen_weights(stations: pd.DataFrame, boundary: list[tuple[float, float]]) -> pd.DataFrame:
    """Share of the boundary's area that is nearest to each station (columns station, lat, lon)."""
    at = stations[["lon", "lat"]].to_numpy(float)
    areas = []
    for i in range(len(at)):
        poly = [np.asarray(p, float) for p in boundary]
        for j in range(len(at)):
            if i != j and poly and not (at[i] == at[j]).all():
                poly = clip(poly, at[i], at[j])
        areas.append(area_km2(poly))
    total = sum(areas) or 1.0
    return pd.DataFrame({"station": stations["station"], "area": areas, "weight": [x / total for x in areas]})


def thiessen_mean(values: DataFrame, stations: DataFrame, boundary: list[tuple[float, float]], time: str = "date", value: str = "value") -> DataFrame:
    """Area-weighted mean of the stations at each time. The station list is a dimension (hundreds of rows); its cells are clipped in one task."""
    weights = stations.select("station", "lat", "lon").groupBy().applyInPandas(lambda p: thiessen_weights(p, boundary), "station string, area double, weight double")
    joined = values.withColumn("station", F.col("station").cast("string")).join(F.broadcast(weights), "station").where(F.col(value).isNotNull())
    return joined.groupBy(time).agg(F.try_divide(F.sum(F.col(value) * F.col("weight")), F.sum("weight")).alias("mean"))


def spherical(h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    t = np.minimum(h / reach, 1.0)
    return np.where(h > 0, nugget + (sill - nugget) * (1.5 * t - 0.5 * t**3), 0.0)
