"""Polygons burned into grids: a quadtree cover for each polygon, equality joins, an exact test at boundaries only.

Polygons are a table. Each is covered by squares of a quadtree over all polygons: squares that no edge meets are wholly in it
or no part of the cover; at its finest level, some steps below its own extent, squares that an edge meets are its boundary.
Cells meet squares by an equality join on (level, column, row). In a whole square a cell is in the polygon; in a boundary
square its centre is tested against the rings. No cell meets a polygon that is not near it.

Defined results: rings count by the even-odd rule, so a ring in a ring is a hole; rings need not be closed. A ring of fewer
than three points has no area. Of the polygons that hold a centre the last one by `order` gives the value. Cells without a
place, and polygons without rings, take no part.

The last whole square over a cell is sure; only later polygons' boundary squares are tested there. So whole squares are
reduced to the last polygon of each before any join, and covers end where a square holds about one cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .spatial import inside

#: Levels of the quadtree, and how many of them a polygon's cover goes below the square of its own extent.
DEPTH, FINER = 24, 4
_SQUARES = pa.schema([("order", pa.int64()), ("__level", pa.int32()), ("__column", pa.int64()), ("__row", pa.int64()), ("whole", pa.bool_())])


def _edges(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(x0, y0, x1, y1) of all edges of rings of three points and more, and how many of them each polygon has."""
    inner = pc.list_flatten(rings)
    points = pc.list_flatten(inner)
    ring = pc.list_parent_indices(inner).to_numpy(zero_copy_only=False).astype(np.int64)
    p = np.stack([pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], 1)
    first = np.searchsorted(ring, np.arange(len(inner)))
    last = np.searchsorted(ring, np.arange(len(inner)), "right") - 1
    then = np.arange(len(p)) + 1
    then[last[last >= first]] = first[last >= first]
    keep = (last - first + 1 > 2)[ring]
    polygon = pc.list_parent_indices(rings).to_numpy(zero_copy_only=False).astype(np.int64)[ring[keep]]
    return np.hstack([p[keep], p[then[keep]]]), np.bincount(polygon, minlength=len(rings))


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... below each of counts, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


#: Squares times edges held at a time.
_HELD = 1 << 19


def _sorted_out(edges: np.ndarray, start: np.ndarray, count: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which squares an edge of their polygon (count of them from start) meets, and which centres are in it.

    A square is a little enlarged. An edge meets it if boxes overlap, and the corners are not all on one side.
    """
    met, held = np.zeros(len(x), bool), np.zeros(len(x), bool)
    ends, a = np.cumsum(count), 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _HELD, "right")))
        n = count[a:b]
        x0, y0, x1, y1 = edges[np.repeat(start[a:b], n) + _places(n)].T
        left, low, side = (np.repeat(v[a:b], n) for v in (x, y, size))
        near, firsts = side * 1e-9, np.cumsum(n) - n
        cx, cy = left + side / 2, low + side / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = ((y0 > cy) != (y1 > cy)) & (cx < (x1 - x0) * (cy - y0) / (y1 - y0) + x0)
        held[a:b] = np.add.reduceat(cross.astype(np.int64), firsts) % 2 == 1
        left, low = left - near, low - near
        right, high = left + side + 2 * near, low + side + 2 * near
        hit = (np.minimum(x0, x1) <= right) & (np.maximum(x0, x1) >= left) & (np.minimum(y0, y1) <= high) & (np.maximum(y0, y1) >= low)
        dx, dy = x1 - x0, y1 - y0
        sides = [dx * (v - y0) - dy * (u - x0) for u in (left, right) for v in (low, high)]
        hit &= (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)
        met[a:b] = np.logical_or.reduceat(hit, firsts)
        a = b
    return met, held


def covers(rings: pa.ListArray, x0: float, y0: float, extent: float, deepest: int = DEPTH) -> list[np.ndarray]:
    """polygon (its place), level, column, row, whole of the squares of many polygons, all of them a level at a time.

    A cover does not go below level `deepest`, unless the square of a polygon's own extent is there or below.
    """
    edges, count = _edges(rings)
    start, own = np.cumsum(count) - count, np.flatnonzero(count)
    found = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]]
    if len(own):
        least, most = np.minimum.reduceat(edges, start[own]), np.maximum.reduceat(edges, start[own])
        low_x, low_y = np.minimum(least[:, 0], least[:, 2]), np.minimum(least[:, 1], least[:, 3])
        high_x, high_y = np.maximum(most[:, 0], most[:, 2]), np.maximum(most[:, 1], most[:, 3])
        span = np.maximum(high_x - low_x, high_y - low_y)
        level = np.full(len(own), DEPTH)
        level[span > 0] = np.minimum(DEPTH, np.floor(np.log2(extent / span[span > 0])))
        last = np.minimum(DEPTH, np.maximum(level, np.minimum(level + FINER, deepest)))
        size = extent / 2.0**level
        c0, r0 = (np.floor((v - o) / size).astype(np.int64) - 1 for v, o in ((low_x, x0), (low_y, y0)))
        wide, tall = (np.floor((v - o) / size).astype(np.int64) + 2 - f for v, o, f in ((high_x, x0, c0), (high_y, y0, r0)))
        of = np.repeat(np.arange(len(own)), wide * tall)
        place, level = _places(wide * tall), level[of]
        columns, rows = c0[of] + place % wide[of], r0[of] + place // wide[of]
        while len(of):
            side = extent / 2.0**level
            met, held = _sorted_out(edges, start[own[of]], count[own[of]], x0 + columns * side, y0 + rows * side, side)
            out = held & ~met | met & (level == last[of])
            found.append([own[of[out]], level[out], columns[out], rows[out], ~met[out]])
            on = np.flatnonzero(met & (level < last[of]))
            of, level = np.repeat(of[on], 4), np.repeat(level[on] + 1, 4)
            columns, rows = (2 * columns[on, None] + [0, 1, 0, 1]).ravel(), (2 * rows[on, None] + [0, 0, 1, 1]).ravel()
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def cover(rings, x0: float, y0: float, extent: float) -> list[tuple[int, int, int, bool]]:
    """(level, column, row, whole) of the squares of a polygon, level by level."""
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    return list(zip(*(c.tolist() for c in covers(pa.array([rings], kind), x0, y0, extent)[1:]), strict=True))


def _holds(rings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for ring in rings:
        if len(ring) > 2:
            out ^= inside(x, y, np.array([(q["x"], q["y"]) for q in ring], float))
    return out


def rasterize(cells: DataFrame, polygons: DataFrame, lat: str = "lat", lon: str = "lon", name: str = "burned", cut=lambda df: df) -> DataFrame:
    """cells (y, x, lat, lon, others) with the value of the last polygon that holds their centre, else null.

    polygons: order long, value double, rings array<array<struct<x double, y double>>> (lon, lat). cut may write a table to
    the folder that driver and executors share and read it again, so that covers are made once.
    """
    polygons = polygons.select(F.col("order").cast("long").alias("order"), F.col("value").cast("double").alias("value"), "rings").where("rings is not null")
    points = polygons.select(F.explode(F.flatten("rings")).alias("p"))
    low_x, high_x, low_y, high_y = points.agg(F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
    if low_x is None:
        return cells.withColumn(name, F.lit(None).cast("double"))
    extent = max(high_x - low_x, high_y - low_y) or 1.0

    placed = cells.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon")).where(F.col("__lon").between(low_x, high_x) & F.col("__lat").between(low_y, high_y))
    n, wide, tall = placed.agg(F.count(F.lit(1)), F.max("__lon") - F.min("__lon"), F.max("__lat") - F.min("__lat")).first()
    if not n:
        return cells.withColumn(name, F.lit(None).cast("double"))
    apart = max(wide, tall) / math.sqrt(n) if min(wide, tall) == 0 else math.sqrt(wide * tall / n)  # a square of this side has a cell or so
    deepest = min(DEPTH, max(0, math.ceil(math.log2(extent / apart)))) if apart > 0 else 0

    def covered(batches):
        for batch in batches:
            of, *square = covers(batch.column("rings"), low_x, low_y, extent, deepest)
            yield pa.RecordBatch.from_arrays([batch.column("order").take(pa.array(of)), *(pa.array(c, f.type) for c, f in zip(square, list(_SQUARES)[1:], strict=True))], schema=_SQUARES)

    at_level = ["__level", "__column", "__row"]
    squares = cut(polygons.select("order", "rings").mapInArrow(covered, "order long, __level int, __column long, __row long, whole boolean"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    side = F.lit(float(extent)) / F.pow(F.lit(2.0), F.col("__level"))
    at = placed.withColumn("__level", levels)
    at = at.join(F.broadcast(squares.select("__level").distinct()), "__level", "left_semi")  # DEPTH + 1 levels at most
    at = at.withColumns({"__column": F.floor((F.col("__lon") - low_x) / side), "__row": F.floor((F.col("__lat") - low_y) / side)})
    lasts = squares.where("whole").groupBy(*at_level).agg(F.max("order").alias("order"))
    sure = at.join(lasts, at_level).groupBy("y", "x").agg(F.max("order").alias("__sure"))
    open_ = at.join(sure, ["y", "x"], "left")
    met = open_.join(squares.where(~F.col("whole")).drop("whole"), at_level).where("__sure is null or order > __sure")

    def tested(batches):
        for batch in batches:
            order, rings = batch.column("order").to_numpy(), batch.column("rings")
            x, y = (batch.column(c).to_numpy() for c in ("__lon", "__lat"))
            keep = np.zeros(len(order), bool)
            for o, first in zip(*np.unique(order, return_index=True), strict=True):  # a polygon's cells at once
                at = np.flatnonzero(order == o)
                keep[at] = _holds(rings[int(first)].as_py(), x[at], y[at])
            yield batch.select(["y", "x", "order"]).filter(pa.array(keep))

    # Spark takes the polygons for as small as their compressed source: they are merged, never broadcast.
    near = met.select("y", "x", "__lat", "__lon", "order").join(polygons.select("order", "rings").hint("merge"), "order")
    found = sure.select("y", "x", F.col("__sure").alias("order")).union(near.mapInArrow(tested, "y int, x int, order long"))
    last = found.groupBy("y", "x").agg(F.max("order").alias("order")).join(polygons.select("order", F.col("value").alias(name)).hint("merge"), "order").drop("order")
    return cells.join(last, ["y", "x"], "left")
