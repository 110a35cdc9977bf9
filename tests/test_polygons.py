"""Polygons as a table against a plain test of every cell and every polygon."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isohyet.operators import polygons as PG, spatial as SP

CELLS = [(y, x, y * 0.7 - 3, x * 0.9 - 4) for y in range(24) for x in range(21)]
POLYGONS = "order long, value double, rings array<array<struct<x: double, y: double>>>, y int"


def star(r, cx, cy, size, points=9):
    turn = np.sort(r.random(points)) * 2 * np.pi
    return [(cx + size * (0.4 + 0.6 * u) * np.cos(t), cy + size * (0.4 + 0.6 * u) * np.sin(t)) for t, u in zip(turn, r.random(points), strict=True)]


def burned(spark, polygons):
    cells = spark.createDataFrame([*CELLS, (99, 0, None, 1.0), (99, 1, 1.0, None)], "y int, x int, lat double, lon double").withColumn("value", F.lit("kept"))
    rows = [(o, v, None if rings is None else [[{"x": float(a), "y": float(b)} for a, b in ring] for ring in rings], 5) for o, v, rings in polygons]
    out = PG.rasterize(cells, spark.createDataFrame(rows, POLYGONS).repartition(3)).collect()
    assert len(out) == len(CELLS) + 2 and all(r.value == "kept" for r in out) and all(r.burned is None for r in out if r.y == 99)
    return {(r.y, r.x): r.burned for r in out if r.y < 99}


def plain(polygons):
    got = dict.fromkeys((y, x) for y, x, *_ in CELLS)
    lat, lon = (np.array([c[k] for c in CELLS]) for k in (2, 3))
    for _, value, rings in sorted(polygons, key=lambda p: p[0]):
        held = np.zeros(len(CELLS), bool)
        for ring in rings or []:
            if len(ring) > 2:
                held ^= SP.inside(lon, lat, np.array(ring, float))
        got |= {CELLS[k][:2]: value for k in np.flatnonzero(held)}
    return got


@pytest.mark.parametrize("size", [0.3, 2.0, 15.0])
def test_thousands_of_polygons(spark, size):
    r = np.random.default_rng(int(size * 10))
    polygons = []
    for k in range(1500 if size < 1 else 60):
        cx, cy = r.uniform(-6, 16), r.uniform(-5, 15)
        rings = [star(r, cx, cy, size)]
        if k % 3 == 0:
            rings.append(star(r, cx, cy, size / 3, 5))
        polygons.append((k, float(k % 17), rings))
    wanted = plain(polygons)
    assert burned(spark, polygons) == wanted and len(set(wanted.values())) > 3


def test_odd_polygons(spark):
    """Closed rings, holes, islands in holes, lines, points, none, and squares on the edges of the tree."""
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    polygons = [
        (1, 1.0, [square(-3, 9), square(-1, 7), square(1, 5)]), (2, 2.0, [[*square(10.1, 12.1), (10.1, 10.1)]]), (3, 3.0, [[(0, 0), (5, 5)]]), (4, 4.0, [[(2.0, 2.0)]]), (5, 5.0, []),
        (6, 6.0, None), (7, 7.0, [[(0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]]), (8, 8.0, [[(-1.0, 3.1), (12.0, 3.2), (12.0, 3.3)]]),
    ]
    assert burned(spark, polygons) == plain(polygons)


def test_no_polygons(spark):
    assert set(burned(spark, [(1, 1.0, None)]).values()) == {None}


def test_squares_cover_what_they_say():
    """Whole squares are in the polygon, and what no square covers is not; few squares, whatever the polygon's size."""
    r = np.random.default_rng(3)
    for size in (0.001, 1.0, 40.0):
        ring = [{"x": a, "y": b} for a, b in star(r, 20, 30, size)]
        squares = PG.cover([ring], 0.0, 0.0, 100.0)
        assert 0 < len(squares) < 3000
        for x, y in np.c_[r.uniform(20 - size, 20 + size, 400), r.uniform(30 - size, 30 + size, 400)]:
            held = PG._holds([ring], np.array([x]), np.array([y]))[0]
            of = {whole for k, c, w, whole in squares if np.floor(x / (100 / 2**k)) == c and np.floor(y / (100 / 2**k)) == w}
            assert of <= {False} or (of == {True} and held)
            assert of or not held


def test_cells_meet_squares_by_equality(spark):
    cells = spark.createDataFrame(CELLS, "y int, x int, lat double, lon double")
    ring = [{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": 0.0}, {"x": 0.0, "y": 5.0}]
    df = PG.rasterize(cells, spark.createDataFrame([(1, 1.0, [ring], 0)], POLYGONS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_covers_end_at_the_cells(spark):
    """Many polygons over few cells: squares below the cells' spacing are not made, and the last polygon still counts."""
    polygons = [(k, float(k), [[(x - r, y), (x, y - r), (x + r, y), (x, y + r)] for r in (size, size / 2)]) for k in range(2000) for x, y, size in [(k * 73 % 180 / 10 - 4 + 0.0371, k * 37 % 170 / 10 - 3 + 0.0173, 0.5 + k % 25 / 5)]]
    few = [c for c in CELLS if c[0] % 3 == c[1] % 3 == 0]
    cells = spark.createDataFrame(few, "y int, x int, lat double, lon double")
    rows = [(o, v, [[{"x": a, "y": b} for a, b in ring] for ring in rings], 5) for o, v, rings in polygons]
    made, wanted = [], plain(polygons)
    out = PG.rasterize(cells, spark.createDataFrame(rows, POLYGONS), cut=lambda df: made.append(df.count()) or df).collect()
    assert {(r.y, r.x): r.burned for r in out} == {at: v for at, v in wanted.items() if at[0] % 3 == at[1] % 3 == 0}
    assert made[0] < 50 * len(polygons)


def test_many_covers_at_once():
    """A batch's covers are those of its polygons one by one."""
    r = np.random.default_rng(5)
    rings = [[[{"x": a, "y": b} for a, b in star(r, 20, 30, 10.0**k, 3 + k)]] for k in range(-2, 2)] + [[], [[{"x": 1.0, "y": 1.0}]]]
    of, *squares = PG.covers(pa.array(rings), 0.0, 0.0, 100.0)
    for k, ring in enumerate(rings):
        assert list(zip(*(c[of == k].tolist() for c in squares), strict=True)) == PG.cover(ring, 0.0, 0.0, 100.0)
