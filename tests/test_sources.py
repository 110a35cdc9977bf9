"""Sources, sinks, streams and plans on files made here."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.plans import inputs, pipelines
from isohyet.sources import rasters, sinks, tables
from isohyet.streaming import rolling


def test_station_list(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿Station,LAT,LONG,ELEVATION\nA1,30.5,75.25,-48.7\nB2,50.1,130.3,4800\n".encode())
    got = sorted(map(tuple, tables.stations(spark, str(tmp_path / "s.csv")).collect()))
    assert got == [("A1", 30.5, 75.25, -48.7), ("B2", 50.1, 130.3, 4800.0)]


def test_observations(spark, tmp_path):
    (tmp_path / "A1.csv").write_text("Date,PRE,RS\n2001-01-01,1.5,-99\n2001-01-02,20000,3\n2001-01-03,,4\n")
    rows = {(r.station, r.date.day, r["var"]): r.value for r in tables.observations(spark, str(tmp_path), ["PRE", "RS", "WIN"]).collect()}
    assert rows[("A1", 1, "PRE")] == 1.5 and rows[("A1", 1, "RS")] is None and rows[("A1", 2, "PRE")] is None and rows[("A1", 3, "RS")] == 4.0 and rows[("A1", 1, "WIN")] is None


def test_gauges(spark, tmp_path):
    (tmp_path / "PRE501.txt").write_text("20000228\n1.0\n-99\n2.5\n")
    (tmp_path / "TEM501.txt").write_text("20000228\r\n3.0,1.0\r\n4.0,-99\r\n")
    rows = {(r.station, str(r.date), r["var"]): r.value for r in tables.gauges(spark, str(tmp_path)).collect()}
    assert rows == {("501", "2000-02-28", "PRE"): 1.0, ("501", "2000-02-29", "PRE"): None, ("501", "2000-03-01", "PRE"): 2.5, ("501", "2000-02-28", "MAXTEM"): 3.0, ("501", "2000-02-28", "MINTEM"): 1.0, ("501", "2000-02-29", "MAXTEM"): 4.0, ("501", "2000-02-29", "MINTEM"): None}


def cube(calendar="noleap", n=400):
    lat, lon, lev, time = np.array([10.0, 12.0]), np.array([20.0, 22.0, 24.0]), np.array([85000.0, 50000.0]), np.arange(n, dtype=float)
    a = np.arange(n * 2 * 2 * 3, dtype=float).reshape(n, 2, 2, 3)
    a[0, 0, 0, 0] = 1e20
    return rasters.write_netcdf({"lat": (["lat"], lat, {}), "lon": (["lon"], lon, {}), "plev": (["plev"], lev, {}), "time": (["time"], time, {"units": "days since 2000-01-01", "calendar": calendar}), "ta": (["time", "plev", "lat", "lon"], a, {})}), a


@pytest.mark.parametrize("calendar,last", [("noleap", dt.date(2001, 2, 4)), ("standard", dt.date(2001, 2, 3))])
def test_netcdf(spark, tmp_path, calendar, last):
    raw, a = cube(calendar)
    (tmp_path / "ta_day_M_historical_r1_gn_20000101-20010204.nc").write_bytes(raw)
    (tmp_path / "bad.nc").write_bytes(b"not a file")
    assert np.array_equal(rasters.read_netcdf(raw)["variables"]["ta"]["values"], a)
    checked = {r.path.rsplit("/", 1)[1]: r.ok for r in rasters.check(spark, str(tmp_path)).collect()}
    assert checked == {"ta_day_M_historical_r1_gn_20000101-20010204.nc": True, "bad.nc": False}
    (tmp_path / "bad.nc").unlink()
    g = rasters.grids(spark, str(tmp_path), "ta")
    top = g.agg(F.max("date").alias("d"), F.count("*").alias("n"), F.count_if((F.month("date") == 2) & (F.dayofmonth("date") == 29)).alias("leap")).first()
    assert (top.d, top.n, top.leap > 0) == (last, 400 * 2 * 6, calendar == "standard")
    one = g.where("level = 50000 and y = 1 and x = 2 and date = '2000-01-02'").first()
    assert (one.value, one.lat, one.lon) == (a[1, 1, 1, 2], 12.0, 24.0)
    listed = tables.catalogue(tables.files(spark, str(tmp_path), ".nc")).collect()
    assert [(r.variable, r.table, r.source, r.experiment, r.start, r.end) for r in listed] == [("ta", "day", "M", "historical", "20000101", "20010204")]
    assert tables.catalogue(tables.files(spark, str(tmp_path), ".nc"), from_year=2005).count() == 0
    dates = spark.range(1).select(F.explode(tables.period_dates("20000227", "20000302", False, leap=False)).alias("d")).collect()
    assert [str(r.d)[5:] for r in dates] == ["02-27", "02-28", "03-01", "03-02"]


def test_tiff(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    raw = rasters.write_tiff(a, np.array([30.0, 29.5, 29.0]), np.array([70.0, 70.5, 71.0, 71.5]))
    back, info = rasters.read_tiff(raw)
    assert np.array_equal(back, a) and info["pixel"] == (0.5, 0.5) and info["origin"] == (69.75, 30.25)
    with pytest.raises(ValueError, match="band 2"):
        rasters.read_tiff(raw, 2)
    (tmp_path / "ndvi_20010117.tif").write_bytes(raw)
    got = {(r.y, r.x): r for r in rasters.tiff_stack(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and got[(2, 3)].value == 11 and str(got[(0, 0)].time) == "2001-01-17" and (got[(2, 3)].lat, got[(2, 3)].lon) == (29.0, 71.5)
    grid = spark.createDataFrame([("b", int(y), int(x), 30.0 - 0.5 * y, 70 + 0.5 * x, float(a[y, x])) for y in range(3) for x in range(4)], "band string, y int, x int, lat double, lon double, value double")
    assert bytes(sinks.tiffs(grid, ["band"]).first().content) == raw
    sinks.write_grid(grid, str(tmp_path / "g"), ["band"])
    assert spark.read.parquet(str(tmp_path / "g")).count() == 12


def test_weather_files(spark, tmp_path):
    rows = [("s1", dt.date(2001, 1, k), 0.25 * k, 20.0 + k, 10.0, 0.5) for k in (2, 1, 3)]
    df = spark.createDataFrame(rows, "station string, date date, PRE double, MAXTEM double, MINTEM double, RHU double")
    sinks.write_weather(df, str(tmp_path / "w"))
    lines = lambda f: "".join(p.read_text() for p in sorted((tmp_path / "w" / f"file={f}").glob("part-*"))).split()
    assert lines("TEMs1") == ["20010101", "21.0,10.0", "22.0,10.0", "23.0,10.0"] and lines("RHUs1")[1] == "0.500" and lines("PREs1")[0] == "20010101"


def test_windowed_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = rolling.windowed(stream, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("windowed_out").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("windowed_out").collect()}
    want = {(r.start, r.event_type): r.n for r in e.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("value").alias("n")).collect()}
    assert got == want


def test_filtered_stream(spark, tmp_path):
    e = spark.createDataFrame([(k, dt.datetime(2001, 1, 1 + i), float(k + (i % 2))) for k in (1, 2) for i in range(20)], "key long, ts timestamp, value double")
    e.where("dayofmonth(ts) <= 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    e.where("dayofmonth(ts) > 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = rolling.filtered(stream, "key").writeStream.outputMode("append").format("memory").queryName("filtered_out").start()
    q.processAllAvailable()
    q.stop()
    last = {r.key: r.level for r in spark.table("filtered_out").where("ts = timestamp'2001-01-20'").collect()}
    assert spark.table("filtered_out").count() == 40 and all(abs(last[k] - k - 0.5) < 0.4 for k in (1, 2))


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    d = inputs.daily(spark, sf)
    assert pipelines.station_trends(d, ["var"]).count() == d.select("var").distinct().count()
    days = spark.range(92).select(F.date_add(F.make_date(F.lit(2001) + F.floor(F.col("id") / 23).cast("int"), F.lit(1), F.lit(1)), (F.col("id") % 23 * 16).cast("int")).alias("time"))
    cube = spark.range(3).select(F.lit(0).alias("y"), F.col("id").cast("int").alias("x")).crossJoin(days).withColumn("value", 0.4 + 0.1 * F.sin(F.dayofyear("time") / 58.0) + F.pmod(F.xxhash64("x", "time"), F.lit(100)) / 1000.0)
    for bayesian in (False, True):
        out = pipelines.pixel_resilience(cube, 24, bayesian=bayesian).collect()
        assert len(out) == 3 and all(r.z is not None for r in out)
    months = spark.range(1).select(F.explode(F.sequence(F.lit("1990-01-01").cast("date"), F.lit("2009-12-01").cast("date"), F.expr("interval 1 month"))).alias("date"))
    p = months.withColumns({"gcm": F.lit("g"), "station": F.lit("s"), "a": F.sin(F.month("date") * 0.52), "b": F.pmod(F.xxhash64("date"), F.lit(97)) / 97.0})
    y = months.withColumns({"station": F.lit("s"), "value": 3 + 2 * F.sin(F.month("date") * 0.52)})
    c, _ = pipelines.calibrate(p, y, ["gcm", "station"], ["a", "b"], 1)
    assert {r.predictor for r in c.collect()} == {"", "a"}


def test_the_rest_stands_without_training_data_operators():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "isohyet"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            for n in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
                assert not any("llm" in x for x in names)
