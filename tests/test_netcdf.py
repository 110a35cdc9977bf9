"""The NetCDF data source: layouts, calendars, packing, pushed filters, pruned columns, refusals."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.sources import netcdf

LAT, LON, LEVELS = np.array([10.0, 12.0]), np.array([20.0, 22.0, 24.0]), np.array([850.0, 500.0])
TIME = {"units": "days since 2000-02-27", "calendar": "noleap"}


def cube(n=40):
    a = np.arange(n * 12, dtype=float).reshape(n, 2, 2, 3)
    a[0, 0, 0, 0] = 1e20
    return a


def variables(a, dims=("time", "plev", "lat", "lon"), time=TIME, attrs=None):
    a_ = np.transpose(a, [("time", "plev", "lat", "lon").index(d) for d in dims])
    return {
        "lat": (["lat"], LAT, {}), "lon": (["lon"], LON, {}), "plev": (["plev"], LEVELS, {"units": "hPa"}), "time": (["time"], np.arange(len(a), dtype=float), time),
        "ta": (list(dims), a_, {"_FillValue": 1e20, **(attrs or {})}), "ps": (["time", "lat", "lon"], a[:, 0] + 0.5, {}),
    }


def read(spark, path, **options):
    netcdf.register(spark)
    return spark.read.format("netcdf").options(**options).load(str(path))


@pytest.mark.parametrize("version,record", list(itertools.product((1, 2, 5), (None, "time"))))
def test_layouts(spark, tmp_path, version, record):
    """Fixed and record variables of each version, in slabs of any length."""
    a = cube()
    raw = netcdf.write_netcdf(variables(a), record, version)
    assert raw[:4] == b"CDF" + bytes([version]) and np.array_equal(netcdf.read_netcdf(raw)["variables"]["ta"]["values"], a)
    (tmp_path / "x.nc").write_bytes(raw)
    for steps in (1, 7, 1000):
        df = read(spark, tmp_path, variable="ta", steps=steps)
        assert df.rdd.getNumPartitions() == -(-40 // steps)
        rows = {(r.y, r.x, r.level, r.date): r for r in df.collect()}
        assert len(rows) == 40 * 12 and rows[0, 0, 85000.0, dt.date(2000, 2, 27)].value is None
        one = rows[1, 2, 50000.0, dt.date(2000, 3, 1)]
        assert (one.value, one.lat, one.lon) == (a[2, 1, 1, 2], 12.0, 24.0)  # 29 February is no step
    both = read(spark, tmp_path).groupBy("variable").agg(F.count("*"), F.count("level")).collect()
    assert {tuple(r) for r in both} == {("ta", 480, 480), ("ps", 240, 0)}


def test_a_single_record_variable_is_not_padded():
    v = {"time": (["time"], np.arange(3, dtype=">i2"), {})}
    raw = netcdf.write_netcdf(v, "time")
    assert netcdf.read_netcdf(raw)["variables"]["time"]["values"].tolist() == [0, 1, 2] and len(raw) % 4 == 2


def test_other_axes_and_packed_values(spark, tmp_path):
    a = np.arange(5 * 12, dtype=">i2").reshape(5, 2, 2, 3)
    v = variables(a.astype(float), time={"units": "hours since 2001-01-01 00:00:00"})
    v["ta"] = (["plev", "time", "lon", "lat"], np.transpose(a, [1, 0, 3, 2]).astype(">i2"), {"_FillValue": 7, "scale_factor": 0.5, "add_offset": 100.0})
    v["time"] = (["time"], np.arange(5) * 24.0, {"units": "hours since 2001-01-01 00:00:00"})
    (tmp_path / "x.nc").write_bytes(netcdf.write_netcdf(v))
    rows = {(r.y, r.x, r.level, r.date.day): r.value for r in read(spark, tmp_path / "x.nc", variable="ta").collect()}
    assert rows[1, 2, 50000.0, 5] == 100 + 0.5 * a[4, 1, 1, 2] and rows[0, 1, 50000.0, 1] is None and len(rows) == 60


def test_pushed_filters(spark, tmp_path, monkeypatch):
    for k in range(2):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "x.nc").write_bytes(netcdf.write_netcdf(variables(cube()), "time"))
    df = read(spark, tmp_path, steps=10)
    some = df.where("date >= '2000-03-20' and date < '2000-03-25' and level = 50000 and variable = 'ta' and value > 5")
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert all(x in pushed for x in ("GreaterThanOrEqual(date", "LessThan(date", "EqualTo(level", "EqualTo(variable")) and "GreaterThan(value" not in pushed
    assert [line for line in plan.splitlines() if line.startswith("Condition") and "date#" in line] == []
    all_ = [r for r in df.collect() if r.variable == "ta" and r.level == 50000 and dt.date(2000, 3, 20) <= r.date < dt.date(2000, 3, 25) and r.value > 5]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, all_)) and len(all_) == 2 * 5 * 6
    reader = netcdf.Reader({"path": f"file://{tmp_path}", "steps": "10"}, ["value"])
    assert len(reader.partitions()) == 2 * 2 * 4
    left = list(reader.pushFilters([netcdf.GreaterThan(("date",), dt.date(2000, 3, 20)), netcdf.In(("level",), (50000.0,)), netcdf.GreaterThan(("value",), 5.0)]))
    slabs = reader.partitions()
    assert [f.attribute for f in left] == [("value",)] and {s.variable for s in slabs} == {"ta"} and sum(len(s.steps) for s in slabs) == 2 * (40 - 23 + 1)
    # Only what is wanted is read: a block of one level a step, beside header and axes.
    seen = []
    keep = netcdf._File.read
    monkeypatch.setattr(netcdf._File, "read", lambda self, at, size: seen.append(size) or keep(self, at, size))
    rows = sum(b.num_rows for b in reader.read(slabs[0]))
    assert rows == len(slabs[0].steps) * 6 and sum(s for s in seen if s < netcdf._HEAD) == rows * 8 + (len(LAT) + len(LON)) * 8


def test_no_rows_and_nearest_levels(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(netcdf.write_netcdf(variables(cube())))
    df = read(spark, tmp_path, variable="ta", levels="84000,30000")
    assert {r.level for r in df.select("level").distinct().collect()} == {84000.0, 30000.0}
    assert df.where("level = 30000 and date = '2000-03-01' and y = 0 and x = 0").first().value == cube()[2, 1, 0, 0]
    assert df.where("date > '2030-01-01'").count() == 0 and df.where("level is null").count() == 0
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").count() == 0


def test_fewer_columns(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(netcdf.write_netcdf(variables(cube())))
    netcdf.register(spark)
    df = spark.read.format("netcdf").schema("value double, date date").load(str(tmp_path))
    assert df.columns == ["value", "date"] and df.count() == 720 and df.agg(F.max("date")).first()[0] == dt.date(2000, 4, 7)


def test_long_headers_and_refusals():
    v = {f"v{k}": (["x"], np.zeros(2), {"title": "t" * 900}) for k in range(200)}
    raw = netcdf.write_netcdf(v)
    read = lambda a, n: raw[a : a + n]
    assert len(raw) > netcdf._HEAD and len(netcdf.header(read)[1]) == 200
    with pytest.raises(ValueError, match="ends early"):
        netcdf.header(lambda a, n: raw[a : min(a + n, 50_000)])
    for bad, why in ((b"\x89HDF\r\n\x1a\n" + bytes(100), "HDF5"), (b"GRIB" + bytes(100), "not a classic")):
        with pytest.raises(ValueError, match=why):
            netcdf.header(lambda a, n, bad=bad: bad[a : a + n])


@pytest.mark.parametrize("unit,scale", [("days", 1), ("hours", 24), ("seconds", 86400)])
def test_dates(unit, scale):
    days = np.array([0.0, 58, 59, 365, 1459.5, 1460, -1]) * scale
    assert netcdf.dates(days, f"{unit} since 1999-01-01", "standard")[:4] == [dt.date(1999, 1, 1), dt.date(1999, 2, 28), dt.date(1999, 3, 1), dt.date(2000, 1, 1)]
    assert netcdf.dates(days, f"{unit} since 1999-01-01", "365_day") == [dt.date(1999, 1, 1), dt.date(1999, 2, 28), dt.date(1999, 3, 1), dt.date(2000, 1, 1), dt.date(2002, 12, 31), dt.date(2003, 1, 1), dt.date(1998, 12, 31)]
    assert netcdf.dates(np.array([0.0, 31.0]) * scale, f"{unit} since 2000-03-01", "noleap") == [dt.date(2000, 3, 1), dt.date(2000, 4, 1)]
