"""Raster and cube files: NetCDF and GeoTIFF, read into long tables in tasks, without any library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import netcdf
from .geotiff import read_tiff, write_tiff  # noqa: F401
from .netcdf import read_netcdf, write_netcdf  # noqa: F401


def grids(spark: SparkSession, path: str, variable: str, levels: tuple[float, ...] = (50_000.0, 85_000.0)) -> DataFrame:
    """Cells of a variable in all .nc files below path: path, y, x, lat, lon, level (the nearest to each of `levels`, null without), date, value."""
    netcdf.register(spark)
    wanted = ",".join(map(str, levels))
    return spark.read.format("netcdf").options(variable=variable, levels=wanted).load(path).drop("variable")


def tiff_stack(spark: SparkSession, path: str, band: int = 1, pattern: str = r"(\d{8})", form: str = "yyyyMMdd") -> DataFrame:
    """Cells of all .tif files below path: y, x, lat, lon, time (from the file's name), value."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif").load(path)

    def explode(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                a, info = read_tiff(bytes(raw), band)
                (dx, dy), (x0, y0) = info["pixel"], info["origin"]
                step = max(1, (1 << 16) // a.shape[1])
                for first in range(0, a.shape[0], step):  # some rows at a time
                    some = a[first : first + step]
                    yy, xx = (v.ravel() for v in np.mgrid[first : first + len(some), 0 : a.shape[1]])
                    yield pd.DataFrame({"path": name, "y": yy, "x": xx, "lat": y0 - (yy + 0.5) * dy, "lon": x0 + (xx + 0.5) * dx, "value": some.ravel().astype(float)})

    cells = files.select("path", "content").mapInPandas(explode, "path string, y int, x int, lat double, lon double, value double")
    stamp = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1)
    return cells.select("y", "x", "lat", "lon", F.to_date(F.when(stamp != "", stamp), form).alias("time"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def check(spark: SparkSession, path: str, suffix: str = ".nc") -> DataFrame:
    """path, ok, error: which files below path cannot be opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)

    def run(batches):
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    read_netcdf(bytes(raw)) if suffix == ".nc" else read_tiff(bytes(raw))
                    rows.append((name, True, None))
                except Exception as e:  # any fault of a file is its result
                    rows.append((name, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ok", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, ok boolean, error string")
