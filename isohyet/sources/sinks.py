"""Sinks: daily weather text files, rasters, and partitioned tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Decimals of each variable in daily weather files.
DECIMALS = {"PRE": 1, "RHU": 3, "RS": 2, "WIN": 1, "TEM": 1}


def weather_lines(df: DataFrame, station: str = "station", time: str = "date") -> DataFrame:
    """file (VAR + station), place and line of each text file: the first day, then a value a day; temperature as max,min.

    df: station, date and any of PRE, RHU, RS, WIN, MAXTEM, MINTEM; missing values are -99.
    """
    text = lambda c, v: F.format_string(f"%.{DECIMALS[v]}f", F.coalesce(F.col(c), F.lit(-99.0)))
    lines = [F.struct(F.lit(v).alias("var"), text(v, v).alias("line")) for v in ("PRE", "RHU", "RS", "WIN") if v in df.columns]
    if {"MAXTEM", "MINTEM"} <= set(df.columns):
        lines.append(F.struct(F.lit("TEM").alias("var"), F.concat_ws(",", text("MAXTEM", "TEM"), text("MINTEM", "TEM")).alias("line")))
    rows = df.select(station, time, F.explode(F.array(*lines)).alias("r")).select(F.concat("r.var", F.col(station).cast("string")).alias("file"), F.col(time).alias("date"), "r.line")
    first = rows.groupBy("file").agg(F.min("date").alias("first")).select("file", F.date_sub("first", 1).alias("date"), F.date_format("first", "yyyyMMdd").alias("line"))
    return first.unionByName(rows)


def write_weather(df: DataFrame, path: str, station: str = "station", time: str = "date") -> None:
    """A folder file=VAR<station> for each text file, its lines in order of the days."""
    lines = weather_lines(df, station, time)
    lines.repartition("file").sortWithinPartitions("file", "date").select("file", "line").write.mode("overwrite").partitionBy("file").text(path)


def weather_files(df: DataFrame, station: str = "station", time: str = "date") -> DataFrame:
    """name (VAR<station>.txt) and content of the text files of weather_lines; a file holds one station's days."""
    lines = weather_lines(df, station, time).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("date", "line"))).alias("rows"))
    return lines.select(F.concat("file", F.lit(".txt")).alias("name"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").cast("binary").alias("content"))


def write_files(df: DataFrame, folder: str) -> int:
    """Write each row of df (name, content) as a file below folder, which all tasks reach; returns how many.

    A file is written under a name of its own attempt and moved to its place when whole, so a task may run twice.
    """
    import pyarrow.fs as pafs

    pafs.FileSystem.from_uri(_uri(folder))[0].create_dir(pafs.FileSystem.from_uri(_uri(folder))[1], recursive=True)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(_uri(folder))
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                part = f"{root}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(content)
                fs.move(part, f"{root}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.select("name", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_grid(df: DataFrame, path: str, by: list[str]) -> None:
    """A grid table in Parquet, in partitions `by` and sorted by cell."""
    df.repartition(*by).sortWithinPartitions("y", "x").write.mode("overwrite").partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, on: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """A table in buckets by cell: tables with as many buckets meet on `on` without a shuffle."""
    df.write.bucketBy(buckets, *on).sortBy(*on).mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path of any file system that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def tiffs(df: DataFrame, keys: list[str], value: str = "value", **layout) -> DataFrame:
    """The bytes of one GeoTIFF for each key's grid (y, x, lat, lon, value); gaps are NaN. layout: options of write_tiff, such as compression and tile."""
    from .rasters import write_tiff

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        a, lat, lon = np.full((h, w), np.nan), np.full(h, np.nan), np.full(w, np.nan)
        a[pdf["y"], pdf["x"]] = pdf[value].astype(float)
        lat[pdf["y"]], lon[pdf["x"]] = pdf["lat"], pdf["lon"]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "content": write_tiff(a, lat, lon, **layout)}])

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, content binary")
