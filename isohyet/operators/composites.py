"""Composites of raster stacks: means of the rasters of a bucket of dates.

Calendar buckets depend on a date alone, so composites are partial sums by (cell, bucket) that grow with the stack: new
dates touch their own buckets, all others stay as they are written. Nothing is sorted or ranked a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..sources.sinks import exists


def bucket(time: Column, days: int) -> Column:
    """First day of a date's bucket. Buckets of `days` begin with each year; a year's last one may be shorter."""
    return F.date_add(F.trunc(time, "year").cast("date"), (F.floor((F.dayofyear(time) - 1) / days) * days).cast("int"))


def sums(cube: DataFrame, keys: list[str], days: int, time: str = "time", value: str = "value") -> DataFrame:
    """keys, bucket, total and n of the values; missing ones do not count."""
    kept = F.when(~F.isnan(value), F.col(value))
    return cube.groupBy(*keys, bucket(F.col(time), days).alias("bucket")).agg(F.coalesce(F.sum(kept), F.lit(0.0)).alias("total"), F.count(kept).alias("n"))


def add(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of sums as one; each cell and bucket once."""
    return stored.unionByName(new).groupBy(*keys, "bucket").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def means(table: DataFrame, keys: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """The composites of sums, at their buckets' first days; null where no raster has a value."""
    return table.select(*keys, F.col("bucket").alias(time), F.try_divide("total", F.col("n").cast("double")).alias(value))


def update(spark: SparkSession, path: str, cube: DataFrame, keys: list[str], days: int, work: str, time: str = "time", value: str = "value") -> DataFrame:
    """Add the rasters of new dates to the sums below path (Parquet, a partition a bucket), and read all of them.

    Only partitions of buckets with new dates are read and written again; the sums are finished below `work`, in the shared
    folder, before any is replaced, so a lost executor leaves the table as it was or as it should be.
    """
    sums(cube, keys, days, time, value).write.parquet(f"{work}/new")
    new = spark.read.parquet(f"{work}/new")
    if exists(spark, path):
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # one a bucket of dates, whatever the number of cells
        add(spark.read.parquet(path).where(F.col("bucket").isin(touched)), new, keys).write.parquet(f"{work}/merged")
        new = spark.read.parquet(f"{work}/merged")
    new.repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def consecutive(cube: DataFrame, keys: list[str], every: int, time: str = "time", value: str = "value") -> DataFrame:
    """Means of every so many rasters in order of date, at the first one's date.

    The stack's dates are numbered, not the dates of a cell, and joined back; their table has a row a raster.
    """
    dates = cube.select(time).distinct().withColumn("__k", F.floor((F.row_number().over(W.orderBy(time)) - 1) / every))
    dates = dates.withColumn("__first", F.min(time).over(W.partitionBy("__k"))).drop("__k")
    return cube.join(dates, time).groupBy(*keys, F.col("__first").alias(time)).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(value))
