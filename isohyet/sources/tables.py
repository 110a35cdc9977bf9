"""Text sources: station lists, observation files, model catalogues; and folders of any files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import MISSING_GAUGE, RANGE_LIMIT, clean

STATION_SCHEMA = "station string, lat double, lon double, elevation double"


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Station, LAT, LONG, ELEVATION; a byte-order mark is allowed."""
    return spark.read.csv(path, schema=STATION_SCHEMA, header=True, enforceSchema=True, mode="PERMISSIVE")


def observations(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """One CSV a station (Date and columns), long: station from the file's name, date, var, value. Sentinels and values beyond the range are null."""
    wide = spark.read.csv(path, header=True, pathGlobFilter="*.csv", recursiveFileLookup=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    values = [F.coalesce(F.col(v).try_cast("double") if v in wide.columns else F.lit(None), F.lit(None).cast("double")).alias(v) for v in variables]
    wide = wide.select(name.alias("station"), F.to_date("Date").alias("date"), *values)
    long = wide.unpivot(["station", "date"], variables, "var", "value")
    return long.withColumn("value", clean(F.col("value"), MISSING_GAUGE, limit=RANGE_LIMIT))


def gauges(spark: SparkSession, path: str, pair: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Files VAR<station>.txt whose first line is the first day (yyyyMMdd) and each next line a day's value, -99 missing.

    Variables in `pair` (default TEM: MAXTEM, MINTEM) have two values a line, split by a comma. Long: station, date, var, value.
    """
    pair = {"TEM": ("MAXTEM", "MINTEM")} if pair is None else pair
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    rows = files.select(F.regexp_extract(name, r"^([A-Za-z]+)", 1).alias("file_var"), F.regexp_extract(name, r"^[A-Za-z]+(.+)$", 1).alias("station"), F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\s+$", ""), "\n").alias("lines"))
    rows = rows.select("file_var", "station", F.to_date(F.trim(F.element_at("lines", 1)), "yyyyMMdd").alias("first"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("k", "line"))
    cells = F.split(F.trim("line"), r"\s*,\s*")
    names = reduce(lambda c, kv: F.when(F.col("file_var") == kv[0], F.array(*[F.lit(v) for v in kv[1]])).otherwise(c), pair.items(), F.array("file_var"))
    rows = rows.select("station", F.date_add("first", F.col("k")).alias("date"), F.explode(F.arrays_zip(names.alias("var"), cells.alias("cell"))).alias("p"))
    return rows.select("station", "date", F.col("p.var").alias("var"), clean(F.col("p.cell").try_cast("double"), MISSING_GAUGE).alias("value")).where("var is not null")


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Paths, sizes and times of all files below path that end with suffix; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length", "modificationTime")


def catalogue(paths: DataFrame, tables: tuple[str, ...] = ("day", "Amon"), from_year: int = 1950, to_year: int = 2100) -> DataFrame:
    """Model files by their names variable_table_source_experiment_variant_grid_period.nc, of the wanted tables.

    A file stays if its period ends in from_year or later and begins in to_year or earlier.
    """
    part = F.split(F.regexp_extract("path", r"([^/]+)\.nc$", 1), "_")
    named = ["variable", "table", "source", "experiment", "variant", "grid", "period"]
    out = paths.where(F.size(part) >= 7).select("path", *[F.element_at(part, i + 1).alias(n) for i, n in enumerate(named)])
    out = out.withColumns({"start": F.element_at(F.split("period", "-"), 1), "end": F.try_element_at(F.split("period", "-"), F.lit(2))})
    year = lambda c: F.substr(c, F.lit(1), F.lit(4)).cast("int")
    return out.where(F.col("table").isin(*tables) & (year(F.col("end")) >= from_year) & (year(F.col("start")) <= to_year)).orderBy("source", "experiment", "variable", "start")


def period_dates(start: str, end: str, monthly: bool, leap: bool = True):
    """Dates of a period as a column of a one-row select: month starts, or days, without 29 February in no-leap calendars."""
    if monthly:
        return F.sequence(F.to_date(F.lit(start + "01"), "yyyyMMdd"), F.to_date(F.lit(end + "01"), "yyyyMMdd"), F.expr("interval 1 month"))
    days = F.sequence(F.to_date(F.lit(start), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd"))
    return days if leap else F.filter(days, lambda d: ~((F.month(d) == 2) & (F.dayofmonth(d) == 29)))


def predictors(frames: list[DataFrame], keys: list[str], names: list[str], time: str = "date") -> DataFrame:
    """Periods and files (keys, date, predictor, value) appended, then a column a predictor."""
    every = reduce(lambda a, b: a.unionByName(b), frames)
    return every.groupBy(*keys, time).pivot("predictor", names).agg(F.first("value"))
