"""The bundled tables in the shapes the operators take: daily and monthly series, pairs, ensembles, grids."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, below spark.checkpoint.dir; where that is unset all must run on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="isohyet-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which ends its lineage."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mean_of(column: str):
    """Mean of amounts with two decimals, from whole cents: the same in any engine and order."""
    return F.sum(F.round(F.col(column) * 100).cast("long")).cast("double") / (F.count(column) * F.lit(100.0))


def mean_sql(column: str) -> str:
    return f"CAST(sum(CAST(round({column} * 100) AS BIGINT)) AS DOUBLE) / (count({column}) * 100.0::DOUBLE)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station (nation), date (month start), value (mean order price)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("station"))
    return o.join(c, "o_custkey").groupBy("station", F.trunc("o_orderdate", "MM").alias("date")).agg(mean_of("o_totalprice").alias("value"))


MONTHLY = f"m AS (SELECT c_nationkey AS station, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, {mean_sql('o_totalprice')} AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station (one of 150 users), var (event type), date, value: as observed, gaps and all."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value")
    return e.groupBy(F.col("user_id").alias("station"), F.col("event_type").alias("var"), F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 2).alias("value"))


DAILY = "d AS (SELECT user_id AS station, event_type AS var, CAST(ts AS DATE) AS date, round(sum(value), 2) AS value FROM events GROUP BY ALL)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model (return flag), obs (price), sim (quantity x 1500): observed and simulated pairs, and a control."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * 1500).alias("sim"), F.col("l_discount").alias("control"), F.col("l_tax").alias("tax"))


PAIRS = "p AS (SELECT l_returnflag AS model, l_extendedprice AS obs, l_quantity * 1500 AS sim, l_discount AS control, l_tax AS tax FROM lineitem)"


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station (line number), date (ship month), gcm (return flag), value (mean price), obs (mean over all flags)."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("station"), F.trunc("l_shipdate", "MM").alias("date"), F.col("l_returnflag").alias("gcm"), "l_extendedprice", "l_quantity")
    m = li.groupBy("station", "date", "gcm").agg(mean_of("l_extendedprice").alias("value"))
    o = li.groupBy("station", "date").agg((mean_of("l_quantity") * 1500).alias("obs"))
    return m.join(o, ["station", "date"])


ENSEMBLE = f"""li AS (SELECT l_linenumber AS station, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_returnflag AS gcm, l_extendedprice, l_quantity FROM lineitem),
e AS (SELECT a.station, a.date, a.gcm, a.value, b.obs FROM (SELECT station, date, gcm, {mean_sql('l_extendedprice')} AS value FROM li GROUP BY ALL) a
  JOIN (SELECT station, date, {mean_sql('l_quantity')} * 1500 AS obs FROM li GROUP BY ALL) b USING (station, date))"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x (40 columns), value (price), cls (size): a raster of the parts."""
    p = table(spark, sf_dir, "part")
    return p.select(F.floor(F.col("p_partkey") / 40).cast("int").alias("y"), (F.col("p_partkey") % 40).cast("int").alias("x"), F.col("p_retailprice").alias("value"), F.col("p_size").alias("cls"))


GRID = "g AS (SELECT CAST(floor(p_partkey / 40) AS INTEGER) AS y, CAST(p_partkey % 40 AS INTEGER) AS x, p_retailprice AS value, p_size AS cls FROM part)"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station (supplier), lat, lon on the raster's rows and columns."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("station"), (F.col("s_suppkey") * 7 % 49 + 0.3).alias("lat"), (F.col("s_suppkey") * 11 % 39 + 0.6).alias("lon"), F.col("s_acctbal").alias("value"))


STATIONS = "s AS (SELECT s_suppkey AS station, s_suppkey * 7 % 49 + 0.3::DOUBLE AS lat, s_suppkey * 11 % 39 + 0.6::DOUBLE AS lon, s_acctbal AS value FROM supplier)"


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x (supplier), time (ship date), value (mean price): a stack of rasters, gaps and all."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    cell = [F.floor(F.col("l_suppkey") / 10).cast("int").alias("y"), (F.col("l_suppkey") % 10).cast("int").alias("x")]
    return li.groupBy(*cell, F.to_date("l_shipdate").alias("time")).agg(mean_of("l_extendedprice").alias("value"))


CUBE = f"cb AS (SELECT CAST(l_suppkey // 10 AS INTEGER) AS y, CAST(l_suppkey % 10 AS INTEGER) AS x, CAST(l_shipdate AS DATE) AS time, {mean_sql('l_extendedprice')} AS value FROM lineitem GROUP BY ALL)"


def land_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, cls (supplier's nation by fives): the classes of the cube's cells."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.floor(F.col("s_suppkey") / 10).cast("int").alias("y"), (F.col("s_suppkey") % 10).cast("int").alias("x"), (F.col("s_nationkey") % 5).alias("cls"))


LAND_USE = "lu AS (SELECT CAST(s_suppkey // 10 AS INTEGER) AS y, CAST(s_suppkey % 10 AS INTEGER) AS x, s_nationkey % 5 AS cls FROM supplier)"
