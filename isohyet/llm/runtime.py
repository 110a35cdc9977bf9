"""Session plumbing of the training-data operators: shared scratch tables, module shipping, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_made: list[tuple[SparkSession, str]] = []
#: The tables of cut that still lie in the shared folder, by the DataFrames that read them.
_tables: dict[int, tuple] = {}


#: Rows and bytes of an Arrow batch, so that a worker's memory is bounded whatever the lengths of texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and bound their batches."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a whole URI: spark.checkpoint.dir, set here only where it is unset and all run on one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="isohyet-")
        spark.conf.set("spark.checkpoint.dir", conf)
        _made.append((spark, conf))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(conf.rstrip("/"))
    # Without a scheme, Spark's default file system is meant; files written from tasks must go there as well.
    return re.sub("^file:/(?!/)", "file:///", path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, which ends its lineage and survives lost executors. options are the writer's."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (weakref.ref(out), path)
    return out


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files of a finished query go at once instead of when the driver's garbage is collected. What a query has written stays."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def location(df: DataFrame) -> str:
    """Where the table lies that cut gave."""
    ref, path = _tables[id(df)]
    if ref() is not df:
        raise ValueError("not a table of cut")
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete the tables that `cut` gave, which no later read needs."""
    for df in tables:
        ref, path = _tables.pop(id(df), (None, None))
        if ref is None or ref() is not df:
            raise ValueError("not a table of cut, or released before")
        remove(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_made):
        try:
            remove(spark, path)
        except Exception:  # the session has ended
            return


def trim() -> None:
    """Give a worker's free memory back: workers live on and are counted beside their executor's heap."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
