"""Colours of values, and seeded random tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def interpolate(table: list[tuple[float, float, float]], x: Column, clip: bool = False) -> Column:
    """The colour at x in [0, 1] of a table of evenly spaced ones, linear between them; outside, null, or with clip the end's."""
    colours = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in table])
    last = len(table) - 1
    at = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) * last
    low = F.least(F.floor(at), F.lit(max(0, last - 1))).cast("int")
    mixed = F.zip_with(F.element_at(colours, low + 1), F.element_at(colours, F.least(low + 2, F.lit(last + 1))), lambda a, b: a + (b - a) * (at - low))
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.lit(clip) | x.between(0, 1)), mixed)


def random_integers(spark: SparkSession, rows: int, columns: int, low: int, high: int, seed: int = 0) -> DataFrame:
    """y, x, value: integers from low to high, the same for a seed whatever the partitions."""
    cell = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("y"), (F.col("id") % columns).cast("int").alias("x"), "id")
    return cell.select("y", "x", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(high - low + 1)) + low).cast("int").alias("value"))
