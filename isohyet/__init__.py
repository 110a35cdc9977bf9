"""Spark-native analytics for keyed time series and raster cubes."""
