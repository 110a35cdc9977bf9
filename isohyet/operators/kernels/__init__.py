"""Numpy kernels of one series (or one small matrix) each: no Spark in here, seeds are arguments."""
