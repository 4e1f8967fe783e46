"""Torvane: fixed-point and secret-shared analytics as Spark DataFrame operators."""
