"""Matrices as rows (row, col, v), batches with a leading k. Build products inside `with ring(spark)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.functions.ring import decode, encode, truncate
from torvane.functions.share import Dealer, pair


def matmul(a: DataFrame, b: DataFrame, *, batch: bool = False) -> DataFrame:
    """a (row, col, v) times b ([k,] row, col, v): rows ([k,] row, col, v), not truncated. An equi-join, then a grouped sum."""
    left = a.select("row", F.col("col").alias("m"), F.col("v").alias("x"))
    right = b.select(*(["k"] if batch else []), F.col("row").alias("m"), "col", F.col("v").alias("y"))
    keys = [*(["k"] if batch else []), "row", "col"]
    return left.join(right, "m").groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def shared_matmul(a: DataFrame, b: DataFrame, dealer: Dealer) -> DataFrame:
    """The same of shared v: masked operands are opened, and each party sums its part. dealer's keys: row, m, col."""
    left = a.select("row", F.col("col").alias("m"), F.col("v").alias("x"))
    right = b.select(F.col("row").alias("m"), "col", F.col("v").alias("y"))
    z = left.join(right, "m").withColumn("z", dealer.multiply(F.col("x"), F.col("y"), "matmul").column)
    return z.groupBy("row", "col").agg(pair(F.sum("z.s0"), F.sum("z.s1")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


def transpose_arrays(rows: DataFrame, index: str, values: str) -> DataFrame:
    """Rows (col, values) of rows with an array each: what the arrays hold at one place, in order of index."""
    cells = rows.select(index, F.posexplode(values).alias("col", "v"))
    lists = F.sort_array(F.collect_list(F.struct(index, "v")))
    return cells.groupBy("col").agg(F.transform(lists, lambda x: x.v).alias("values"))


def group_tensor(a: DataFrame, n_rows: int, size: int) -> DataFrame:
    """Rows (k, row, col, v): size rows make a matrix; what is left over is dropped."""
    k = F.floor(F.col("row") / size).cast("bigint")
    return a.filter(k < n_rows // size).select(k.alias("k"), (F.col("row") % size).alias("row"), "col", "v")


def _scaled(x: Column, total: Column, f: int) -> Column:
    """x over the root of total, which is a sum of squares cut to f bits; 0 for a vector of zeros."""
    inverse = encode(1.0 / F.sqrt(decode(total, f)), f)
    return F.when(total > 0, truncate(x * inverse, f)).otherwise(F.lit(0).cast("bigint"))


def normalize(a: DataFrame, f: int) -> DataFrame:
    """Rows (row, col, v) with each column of a divided by its Euclidean length, in fixed point with f bits."""
    norm = a.groupBy("col").agg(truncate(F.sum(F.col("v") * F.col("v")), f).alias("total"))
    return a.join(norm, "col").select("row", "col", _scaled(F.col("v"), F.col("total"), f).alias("v"))
