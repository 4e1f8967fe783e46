"""Aggregates in the ring. Build them inside `with ring(spark)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.functions.ring import big
from torvane.functions.share import pair


def ring_sum(x: Column) -> Column:
    return F.sum(x)


def shared_sum(s: Column) -> Column:
    """Each party sums its own shares."""
    return pair(F.sum(s.s0), F.sum(s.s1))


def sum_of_squares(x: Column) -> Column:
    return F.sum(x * x)


def product(x: Column) -> Column:
    """Wrapping product of a group. Its values are gathered, as there is no product over longs; for small groups."""
    return F.aggregate(F.collect_list(x), big(1), lambda a, b: a * b)


def long_product(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Rows (keys, product) for groups of any size: pieces of a group, dealt by a hash of the rows' columns, are multiplied first; pass columns that tell rows of a large group apart."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(64))
    pieces = rows.groupBy(*keys, salt.alias("torvane_salt")).agg(product(F.col(x)).alias("p"))
    return pieces.groupBy(*keys).agg(product(F.col("p")).alias("product"))


def and_all(x: Column) -> Column:
    return F.bit_and(x)


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (col, lo, hi), one for each column; of one row, that row's values."""
    one = rows.agg(*(f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns) for f in (F.min, F.max)))
    cells = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"min_{i}").alias("lo"), F.col(f"max_{i}").alias("hi")) for i, c in enumerate(columns)))
    return one.select(F.inline(cells))


def dot_chunks(rows: DataFrame, index: str, x: str, y: str, size: int) -> DataFrame:
    """Rows (chunk, dot): sums of x * y over size rows by index."""
    return rows.groupBy(F.floor(F.col(index) / size).cast("bigint").alias("chunk")).agg(F.sum(F.col(x) * F.col(y)).alias("dot"))


def first_argmax(score: Column, index: Column) -> Column:
    """The index of the largest score in a group, the least such index on ties."""
    return -F.max(F.struct(score.alias("score"), (-index).alias("index"))).getField("index")


def ratio_key(n: Column, d: Column) -> Column:
    """What orders as n / d does, exactly, for any longs n and d > 0, and is equal for equal ratios: the whole part and 126 binary digits.

    Two ratios that differ do so by 1 / (d * d') at least, which is more than 2 ** -126. Digits come from long division in decimals of 38 places, in
    which what is left of n times 2 ** 63 is exact.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    scale = F.lit(str(1 << 63)).cast("decimal(19,0)")
    rest = F.pmod(n, d)
    whole = F.call_function("div", wide(n) - wide(rest), wide(d))
    first = F.call_function("div", wide(rest) * scale, wide(d))
    rest = ((wide(rest) * scale) % wide(d)).cast("decimal(19,0)")
    return F.struct(whole.cast("bigint").alias("whole"), first.cast("bigint").alias("first"), F.call_function("div", rest * scale, wide(d)).cast("bigint").alias("second"))


def first_argmax_ratio(rows: DataFrame, keys: list[str], n: str, d: str, index: str) -> DataFrame:
    """Rows (keys, index) with the largest n / d (d > 0), in exact order; the least index on ties."""
    return rows.groupBy(*keys).agg(first_argmax(ratio_key(F.col(n), F.col(d)), F.col(index)).alias(index))
