"""Fixed-point numbers in the ring of 64-bit integers, as column expressions.

BIGINT arithmetic wraps where expressions are analysed with ANSI mode off, so frames that use the ring are built inside
`with ring(spark)`; they may be run anywhere.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@contextlib.contextmanager
def ring(spark: SparkSession) -> Iterator[None]:
    """ANSI mode is off inside, and as it was afterwards."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def big(x: int) -> Column:
    return F.lit(x).cast("bigint")


def encode(x: Column, f: int) -> Column:
    """A number at f fraction bits, cut off towards zero."""
    return (x * float(1 << f)).cast("bigint")


def encode_floor(x: Column, f: int) -> Column:
    """The same by the floor of the magnitude."""
    size = F.floor(F.abs(x) * float(1 << f)).cast("bigint")
    return F.when(x < 0, -size).otherwise(size)


def decode(v: Column, f: int) -> Column:
    return v.cast("double") / float(1 << f)


def truncate(v: Column, f: int) -> Column:
    """Drops f bits of an opened value, rounding down."""
    return F.shiftright(v, f)


def xor01(x: Column, y: Column) -> Column:
    return x + y - big(2) * x * y


def or01(x: Column, y: Column) -> Column:
    return x + y - x * y


def not01(x: Column) -> Column:
    return big(1) - x


def mux(bit: Column, x: Column, y: Column) -> Column:
    """x where bit is 1, y where it is 0."""
    return F.when(bit == 1, x).otherwise(y)


def clipped_relu(x: Column, f: int) -> Column:
    """0 up to minus a half, 1 from a half on, x + 1/2 between."""
    half = big(1 << (f - 1))
    return F.when(x <= -half, big(0)).when(x >= half, half + half).otherwise(x + half)


def inverse_sqrt(x: Column, f: int) -> Column:
    """1 / sqrt(x); null unless x is positive."""
    return F.when(x > 0, encode(1.0 / F.sqrt(decode(x, f)), f))


def gcd(a: Column, b: Column) -> Column:
    """Of numbers that aren't negative; 93 steps are enough for 64 bits."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % s.b).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s.a)


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), big(0)).otherwise((a / g).cast("bigint") * b)
