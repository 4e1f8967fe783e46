"""Bits of 64-bit integers, and of 128-bit words as structs (hi, lo), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from torvane.functions.ring import big

#: Every second bit, from the second on, as a signed 64-bit number.
ODD_BITS = -(1 << 63) + 0x2AAAAAAAAAAAAAAA


def mask(n: int) -> Column:
    """The lowest n bits of 64."""
    if not 1 <= n <= 64:
        raise ValueError(f"between 1 and 64 bits: {n}")
    return big(-1 if n == 64 else (1 << n) - 1)


def bit(x: Column, p: int) -> Column:
    return F.shiftrightunsigned(x, p).bitwiseAND(big(1))


def to_bits(x: Column, n: int) -> Column:
    """The lowest n bits as an array, the least first; beyond 64 they are 0."""
    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i < 64, F.call_function("shiftrightunsigned", x, i).bitwiseAND(big(1))).otherwise(big(0)).cast("tinyint"))
    return every if n > 0 else F.array().cast("array<tinyint>")


def geq(x: Column, y: Column, p: int) -> Column:
    """1 where x >= y, for differences below 2 ** p in size."""
    return big(1) - bit(x - y, p)


def less_than(x: Column, y: Column, p: int) -> Column:
    return bit(x - y, p)


def argmax_of_two(x: Column, y: Column, p: int) -> Column:
    """One-hot: the first on ties."""
    return F.array(geq(x, y, p), less_than(x, y, p))


def and_all(b: Column, n: int) -> Column:
    """1 where the lowest n bits are all 1."""
    return (b.bitwiseAND(mask(n)) == mask(n)).cast("bigint")


def equal_bits(x: Column, y: Column, n: int) -> Column:
    """1 where the lowest n bits agree."""
    return (x.bitwiseXOR(y).bitwiseAND(mask(n)) == 0).cast("bigint")


def pairwise_and(b: Column) -> Column:
    """The AND of each even bit and the odd one above it, at the odd one's place."""
    return b.bitwiseAND(F.shiftleft(b, 1)).bitwiseAND(big(ODD_BITS))


def hex128(hi: Column, lo: Column) -> Column:
    """32 lower-case digits."""
    half = lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")
    return F.concat(half(hi), half(lo))


def parse_hex128(text: Column) -> Column:
    """(hi, lo) of a number like 0x1F, of up to 32 digits in either case."""
    digits = F.lpad(F.substring(F.trim(text), 3, 64), 32, "0")
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("bigint")
    return F.struct(half(1).alias("hi"), half(17).alias("lo"))


def unsigned(text: Column) -> Column:
    """The ring value of an unsigned 64-bit decimal number."""
    d = F.trim(text).cast("decimal(20,0)")
    return F.when(d >= F.lit(str(1 << 63)).cast("decimal(20,0)"), (d - F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("bigint")).otherwise(d.cast("bigint"))
