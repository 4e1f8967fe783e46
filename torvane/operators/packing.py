"""Bit packing of rows (i, v) into 128-bit words (hi, lo), the first element at the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.functions.ring import big
from torvane.functions.bits import mask

WORD = 128


def _fields(width: int) -> int:
    if not 1 <= width <= 64:
        raise ValueError(f"fields of 1 to 64 bits: {width}")
    return WORD // width


def _up(v: Column, by: Column) -> Column:
    """v shifted left by a column; 0 from 64 on, and to the right where it is negative."""
    left = F.when(by >= 64, big(0)).otherwise(F.call_function("shiftleft", v, by))
    right = F.when(by <= -64, big(0)).otherwise(F.call_function("shiftrightunsigned", v, -by))
    return F.when(by >= 0, left).otherwise(right)


def pack(rows: DataFrame, width: int, *, pad: int | None = None) -> DataFrame:
    """Rows (word, hi, lo). pad: a bit set below each field of odd width, which makes it even."""
    value, wide = F.col("v").bitwiseAND(mask(width)), width
    if pad is not None and width % 2:
        value, wide = F.shiftleft(value, 1).bitwiseOR(big(pad & 1)), width + 1
    n = _fields(wide)
    at = (WORD - wide * (F.col("i") % n + 1)).cast("int")  # of the field's lowest bit
    cells = rows.select(F.floor(F.col("i") / n).cast("bigint").alias("word"), _up(value, at - 64).alias("hi"), F.when(at < 64, _up(value, at)).otherwise(big(0)).alias("lo"))
    return cells.groupBy("word").agg(F.bit_or("hi").alias("hi"), F.bit_or("lo").alias("lo"))


def unpack(words: DataFrame, width: int, n: int, *, padded: bool = False) -> DataFrame:
    """Rows (i, v) of the first n fields."""
    wide = width + (padded and width % 2)
    per = _fields(wide)
    cells = words.select("word", "hi", "lo", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("j"))
    at = (WORD - wide * (F.col("j") + 1)).cast("int")
    high, low = _up(F.col("hi"), 64 - at), F.when(at < 64, _up(F.col("lo"), -at)).otherwise(big(0))
    high = F.when(at >= 64, _up(F.col("hi"), 64 - at)).otherwise(F.when(at > 0, _up(F.col("hi"), 64 - at)).otherwise(big(0)))
    field = high.bitwiseOR(low)
    if wide != width:
        field = F.shiftrightunsigned(field, 1)
    i = (F.col("word") * per + F.col("j")).cast("bigint")
    return cells.filter(i < n).select(i.alias("i"), field.bitwiseAND(mask(width)).alias("v"))


def every_second_bit(v: Column, width: int) -> Column:
    """Of a field of 2 * width bits, its bits 1, 3, 5, ... side by side."""
    bits = [F.shiftleft(F.shiftrightunsigned(v, 2 * j + 1).bitwiseAND(big(1)), j) for j in range(width)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def repack(words: DataFrame, width: int, n: int) -> DataFrame:
    """Words of n fields of 2 * width bits to words of fields of width bits, every second bit kept."""
    if not 1 <= width <= 32:
        raise ValueError(f"1 to 32 bits: {width}")
    fields = unpack(words, 2 * width, n)
    return pack(fields.select("i", every_second_bit(F.col("v"), width).alias("v")), width)
