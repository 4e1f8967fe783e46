"""Private-set-intersection counts and membership, as joins on the low bits of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.functions.bits import mask
from torvane.functions.share import Dealer, Held, Pair, open_xor


def low_bits(h: Column, bits: int) -> Column:
    return h.bitwiseAND(mask(bits))


def match_counts(dictionary: DataFrame, example: DataFrame, word: str = "word") -> DataFrame:
    """dictionary with a column m: how often the example holds its word (0 if not). The example is counted before the join."""
    counts = example.groupBy(word).agg(F.count("*").alias("m"))
    return dictionary.join(counts, word, "left").withColumn("m", F.coalesce("m", F.lit(0).cast("bigint")))


def members(dictionary: DataFrame, example: DataFrame, word: str = "word", *, present: bool = True) -> DataFrame:
    """The rows of dictionary whose word the example holds, or doesn't."""
    return dictionary.join(example.select(word).distinct(), word, "left_semi" if present else "left_anti")


def shared_match(at: Held, x: Column, y: Column, bits: int, dealer: Dealer, *salt: str) -> Pair:
    """XOR shares of 1 where two words' low bits agree, by an equality test on XOR shares."""
    x, y = at.hold(dealer.share_bits(x, "x", *salt), dealer.share_bits(y, "y", *salt))
    return dealer.equal_bits(at, x, y, bits, *salt)


#: Rows of a dictionary that one bucket holds on average, at most.
EACH = 8


def shared_pairs(dictionary: DataFrame, example: DataFrame, h: str, bits: int, dealer: Dealer) -> tuple[Held, Pair]:
    """Pairs of rows of both, with example's h as torvane_h, and XOR shares of 1 where both hashes agree on the low bits.

    Only pairs of one bucket, the lowest bits of h, are tested; bits above them are what stays secret. There are as many buckets as keep EACH words of the dictionary in
    one on average, so pairs are in proportion to the example's words. Both sides should have distinct words. dealer's keys: h and torvane_h.
    """
    bucket = min(bits, (dictionary.count() // EACH).bit_length())
    low = lambda c: F.col(c).bitwiseAND(mask(bucket))
    pairs = dictionary.withColumn("torvane_b", low(h)).join(example.select(F.col(h).alias("torvane_h")).withColumn("torvane_b", low("torvane_h")), "torvane_b").drop("torvane_b")
    at = Held(pairs)
    return at, shared_match(at, F.col(h), F.col("torvane_h"), bits, dealer)


def shared_members(dictionary: DataFrame, example: DataFrame, h: str, bits: int, dealer: Dealer) -> DataFrame:
    """dictionary with a column m: how many rows of example have a hash h that agrees on the low bits, by shared_pairs()."""
    at, same = shared_pairs(dictionary, example, h, bits, dealer)
    found = at.done(torvane_m=open_xor(same)).groupBy(h).agg(F.sum("torvane_m").alias("m"))
    return dictionary.join(found, h, "left").withColumn("m", F.coalesce("m", F.lit(0).cast("bigint")))
