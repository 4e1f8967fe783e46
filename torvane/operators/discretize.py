"""Equal-width bins, one-hot form, and random choices by hash. Build them inside `with ring(spark)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torvane.functions.ring import big, truncate
from torvane.operators.aggregates import min_max


def edges(rows: DataFrame, columns: list[str], bins: int, f: int) -> DataFrame:
    """Rows (col, edges): bins - 1 edges between a column's least and largest value, low to high."""
    if bins < 2:
        raise ValueError(f"two bins at least: {bins}")
    span = F.col("hi") - F.col("lo")
    cuts = F.array(*(F.col("lo") + truncate(big((j << f) // bins) * span, f) for j in range(1, bins)))
    return min_max(rows, columns).select("col", cuts.alias("edges"))


def bin_of(x: Column, cuts: Column) -> Column:
    """How many edges x reaches; if all are equal to it, the last bin."""
    return F.size(F.filter(cuts, lambda e: x >= e))


def binned(rows: DataFrame, columns: list[str], bins: int, f: int) -> DataFrame:
    """rows with an array column bins, one number for each of the columns. The edges are one small row."""
    cuts = {r["col"]: r["edges"] for r in edges(rows, columns, bins, f).collect()}
    numbers = [bin_of(F.col(c), F.array(*(big(e) for e in cuts[c]))) if cuts[c][0] is not None else F.lit(0) for c in columns]
    return rows.withColumn("bins", F.array(*numbers))


def one_hot(number: Column, bins: int) -> Column:
    return F.array(*((number == b).cast("bigint") for b in range(bins)))


def hashed(*parts: Column | str | int) -> Column:
    """60 bits of a hash of numbers and names, the same in any engine: the first 15 digits of the MD5 of their text."""
    text = F.concat_ws("-", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _slots(spark: SparkSession, trees: int, slots: int) -> DataFrame:
    return spark.range(trees * slots).select(F.floor(F.col("id") / slots).cast("int").alias("tree"), (F.col("id") % slots).cast("int").alias("slot"))


def pick_with_replacement(spark: SparkSession, trees: int, slots: int, size: int, seed: int) -> DataFrame:
    """Rows (tree, slot, attr)."""
    return _slots(spark, trees, slots).withColumn("attr", (hashed(F.col("tree"), F.col("slot"), seed) % size).cast("int"))


def pick_without_replacement(spark: SparkSession, trees: int, slots: int, size: int, seed: int) -> DataFrame:
    """Rows (tree, slot, attr), attributes of a tree distinct: the first of a shuffle of each tree's own."""
    from pyspark.sql import Window

    every = _slots(spark, trees, size).withColumnRenamed("slot", "attr")
    order = Window.partitionBy("tree").orderBy(hashed(F.col("tree"), F.col("attr"), seed), "attr")
    return every.withColumn("slot", (F.row_number().over(order) - 1).cast("int")).filter(F.col("slot") < slots).select("tree", "slot", "attr")


def pick_all(spark: SparkSession, size: int) -> DataFrame:
    """One tree with all attributes in order."""
    return _slots(spark, 1, size).withColumn("attr", F.col("slot"))


def bootstrap(indexed: DataFrame, trees: int, draws: int, n_rows: int, seed: int) -> DataFrame:
    """indexed (i, ...) with a column tree: draws rows for each tree, with repetition; all rows if draws is 0 or n_rows or more."""
    spark = indexed.sparkSession
    if not 0 < draws < n_rows:
        return indexed.crossJoin(F.broadcast(spark.range(trees).select(F.col("id").cast("int").alias("tree"))))
    drawn = _slots(spark, trees, draws).select("tree", (hashed(F.col("tree"), F.col("slot"), seed) % n_rows).alias("i"))
    return drawn.join(indexed, "i")


def random_ratio(f: int, seed: int) -> Column:
    """For (tree, slot), a number below 1 in fixed point."""
    return hashed(F.col("tree"), F.col("slot"), seed, "ratio") % (1 << f)


def random_cuts(rows: DataFrame, columns: list[str], picks: DataFrame, f: int, seed: int) -> DataFrame:
    """picks (tree, slot, attr) with a cut between the least and largest value of the attribute's column, the largest excluded."""
    ranges = min_max(rows, columns).withColumn("attr", F.array_position(F.array(*(F.lit(c) for c in columns)), F.col("col")).cast("int") - 1)
    cut = F.col("lo") + truncate((F.col("hi") - F.col("lo")) * random_ratio(f, seed), f)
    return picks.join(F.broadcast(ranges), "attr").select("tree", "slot", "attr", cut.alias("cut"))


def either_side(x: Column, cut: Column) -> Column:
    """[x < cut, x >= cut]."""
    return F.array((x < cut).cast("bigint"), (x >= cut).cast("bigint"))
