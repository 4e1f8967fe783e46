"""Naive Bayes: word counts to log-probabilities, and examples scored by matched words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torvane.functions.ring import encode
from torvane.operators.aggregates import first_argmax
from torvane.operators.lineage import join_by_frequency


def counted(words: DataFrame) -> DataFrame:
    """Rows (id, word, m) of rows (id, word): how often an example has a word."""
    return words.groupBy("id", "word").agg(F.count("*").alias("m"))


def learn(counts: DataFrame, labels: DataFrame, f: int) -> tuple[DataFrame, DataFrame]:
    """(word, class, logp) and (class, prior) in fixed point, from rows (id, word, m) as counted() gives them, and (id, class); counts smoothed by one."""
    own = counts.join(labels, "id").groupBy("class", "word").agg(F.sum("m").alias("n"))
    vocabulary = counts.select("word").distinct()
    size = vocabulary.agg(F.count("*").alias("size"))
    classes = labels.groupBy("class").agg(F.count("*").alias("rows"))
    totals = classes.join(own.groupBy("class").agg(F.sum("n").alias("total")), "class", "left")
    every = vocabulary.crossJoin(F.broadcast(totals.select("class", F.coalesce("total", F.lit(0)).alias("total")))).crossJoin(F.broadcast(size))
    n = every.join(own, ["class", "word"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    logp = n.select("word", "class", encode(F.log((F.col("n") + 1.0) / (F.col("total") + F.col("size"))), f).alias("logp"))
    all_rows = classes.agg(F.sum("rows").alias("all"))
    prior = classes.crossJoin(F.broadcast(all_rows)).select("class", encode(F.log(F.col("rows") / F.col("all")), f).alias("prior"))
    return logp, prior


def scores(counts: DataFrame, logp: DataFrame, prior: DataFrame) -> DataFrame:
    """Rows (id, class, score) from rows (id, word, m): the prior and, for each word as often as the example has it, its log-probability; unknown words add nothing.

    A frequent word has a row in most examples; such rows stay where they are.
    """
    matched = join_by_frequency(counts, logp, "word").groupBy("id", "class").agg(F.sum(F.col("m") * F.col("logp")).alias("part"))
    every = counts.select("id").distinct().crossJoin(F.broadcast(prior))  # classes are few
    return every.join(matched, ["id", "class"], "left").select("id", "class", (F.col("prior") + F.coalesce("part", F.lit(0).cast("bigint"))).alias("score"))


def predict(counts: DataFrame, logp: DataFrame, prior: DataFrame) -> DataFrame:
    """Rows (id, class): the first class with the largest score."""
    return scores(counts, logp, prior).groupBy("id").agg(first_argmax(F.col("score"), F.col("class")).alias("class"))
