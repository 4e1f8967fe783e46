"""A training corpus from documents: stages in order, each on all rows that the one before kept.

All stages but the last return the columns they are given, whatever their names, with their types. Each of them gives no rows for an empty
table, reads whole texts, and has a defined result for rows with nulls, without words and repeated; the docstrings say which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torvane.llm import jaccard, mixing, resample, suffixes, winnow
from torvane.llm.shared import cut, release

#: No SQL: the stages resample, train and round at random from hashes.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling towards the good labelled ones draws.

    Null and empty texts have weight 0 and are drawn as such; repeated rows share one fate; rows tied with the last one
    drawn stay; rows with a null doc_id share their noise and are never labelled. Without labels all rows stay.
    """
    return resample.drawn(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id.

    Rows with a null doc_id stay; of rows alike in id and text one does. Texts without words (or null) are linked with nothing and stay.
    """
    groups = jaccard.similar_components(docs, k=5, num=80, den=100)
    heads = cut(groups.select("component_id").filter("component_id is not null").distinct())
    release(groups)
    named = docs.join(heads, docs["doc_id"].cast("long") == heads["component_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document, or place, has.

    Earlier is by doc_id, null last. Documents of which nothing is left go; null, empty and short texts stay as they
    are; rows that repeat an id and its text are one document, and lose the same passages. n_chars follows the text.
    """
    return suffixes.without_repeats(docs, min_words=50, k=40)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no ten words in a row of a benchmark item, and no whole item of fewer words.

    Null and empty texts have no words and stay; rows alike in id and text share one fate; items without words, or no items, take nothing.
    """
    return winnow.decontaminated(docs, _table(spark, sf_dir, "benchmark"), span=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much the mix takes of each row: (doc_id, source, size, source_size, target, taken).

    Null and empty texts have size 0 and give nothing; a null source is a source of its own, the last one; repeated
    rows are rounded each on its own; a null doc_id stays null.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)
    return out
