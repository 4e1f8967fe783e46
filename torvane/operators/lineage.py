"""Tables that cut lineage, and dense row indexes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them see")
        base = f"{tempfile.gettempdir()}/checkpoints/torvane"
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Written as a table in the shared folder and read again: lineage ends, and lost executors take nothing along."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/torvane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.torvane_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that cut() returned, once nothing reads them any more. Frames derived from one don't count as it."""
    for df in tables:
        if path := getattr(df, "torvane_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def with_index(df: DataFrame, name: str = "i") -> DataFrame:
    """df with a column that counts its rows from 0, in their order: partition by partition. Only a count for each partition is collected."""
    own = cut(df.withColumn("torvane_at", F.monotonically_increasing_id()))
    out = numbered(own, F.shiftright("torvane_at", 33), ["torvane_part"], name).select(*df.columns, name)
    out.torvane_path = own.torvane_path  # release(out) deletes what was written
    return out


def numbered(rows: DataFrame, part: Column, order: list[str], name: str) -> DataFrame:
    """rows with a column that counts them from 0: parts by order, where torvane_at counts the rows of a part without gaps."""
    rows = rows.withColumn("torvane_part", part)
    first, starts = 0, []
    for *_, key, least, n in rows.groupBy(*dict.fromkeys([*order, "torvane_part"])).agg(F.min("torvane_at"), F.count("*")).orderBy(*order).collect():
        starts.append((key, first - least))
        first += n
    kind = rows.schema["torvane_part"].dataType.simpleString()
    starts = rows.sparkSession.createDataFrame(starts, f"torvane_part {kind}, torvane_first long")
    return rows.join(F.broadcast(starts), "torvane_part").withColumn(name, F.col("torvane_first") + F.col("torvane_at"))


def broadcast_if_small(df: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """A table for a join, broadcast if it has at most so many rows; else Spark chooses. df is counted, so it should be cheap to read."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key counts as frequent where more than one row in so many has it; so there are fewer frequent keys than this.
FREQUENT = 1 << 12


def join_by_frequency(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a table that has few rows for each key. No key's rows meet in one task: frequent keys' part of the table is broadcast, and so is all of a small one.

    Larger tables meet the rest of the rows by a shuffle, where no key has more than 1 / FREQUENT of all rows. rows and table are read more than once, so they should be cheap to read.
    """
    if table.limit((1 << 17) + 1).count() <= 1 << 17:
        return rows.join(F.broadcast(table), key)
    least = rows.count() // FREQUENT
    frequent = cut(rows.groupBy(key).agg(F.count("*").alias("torvane_n")).filter(F.col("torvane_n") > least).select(key))
    hot = table.join(F.broadcast(frequent), key, "left_semi")
    rest = rows.join(F.broadcast(frequent), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
