"""Headerless CSV, hex columns, text and node JSON, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torvane.functions.bits import parse_hex128, unsigned
from torvane.functions.ring import big, encode
from torvane.functions.share import Dealer
from torvane.operators.lineage import cut, numbered
from torvane.operators.models.trees import Forest, TreeConfig

NODES = "tree int, node long, layer int, slot int, freqs array<long>, classifies boolean, attr int"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row, line) of text that isn't blank, in the order of the files by name and of their lines, into however many splits they fall."""
    text = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").filter("trim(value) <> ''")
    own = cut(text.withColumn("torvane_at", F.monotonically_increasing_id()))
    split = F.concat_ws(" ", "file_path", F.lpad(F.col("file_block_start").cast("string"), 20, "0"))
    return numbered(own, split, ["file_path", "file_block_start"], "row").select("row", F.col("value").alias("line"))


def read_column(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row, v) of one column of unsigned 64-bit numbers."""
    return _lines(spark, path).select("row", unsigned(F.col("line")).alias("v"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row, col, v) of unsigned 64-bit numbers."""
    cells = _lines(spark, path).select("row", F.posexplode(F.split("line", ",")).alias("col", "v"))
    return cells.select("row", "col", unsigned(F.col("v")).alias("v"))


def read_float_matrix(spark: SparkSession, path: str) -> DataFrame:
    cells = _lines(spark, path).select("row", F.posexplode(F.split("line", ",")).alias("col", "v"))
    return cells.select("row", "col", F.trim("v").cast("double").alias("v"))


def read_hex_column(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row, hi, lo) of numbers like 0x1F of up to 128 bits."""
    return _lines(spark, path).select("row", parse_hex128(F.col("line")).alias("v")).select("row", "v.hi", "v.lo")


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """Rows (tree, slot, attr): a line for each tree."""
    return read_matrix(spark, path).select(F.col("row").cast("int").alias("tree"), F.col("col").alias("slot"), F.col("v").cast("int").alias("attr"))


def read_splits(spark: SparkSession, path: str, f: int) -> DataFrame:
    """Rows (tree, slot, cut): a line of decimal numbers for each tree."""
    return read_float_matrix(spark, path).select(F.col("row").cast("int").alias("tree"), F.col("col").alias("slot"), encode(F.col("v"), f).alias("cut"))


def write_lines(df: DataFrame, path: str) -> None:
    """A frame of one string column, as text."""
    df.write.text(path)


def write_matrix(cells: DataFrame, path: str) -> None:
    """Cells (row, col, v) as headerless CSV, rows in order across the files."""
    lists = F.sort_array(F.collect_list(F.struct("col", "v")))
    lines = cells.groupBy("row").agg(F.array_join(F.transform(lists, lambda x: x.v.cast("string")), ",").alias("value"))
    lines.sort("row").select("value").write.text(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.json(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).json(path)


_NODE = "struct<attribute: array<int>, slot: int, splits: array<long>, frequencies: array<long>>"
FOREST = f"tree int, columns array<string>, bins int, depth int, classes int, epsilon double, nodes array<{_NODE}>"


def write_forest(forest: Forest, path: str) -> None:
    """A JSON document for each tree, with its settings and all its nodes in the order of their numbers: the attribute as a one-hot vector, its slot and split points, and the frequencies.

    Nodes that the tree lacks are there too, with zeros; so a document grows with bins ** depth, and is made in one task.
    """
    c = forest.config
    size = sum(c.bins**k for k in range(c.depth))
    zeros = lambda n, kind: F.array_repeat(F.lit(0).cast(kind), n)
    with_cuts = forest.nodes.join(forest.cuts.select("tree", "slot", "edges"), ["tree", "slot"], "left")
    hot = F.array(*(F.coalesce((F.col("attr") == i).cast("int"), F.lit(0)) for i in range(len(forest.columns))))
    node = F.struct(hot.alias("attribute"), "slot", F.coalesce("edges", zeros(c.bins - 1, "bigint")).alias("splits"), F.col("freqs").alias("frequencies"))
    own = with_cuts.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("node", node.alias("at")))).alias("own"))
    none = F.struct(zeros(len(forest.columns), "int").alias("attribute"), F.lit(None).cast("int").alias("slot"), zeros(c.bins - 1, "bigint").alias("splits"), zeros(c.classes, "bigint").alias("frequencies"))
    nodes = F.transform(F.sequence(big(0), big(size - 1)), lambda k: F.coalesce(F.try_element_at("own", k), none))
    settings = [F.array(*(F.lit(x) for x in forest.columns)).alias("columns"), *(F.lit(getattr(c, k)).alias(k) for k in ("bins", "depth", "classes", "epsilon"))]
    own.select("tree", *settings, nodes.alias("nodes")).write.option("ignoreNullFields", False).json(path)


def read_forest(spark: SparkSession, path: str) -> Forest:
    """The forest that write_forest() wrote. Its settings are those of one document, as all have the same; no document is an error."""
    documents = spark.read.schema(FOREST).json(path)
    first = documents.select("columns", "bins", "depth", "classes", "epsilon").first()
    if first is None:
        raise ValueError(f"no tree in {path}")
    config = TreeConfig(first.bins, first.depth, first.classes, first.epsilon)
    cells = documents.select("tree", F.posexplode("nodes").alias("node", "at")).select("tree", F.col("node").cast("bigint").alias("node"), "at.*")
    starts = F.array(*(F.lit(sum(config.bins**j for j in range(k))) for k in range(config.depth)))
    layer = F.size(F.filter(starts, lambda x: F.col("node") >= x)) - 1
    attr = F.array_position("attribute", 1).cast("int") - 1
    said = F.array_max("frequencies") > 0
    nodes = cells.filter(F.col("slot").isNotNull() | said).select("tree", "node", layer.alias("layer"), "slot", F.col("frequencies").alias("freqs"), said.alias("classifies"), F.when(attr >= 0, attr).alias("attr"))
    cuts = cells.filter("slot is not null").select("tree", "slot", attr.alias("attr"), F.col("splits").alias("edges")).distinct()
    return Forest(cut(nodes), cut(cuts), list(first.columns), config)


def prepare_shares(parts: list[DataFrame], *, drop: list[str], label: str, positive: str, f: int, dealer: Dealer) -> DataFrame:
    """The union of parties' cohorts with every number, and the label (1 where it is positive), as shares in fixed point."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    numbers = [c for c in whole.columns if c not in drop and c != label]
    one = F.when(F.col(label) == positive, 1.0).otherwise(0.0)
    return whole.select(*(dealer.share(encode(F.col(c).cast("double"), f), c).alias(c) for c in numbers), dealer.share(encode(one, f), label).alias(label))
