"""Decision trees level by level, forests and extra trees, and their votes.

Rows carry the node they stand in. A level is one grouped count over (tree, node, slot, bin, class), the best slot of
each node, and a join that moves rows to their children; all trees are grown at once. Node k's child for bin b is
bins * k + b + 1. The node table has at most trees * bins ** depth rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.functions.ring import ring
from torvane.operators import discretize as dz
from torvane.operators.aggregates import first_argmax
from torvane.operators.lineage import broadcast_if_small, cut, release, with_index


@dataclass(frozen=True)
class TreeConfig:
    """depth: layers of nodes, leaves included. epsilon: a node with at most this share of the tree's rows classifies."""

    bins: int = 5
    depth: int = 3
    classes: int = 2
    epsilon: float = 0.05


def frequencies(rows: DataFrame, classes: int) -> DataFrame:
    """Rows (tree, node, freqs, size): a node's rows by class."""
    counts = [F.count_if(F.col("label") == c).alias(f"c{c}") for c in range(classes)]
    return rows.groupBy("tree", "node").agg(*counts, F.count("*").alias("size")).select("tree", "node", F.array(*(f"c{c}" for c in range(classes))).alias("freqs"), "size")


def is_constant(freqs: Column, size: Column) -> Column:
    return F.array_max(freqs) == size


def contingency(rows: DataFrame) -> DataFrame:
    """Rows (tree, node, slot, bin, label, n)."""
    cells = rows.select("tree", "node", "label", F.posexplode("bins").alias("slot", "bin"))
    return cells.groupBy("tree", "node", "slot", "bin", "label").agg(F.count("*").alias("n"))


def ratio_key(x: Fraction) -> bytes:
    """Bytes that order as non-negative ratios do, exactly, and are equal for equal ones: the continued fraction, every second term turned round.

    A term is how many bytes it has and these, so longer ones are larger. The end stands for a term beyond all others.
    """
    out, n, d, turned = [], x.numerator, x.denominator, False
    while d:
        q, r = divmod(n, d)
        size = (q.bit_length() + 7) // 8
        term = size.to_bytes(2) + q.to_bytes(size)
        out.append(bytes(255 - b for b in term) if turned else term)
        n, d, turned = d, r, not turned
    return b"".join([*out, b"\0\0" if turned else b"\xff\xff"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [sum((Fraction(int(s), y) for s, y in zip(*cells, strict=True)), Fraction(0)) for cells in zip(batch.column("squares").to_pylist(), batch.column("sizes").to_pylist(), strict=True)]
        own = [batch.column(c) for c in ("tree", "node", "slot")]
        yield pa.record_batch([*own, pa.array([x.numerator * 1024 // x.denominator for x in sums], pa.int64()), pa.array(map(ratio_key, sums), pa.binary())], names=["tree", "node", "slot", "score", "key"])


def gini_scores(counts: DataFrame) -> DataFrame:
    """Rows (tree, node, slot, score, key) from contingency(): the sum over bins of class counts squared over one more than the bin's rows.

    Larger is purer. key has the exact order of the sums as ratios of whole numbers of any size, so equal splits tie and no others; score is the sum in whole
    1024ths, rounded down. What is scored is a row for each slot of a node, after all rows are counted.
    """
    wide = F.col("n").cast("decimal(19,0)")
    by_bin = counts.groupBy("tree", "node", "slot", "bin").agg(F.sum((wide * wide).cast("decimal(38,0)")).alias("squares"), (F.sum("n") + 1).alias("size"))
    cells = F.sort_array(F.collect_list(F.struct("bin", "squares", "size")))
    slots = by_bin.groupBy("tree", "node", "slot").agg(cells.alias("cells")).select("tree", "node", "slot", F.col("cells.squares").cast("array<string>").alias("squares"), F.col("cells.size").alias("sizes"))
    kinds = {f.name: f.dataType.simpleString() for f in slots.schema}
    return slots.mapInArrow(_scored, f"tree {kinds['tree']}, node {kinds['node']}, slot {kinds['slot']}, score long, key binary")


def best_slots(scores: DataFrame) -> DataFrame:
    """Rows (tree, node, slot): the first slot with the largest score, in the exact order of key."""
    return scores.groupBy("tree", "node").agg(first_argmax(F.col("key"), F.col("slot")).cast("int").alias("slot"))


def induce(rows: DataFrame, config: TreeConfig) -> DataFrame:
    """Rows (tree, node, layer, slot, freqs, classifies) of trees over rows (tree, label, bins).

    freqs is zero unless the node classifies with no ancestor that does, or is in the last layer with none. Nodes
    under one that classifies, and nodes without rows, are left out: they would have zero frequencies, and no vote.
    slot is null in the last layer.
    """
    zero = F.array(*(F.lit(0).cast("bigint") for _ in range(config.classes)))
    rows = cut(rows.select("tree", F.col("label").cast("int").alias("label"), "bins", F.lit(0).cast("bigint").alias("node")))
    total = cut(rows.groupBy("tree").agg(F.count("*").alias("total")))  # a row for each tree
    layers = []
    for layer in range(config.depth):
        nodes = frequencies(rows, config.classes).join(F.broadcast(total), "tree")
        stop = F.lit(True) if layer == config.depth - 1 else (config.epsilon * F.col("total") >= F.col("size")) | is_constant(F.col("freqs"), F.col("size"))
        nodes = nodes.withColumn("classifies", stop)
        if layer < config.depth - 1:
            nodes = nodes.join(best_slots(gini_scores(contingency(rows))), ["tree", "node"], "left")
        else:
            nodes = nodes.withColumn("slot", F.lit(None).cast("int"))
        nodes = cut(nodes.select("tree", "node", F.lit(layer).alias("layer"), "slot", F.when(F.col("classifies"), F.col("freqs")).otherwise(zero).alias("freqs"), "classifies"))
        layers.append(nodes)
        if layer < config.depth - 1:
            going = nodes.filter("not classifies").select("tree", "node", "slot")
            child = config.bins * F.col("node") + F.element_at("bins", F.col("slot") + 1) + 1
            before, rows = rows, cut(rows.join(going, ["tree", "node"]).select("tree", "label", "bins", child.alias("node")))
            release(before)
    release(rows)
    out = layers[0]
    for nodes in layers[1:]:
        out = out.unionByName(nodes)
    return out


def _picked_bins(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """rows (tree, label, bins over all attributes) with bins of the tree's own slots only."""
    own = picks.groupBy("tree").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "attr"))), lambda x: x.attr).alias("attrs"))
    return rows.join(F.broadcast(own), "tree").select("tree", "label", F.transform("attrs", lambda a: F.get("bins", a)).alias("bins"))


@dataclass
class Forest:
    """nodes: induce()'s, with attr. cuts: rows (tree, slot, attr, edges) that a value is compared with."""

    nodes: DataFrame
    cuts: DataFrame
    columns: list[str]
    config: TreeConfig


def _with_attr(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    return cut(nodes.join(F.broadcast(picks.select("tree", "slot", "attr")), ["tree", "slot"], "left"))


def train_random_forest(rows: DataFrame, columns: list[str], label: str, config: TreeConfig, *, f: int, trees: int = 1, features: int | None = None, instances: int = 0, seed: int = 1, single_tree: bool = False) -> Forest:
    """Bins over the whole data; for each tree, attributes without replacement and rows with replacement (all, if instances is 0).
    single_tree: one tree over all attributes in order and all rows."""
    spark = rows.sparkSession
    with ring(spark):
        binned = dz.binned(rows.select(*columns, F.col(label).alias("label")), columns, config.bins, f).select("label", "bins")
        if single_tree:
            picks = dz.pick_all(spark, len(columns))
            own = binned.withColumn("tree", F.lit(0))
        else:
            picks = dz.pick_without_replacement(spark, trees, features or len(columns), len(columns), seed)
            n = rows.count()
            own = dz.bootstrap(with_index(binned) if 0 < instances < n else binned, trees, instances, n, seed)
        picks = cut(picks)
        nodes = induce(_picked_bins(own, picks), config)
        cuts = picks.join(F.broadcast(dz.edges(rows, columns, config.bins, f)), F.element_at(F.array(*(F.lit(c) for c in columns)), F.col("attr") + 1) == F.col("col")).drop("col")
        return Forest(_with_attr(nodes, picks), cut(cuts), columns, config)


def train_extra_trees(rows: DataFrame, columns: list[str], label: str, config: TreeConfig, *, f: int, trees: int = 5, features: int = 5, seed: int = 1) -> Forest:
    """Attributes with replacement, a random cut for each, all rows; two bins."""
    config = TreeConfig(2, config.depth, config.classes, config.epsilon)
    spark = rows.sparkSession
    with ring(spark):
        picks = cut(dz.random_cuts(rows, columns, dz.pick_with_replacement(spark, trees, features, len(columns), seed), f, seed))
        own = picks.groupBy("tree").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "attr", "cut"))), lambda x: F.struct(x.attr.alias("attr"), x.cut.alias("cut"))).alias("tests"))
        values = rows.select(F.col(label).alias("label"), F.array(*columns).alias("x"))
        sides = F.transform("tests", lambda t: (F.get("x", t.attr) >= t.cut).cast("int"))
        nodes = induce(values.crossJoin(F.broadcast(own)).select("tree", "label", sides.alias("bins")), config)
        return Forest(_with_attr(nodes, picks), cut(picks.select("tree", "slot", "attr", F.array("cut").alias("edges"))), columns, config)


def paths(rows: DataFrame, forest: Forest, key: str) -> DataFrame:
    """Rows (key, tree, freqs): what the trees say of each row, at the one node with frequencies on its way.

    The walk moves before it looks, so the root's own frequencies are never asked for.
    """
    config, c = forest.config, forest.cuts
    nodes = broadcast_if_small(forest.nodes.select("tree", "node", "slot", F.when(F.array_max("freqs") > 0, F.col("freqs")).alias("freqs")))
    edges = broadcast_if_small(c.select("tree", "slot", "attr", "edges"))
    trees = F.broadcast(forest.nodes.select("tree").distinct())
    with ring(rows.sparkSession):
        at = rows.select(F.col(key), F.array(*forest.columns).alias("x")).crossJoin(trees).withColumn("node", F.lit(0).cast("bigint"))
        found = F.lit(None).cast("array<bigint>")
        at = at.withColumn("said", found)
        for _ in range(config.depth - 1):
            here = at.join(nodes.select("tree", "node", "slot"), ["tree", "node"], "left").join(edges, ["tree", "slot"], "left")
            moved = config.bins * F.col("node") + dz.bin_of(F.get("x", F.col("attr")), F.col("edges")) + 1
            here = here.select(key, "x", "tree", "said", moved.alias("node")).join(nodes.select("tree", "node", "freqs"), ["tree", "node"], "left")
            at = here.select(key, "x", "tree", F.coalesce("said", "freqs").alias("said"), "node")
        return at.filter("said is not null").select(key, "tree", F.col("said").alias("freqs"))


def votes(rows: DataFrame, forest: Forest, key: str, *, soft: bool = False) -> DataFrame:
    """Rows (key, class): the class with most votes, the lowest on ties; 0 where no tree says anything.

    A tree gives one vote to its largest class, or with soft, to each class its share.
    """
    return _votes(rows, forest, key, F.lit(0), 1, soft).drop("run")


def _votes(rows: DataFrame, forest: Forest, key: str, run: Column, runs: int, soft: bool) -> DataFrame:
    """Rows (run, key, class): votes() among the trees of each run. All rows walk all trees once; the run is one more key of the sums."""
    said = paths(rows, forest, key).withColumn("run", run)
    k = forest.config.classes
    if soft:
        total = F.aggregate("freqs", F.lit(0).cast("bigint"), lambda a, x: a + x)
        part = [F.get("freqs", F.lit(c)) / total for c in range(k)]
    else:
        largest = F.array_position("freqs", F.array_max("freqs")) - 1
        part = [F.when(largest == c, 1.0).otherwise(0.0) for c in range(k)]
    sums = said.groupBy("run", key).agg(*(F.round(F.sum(p), 9).alias(f"v{c}") for c, p in enumerate(part)))
    every = F.array(*(f"v{c}" for c in range(k)))
    best = sums.select("run", key, (F.array_position(every, F.array_max(every)) - 1).cast("int").alias("class"))
    asked = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    return asked.join(best, ["run", key], "left").select("run", key, F.coalesce("class", F.lit(0)).alias("class"))


def bulk_votes(rows: DataFrame, forest: Forest, key: str, runs: int, *, soft: bool = False) -> DataFrame:
    """Rows (run, key, class) of a forest whose trees are those of several runs, as many in each: every run's own vote.

    Bulk training is one job with more trees: run r has the trees from r * trees on, which all levels of induce() grow side by side.
    """
    trees = forest.nodes.agg(F.max("tree")).first()[0] + 1
    if trees % runs:
        raise ValueError(f"{trees} trees can't be {runs} runs")
    return _votes(rows, forest, key, F.floor(F.col("tree") / (trees // runs)).cast("int"), runs, soft)


def accuracy(predicted: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row: correct, rows, accuracy."""
    both = predicted.join(labels.select(key, label), key)
    hit = F.count_if(F.col("class") == F.col(label))
    return both.agg(hit.alias("correct"), F.count("*").alias("rows"), (hit / F.count("*")).alias("accuracy"))
