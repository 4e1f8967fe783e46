"""Models on shares whose every step is the same whatever the data: decision trees level by level, and naive Bayes.

A tree drops no row and moves none: each row has a share for every (node, class) of a layer, which is 1 at its own node and class. All nodes of a layer are there,
those without rows and those below one that classifies too, and which are which is opened at the end only, by reveal(). Rows keep their shares in
arrays, so a layer shuffles sums of cells and no rows. Build these inside `with ring(spark)`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.functions import gates as g
from torvane.functions.gates import Gates, Share
from torvane.functions.ring import big
from torvane.functions.share import Dealer, Held, Pair, add, constant, negate01, open_sum, pair, scale, subtract
from torvane.operators import sets, shared
from torvane.operators.lineage import broadcast_if_small, cut, join_by_frequency, release
from torvane.operators.models.trees import TreeConfig

NODE = ["tree", "node"]


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _div(i: Column, by: int) -> Column:
    return F.floor(i / by).cast("int")


def _of(name: str) -> Pair:
    return Pair(F.col(f"{name}0"), F.col(f"{name}1"))


def dealt(rows: DataFrame, slots: int, config: TreeConfig, dealer: Dealer) -> DataFrame:
    """Rows (tree, row, x, y) of rows (tree, row, label, bins): shares of the one-hot forms of all bins, slot by slot, and of the label. dealer's keys: tree and row."""
    hot = lambda name, n, is_one: F.transform(_upto(n), lambda i: dealer.share(F.coalesce(is_one(i), F.lit(False)).cast("bigint"), name, i).column)
    x = hot("x", slots * config.bins, lambda i: F.get("bins", _div(i, config.bins)) == i % config.bins)
    return rows.select("tree", "row", x.alias("x"), hot("y", config.classes, lambda i: F.col("label") == i).alias("y"))


def _masked(cells: Column, dealer: Dealer, *salt: str) -> Column:
    """Every share of an array less a mask, opened (e), and shares of the mask (u0, u1)."""

    def one(v: Column, i: Column) -> Column:
        u = dealer.share(dealer.random("mask", *salt, i), "mask", *salt, i)
        return F.struct(open_sum(subtract(v, u)).alias("e"), u.s0.alias("u0"), u.s1.alias("u1"))

    return F.transform(cells, one)


def _parts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """What two masked values' product adds to each party's sum, and to the dealt product of the masks."""
    return a.e * b.u0 + a.u0 * b.e, a.e * b.u1 + a.u1 * b.e + a.e * b.e, (a.u0 + a.u1) * (b.u0 + b.u1)


def _contingency(state: DataFrame, layer: int, config: TreeConfig, seed: int) -> DataFrame:
    """Rows (tree, node, label, slot, bin, v): shares of how many rows there are. A matrix product of members and bins; bins were opened under their mask once, for all layers."""
    opened = state.select("tree", "x", _masked(F.col("m"), Dealer(("tree", "row"), seed), f"members{layer}").alias("m"))
    cells = opened.select("tree", "x", F.posexplode("m").alias("c", "m")).select("tree", "c", "m", F.posexplode("x").alias("s", "x"))
    sums = cells.groupBy("tree", "c", "s").agg(*(F.sum(p).alias(n) for p, n in zip(_parts(F.col("x"), F.col("m")), ("p0", "p1", "w"), strict=True)))
    r = Dealer(("tree", "c", "s"), seed).random(f"counts{layer}")
    place = [_div(F.col("c"), config.classes).alias("node"), (F.col("c") % config.classes).alias("label"), _div(F.col("s"), config.bins).alias("slot"), (F.col("s") % config.bins).alias("bin")]
    return sums.select("tree", *place, pair(F.col("p0") + r, F.col("p1") + F.col("w") - r).alias("v"))


def _scores(at: Gates, counts: Share, shape: tuple[int, int, int, int]) -> tuple[Share, Share]:
    """Shared n and d of the sum over bins of class counts squared over one more than the bin's rows, slot by slot and in a slot node by node, from counts by (node, slot, bin, class)."""
    by_bin = lambda x: at.kept(*(np.ascontiguousarray(v.reshape(shape).sum(axis=3).transpose(2, 1, 0)).reshape(shape[2], -1) for v in x))
    q, y = by_bin(at.multiply(counts, counts)), by_bin(counts)
    y = at.kept(y[0], y[1] + 1)
    n, d = (q[0][0], q[1][0]), (y[0][0], y[1][0])
    for b in range(1, shape[2]):
        own, size = (q[0][b], q[1][b]), (y[0][b], y[1][b])
        n, d = at.kept(*g.add(at.multiply(n, size), at.multiply(own, d))), at.multiply(d, size)
    return n, d


def _first_largest(at: Gates, n: Share, d: Share, slots: int) -> Share:
    """Shares of 1 at the first slot with the largest n / d of each node and of 0 elsewhere: pairs of slots are compared crosswise, and the bits that tell who wins multiplied down again."""
    rows, bits = [tuple(v.reshape(slots, -1) for v in x) for x in (n, d)], []
    while (alive := len(rows[0][0])) > 1:
        left, right = ([tuple(v[k : alive // 2 * 2 : 2].reshape(-1) for v in x) for x in rows] for k in (0, 1))
        bit = at.geq(at.multiply(left[0], right[1]), at.multiply(right[0], left[1]), at.bits - 1)
        won = [at.mux(bit, x, y) for x, y in zip(left, right, strict=True)]
        rows = [tuple(np.concatenate([w.reshape(alive // 2, -1), v[alive // 2 * 2 :]]) for w, v in zip(x, old, strict=True)) for x, old in zip(won, rows, strict=True)]
        bits.append((alive, bit))
    hot = g.constant(1, rows[0])
    for alive, bit in reversed(bits):
        above = tuple(v[: alive // 2].reshape(-1) for v in hot)
        wins = at.multiply(above, bit)
        loses = at.kept(*g.subtract(above, wins))
        pairs = (np.stack([w.reshape(alive // 2, -1), x.reshape(alive // 2, -1)], axis=1).reshape(alive // 2 * 2, -1) for w, x in zip(wins, loses, strict=True))
        hot = tuple(np.concatenate([x, v[alive // 2 :]]) for x, v in zip(pairs, hot, strict=True))
    return hot


def _hot_slots(layer: int, slots: int, config: TreeConfig, seed: int, bits: int) -> Callable:
    """For mapInArrow: rows (tree, node, slot, s0, s1) of rows (tree, node, s0, s1: counts by slot, bin and class), in the ring of so many bits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in enumerate(batches):
            at = Gates(seed, layer, TaskContext.get().partitionId(), k, bits=bits)
            counts = at.widened(tuple(rows.column(s).flatten().to_numpy().view(np.uint64) for s in ("s0", "s1")))
            hot = _first_largest(at, *_scores(at, counts, (rows.num_rows, slots, config.bins, config.classes)), slots)
            slot = pa.array(np.repeat(np.arange(slots, dtype=np.int32), rows.num_rows))
            node = pa.array(np.tile(np.arange(rows.num_rows), slots))
            parts = (pa.array(v.reshape(-1).view(np.int64)) for v in at.narrowed(hot))
            yield pa.record_batch([rows.column("tree").take(node), rows.column("node").take(node), slot, *parts], names=["tree", "node", "slot", "s0", "s1"])

    return task


def _best(counts: DataFrame, layer: int, slots: int, config: TreeConfig, seed: int, bits: int) -> DataFrame:
    """Rows (tree, node, slot, hot): shares of 1 at a node's first slot with the largest score, and of 0 elsewhere. A row of counts for each node meets."""
    cells = F.sort_array(F.collect_list(F.struct("slot", "bin", "label", F.col("v.s0").alias("s0"), F.col("v.s1").alias("s1"))))
    nodes = counts.groupBy(*NODE).agg(cells.alias("cells")).select(*NODE, F.col("cells.s0").alias("s0"), F.col("cells.s1").alias("s1"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.select(*NODE).schema)
    found = nodes.mapInArrow(_hot_slots(layer, slots, config, seed, bits), f"{kinds}, slot int, s0 long, s1 long")
    return cut(found.select(*NODE, "slot", pair(F.col("s0"), F.col("s1")).alias("hot")))


def _stops(nodes: DataFrame, layer: int, config: TreeConfig, seed: int, top: int) -> DataFrame:
    """Rows (tree, node, stop) of nodes (tree, node, f.., size, most): shares of 1 where no class but one has rows, or rows are at most the public number most."""
    size = _of("size")
    tests = [*(subtract(_of(f"f{k}_"), size) for k in range(config.classes)), subtract(Pair(big(0), F.col("most")), size)]
    long = nodes.select(*NODE, F.posexplode(F.array(*(t.column for t in tests))).alias("test", "v"))
    at, d = Held(long), Dealer((*NODE, "test"), seed)
    (bit,) = at.hold(d.bits_to_ring(d.geq(at, F.col("v"), constant(0), top, f"stop{layer}"), f"stop{layer}"))
    bits = at.done(no=negate01(bit).column)
    cells = [F.max(F.when(F.col("test") == t, F.col(f"no.s{k}"))).alias(f"no{t}_{k}") for t in range(len(tests)) for k in (0, 1)]
    at, d, goes = Held(bits.groupBy(*NODE).agg(*cells)), Dealer(tuple(NODE), seed), _of("no0_")
    for t in range(1, len(tests)):
        (goes,) = at.hold(d.multiply(goes, _of(f"no{t}_"), f"goes{layer}", str(t)))
    return at.done(stop=negate01(goes).column).select(*NODE, "stop")


def _moved(state: DataFrame, hot: DataFrame, layer: int, slots: int, config: TreeConfig, seed: int) -> DataFrame:
    """state with members of the next layer: each share times the share of the bin that its node's slot has, both of which stay shares."""
    nodes = config.bins**layer
    own = hot.select("tree", F.struct("node", "slot", _masked(F.array("hot"), Dealer((*NODE, "slot"), seed), f"slots{layer}")[0].alias("h")).alias("cell"))
    by_tree = own.groupBy("tree").agg(F.transform(F.sort_array(F.collect_list("cell")), lambda c: c.h).alias("h"))  # a row for each tree
    d = Dealer(("tree", "row"), seed)
    zero = F.struct(*(big(0).alias(n) for n in ("p0", "p1", "w")))

    def bin_of_node(c: Column) -> Column:
        def more(a: Column, slot: Column) -> Column:
            p0, p1, w = _parts(F.get("x", slot * config.bins + c % config.bins), F.get("h", _div(c, config.bins) * slots + slot))
            return F.struct((a.p0 + p0).alias("p0"), (a.p1 + p1).alias("p1"), (a.w + w).alias("w"))

        def close(a: Column) -> Column:
            r = d.random(f"select{layer}", c)
            return pair(a.p0 + r, a.p1 + a.w - r).column

        return F.aggregate(_upto(slots), zero, more, close)

    chosen = state.join(broadcast_if_small(by_tree), "tree").select("tree", "row", "x", "m", F.transform(_upto(nodes * config.bins), bin_of_node).alias("side"))

    def member(i: Column) -> Column:
        c, k = _div(i, config.classes), i % config.classes
        return d.multiply(F.get("m", _div(c, config.bins) * config.classes + k), F.get("side", c), f"move{layer}", i).column

    return chosen.select("tree", "row", "x", F.transform(_upto(nodes * config.bins * config.classes), member).alias("m"))


def induce(rows: DataFrame, slots: int, config: TreeConfig, *, seed: int = 1, bits: int | None = 64) -> DataFrame:
    """Rows (tree, node, layer, slot, freqs, classifies, below) of shares, one for every node of every layer, from rows (tree, row, x, y) as dealt() makes them.

    freqs is that of 0 unless the node classifies and none above it does; below tells that one above does; slot is null in the last layer. What they open to is
    what trees.induce() finds in the same rows. The number of rows of each tree is public. Scores are compared as exact
    ratios in a ring of so many bits, so the largest tree's rows n must leave n * (n / bins + 1) ** (2 * bins) below 2 ** (bits - 3): with 64 bits about 6,700 with two bins. More are an error.
    With None the ring has as many bits as that needs, so any number of rows will do. No rows give no nodes.
    """
    totals = cut(rows.groupBy("tree").agg(F.count("*").alias("total")))
    n = totals.agg(F.max("total")).first()[0] or 0
    largest = max(n, 1) * (-(-n // config.bins) + 1) ** (2 * config.bins)
    if bits is None:
        bits = max(64, 1 << (largest.bit_length() + 2).bit_length())
    if largest >= 1 << bits - 3:
        raise ValueError(f"scores of {n} rows in {config.bins} bins don't fit the ring")
    size_top = n.bit_length() + 1
    most = totals.select("tree", F.floor(config.epsilon * F.col("total")).cast("bigint").alias("most"))
    state = cut(rows.select("tree", "row", _masked(F.col("x"), Dealer(("tree", "row"), seed), "bins").alias("x"), F.col("y").alias("m")))
    layers, above, node = [], None, Dealer(tuple(NODE), seed)
    for layer in range(config.depth):
        last, written = layer == config.depth - 1, []
        if last:
            cells = state.select("tree", F.posexplode("m").alias("c", "v"))
            by_class = [_div(F.col("c"), config.classes).alias("node"), (F.col("c") % config.classes).alias("label")]
            counts = cells.select("tree", *by_class, "v")
        else:
            whole = cut(_contingency(state, layer, config, seed))
            written.append(whole)
            counts = whole.filter("slot = 0").select(*NODE, "label", "v")
        part = lambda k, s: F.sum(F.when(F.col("label") == k, F.col(f"v.s{s}"))).alias(f"f{k}_{s}")
        sums = counts.groupBy(*NODE).agg(*(part(k, s) for k in range(config.classes) for s in (0, 1)), *(F.sum(f"v.s{s}").alias(f"size{s}") for s in (0, 1)))
        sums = sums.join(F.broadcast(most), "tree")  # a row for each tree
        if last:
            ends = sums.withColumn("stop", constant(1).column).withColumn("slot", F.lit(None).cast("struct<s0: bigint, s1: bigint>"))
        else:
            sums = cut(sums)
            hot = _best(whole, layer, slots, config, seed, bits)
            written += [sums, hot]
            slot = hot.groupBy(*NODE).agg(pair(F.sum(F.col("slot") * F.col("hot.s0")), F.sum(F.col("slot") * F.col("hot.s1"))).alias("slot"))
            ends = sums.join(_stops(sums, layer, config, seed, size_top), NODE).join(slot, NODE)
        ends = ends.join(above, NODE) if above is not None else ends.withColumn("below", constant(0).column)
        at = Held(ends)
        (own,) = at.hold(node.multiply(F.col("stop"), negate01(F.col("below")), f"own{layer}"))
        freqs = F.array(*(node.multiply(_of(f"f{k}_"), own, f"freq{layer}", str(k)).column for k in range(config.classes)))
        nodes = cut(at.done(classifies=own.column, freqs=freqs).select(*NODE, F.lit(layer).alias("layer"), "slot", "freqs", "classifies", "below"))
        layers.append(nodes)
        if not last:
            sides = nodes.select("tree", "node", add(F.col("below"), F.col("classifies")).alias("below"), F.explode(_upto(config.bins)).alias("side"))
            above = sides.select("tree", (F.col("node") * config.bins + F.col("side")).alias("node"), "below")
            before, state = state, cut(_moved(state, hot, layer, slots, config, seed))
            release(before)
        release(*written)
    release(state, totals)
    out = layers[0]
    for nodes in layers[1:]:
        out = out.unionByName(nodes)
    return out


def reveal(nodes: DataFrame, config: TreeConfig) -> DataFrame:
    """Rows (tree, node, layer, slot, freqs, classifies) as trees.induce() has them, opened from induce(). Nodes below one that classifies, and without rows, go."""
    first = F.element_at(F.array(*(big(sum(config.bins**j for j in range(k))) for k in range(config.depth))), F.col("layer") + 1)
    opened = nodes.select("tree", (first + F.col("node")).alias("node"), "layer", open_sum(F.col("slot")).cast("int").alias("slot"), F.transform("freqs", open_sum).alias("freqs"), (open_sum(F.col("classifies")) == 1).alias("classifies"), open_sum(F.col("below")).alias("below"))
    return opened.filter((F.col("below") == 0) & (~F.col("classifies") | (F.array_max("freqs") > 0))).drop("below")


def known(words: DataFrame, logp: DataFrame, bits: int, *, seed: int = 1) -> DataFrame:
    """Rows (h, class, p) of distinct words (h): shares of what logp (h, class, p), shared too, says of the word, and of 0 where it says nothing.

    Each word is tested against those in the same bucket of the vocabulary (sets.shared_pairs), and the bit that tells whether they are one is multiplied with
    the log-probabilities, so which word it was stays a share. A word whose bucket is empty has no rows.
    """
    vocabulary = logp.groupBy("h").agg(F.collect_list(F.struct("class", "p")).alias("torvane_said"))
    pair_of = Dealer(("h", "torvane_h"), seed)
    at, same = sets.shared_pairs(vocabulary, words, "h", bits, pair_of)
    (bit,) = at.hold(pair_of.bits_to_ring(same, "same"))
    said = at.done(bit=bit.column).select("h", "torvane_h", "bit", F.inline("torvane_said"))
    own = Dealer(("h", "torvane_h", "class"), seed).multiply(F.col("bit"), F.col("p"), "said")
    parts = said.select("torvane_h", "class", own.alias("p"))
    return parts.groupBy(F.col("torvane_h").alias("h"), "class").agg(pair(F.sum("p.s0"), F.sum("p.s1")).alias("p"))


def bayes_scores(counts: DataFrame, logp: DataFrame, prior: DataFrame, bits: int, *, seed: int = 1) -> DataFrame:
    """Rows (id, class, score): shares of naive_bayes.scores() from rows (id, h, m), (h, class, p) and (class, p), where m and p are shares and h is 60-bit hashes of words.

    Words are looked up once each, however many examples have them; counts are multiplied with what was found.
    """
    found = cut(known(counts.select("h").distinct(), logp, bits, seed=seed))
    matched = join_by_frequency(counts, found, "h")
    part = Dealer(("id", "h", "class"), seed).multiply(F.col("m"), F.col("p"), "times")
    sums = matched.select("id", "class", part.alias("part")).groupBy("id", "class").agg(pair(F.sum("part.s0"), F.sum("part.s1")).alias("part"))
    every = counts.select("id").distinct().crossJoin(F.broadcast(prior))  # classes are few
    none = F.coalesce("part", constant(0).column)
    out = cut(every.join(sums, ["id", "class"], "left").withColumn("part", none).select("id", "class", add(F.col("p"), F.col("part")).alias("score")))
    release(found)
    return out


def bayes_predict(counts: DataFrame, logp: DataFrame, prior: DataFrame, bits: int, top: int, *, seed: int = 1) -> DataFrame:
    """Rows (id, class): shares of the first class with the largest of bayes_scores(), by a tree of shared comparisons over classes, which are small whole numbers from 0.

    Scores must differ by less than 2 ** top.
    """

    def combine(d: Dealer, at: Held, x: shared.Shares, y: shared.Shares, name: str) -> shared.Shares:
        (first,) = at.hold(d.bits_to_ring(d.geq(at, x["score"], y["score"], top, name), name))
        return {c: d.mux(first, x[c], y[c], name, c) for c in ("score", "own")}

    scores = bayes_scores(counts, logp, prior, bits, seed=seed)
    place = F.col("class").cast("bigint")
    best = shared.reduced(scores.select("id", place.alias(shared.I), "score", pair(big(0), place).alias("own")), ["id"], ["score", "own"], combine, Dealer((), seed))
    out = cut(best.select("id", F.col("own").alias("class")))
    release(scores, best)
    return out
