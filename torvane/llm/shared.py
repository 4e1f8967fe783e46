"""What the operators share: tables that cut lineage, membership bitmaps, links to components, merged intervals."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torvane.operators.lineage import cut, release, shared_dir  # noqa: F401

#: A membership bitmap has at most 2 ** MAX_BITS bits (32 MB); more keys only make it less selective.
MAX_BITS = 28
BITS_PER_KEY = 32


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


class Bitmap:
    """Keys (mixed 64-bit hashes) that may be present. It never misses one; its size has a fixed bound."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def _has(self, at: np.ndarray) -> np.ndarray:
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        found = self._has(keys >> np.uint64(64 - self.bits))
        at = np.flatnonzero(found)
        found[at] = self._has(keys[at] & np.uint64((1 << self.bits) - 1))
        return found


def bitmap(df: DataFrame, key: str, max_bits: int = MAX_BITS) -> Bitmap:
    """Of the hashes in a column, two probes each: executors build pieces of 4 KB, and only those reach the driver."""
    bits = int(min(max_bits, max(16, np.ceil(np.log2(BITS_PER_KEY * max(df.count(), 1))))))
    probes = F.array(F.shiftrightunsigned(F.col(key), 64 - bits), F.col(key).bitwiseAND(F.lit((1 << bits) - 1)))
    rows = (
        df.select(F.explode(probes).alias("p"))
        .select(F.bitmap_bucket_number(F.col("p") + 1).alias("k"), F.bitmap_bit_position(F.col("p") + 1).alias("p"))
        .groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).collect()
    )
    data = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for k, b in rows:
        data[(k - 1) * 4096 : k * 4096] = np.frombuffer(b, np.uint8)
    return Bitmap(bits, data)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) of the nodes in edges (a, b): comp is the smallest node that links reach.

    Each round takes the smallest label around a node and then the label of that label, so paths shorten
    by halves. Only counts reach the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    for _ in range(max_rounds):
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m")).withColumnRenamed("a", "node")
        near = labels.select("node", "comp").join(around, "node").select("node", F.least("comp", "m").alias("to"), F.col("comp").alias("was"))
        jump = near.select(F.col("node").alias("to"), F.col("to").alias("then"))
        new = cut(near.join(jump, "to").select("node", F.least("to", "then").alias("comp"), "was"))
        release(labels)
        if new.filter("comp <> was").isEmpty():
            release(both)
            out = new.select("node", "comp")
            out.torvane_path = new.torvane_path
            return out
        labels = new
    raise RuntimeError("components did not settle")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows with equal keys, which come in order, and where each group begins (and the last one ends)."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
        if held is None or not held.num_rows:
            continue
        key = np.stack([held.column(k).to_numpy() for k in keys], 1)
        start = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1]
        end = held.num_rows if batch is None else start[-1]
        if end:
            yield held.slice(0, end).combine_chunks(), start if end == start[-1] else np.append(start, end)
        held = held.slice(end)


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (keys, start, end, source, at), those that touch or overlap within a key joined into one.

    source and at are those of the interval that starts first. Partitions are read in order, so no key is held whole.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            t = t.combine_chunks()
            n = t.num_rows
            if n == 0:
                continue
            key = [t.column(k).to_numpy(zero_copy_only=False) for k in keys]
            start, end = t.column("start").to_numpy().copy(), t.column("end").to_numpy().copy()
            fresh = np.ones(n, bool)
            fresh[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in key])
            # the furthest end so far within a key: ends are lifted by a base for each key, so that one running maximum serves all
            group = np.cumsum(fresh) - 1
            span = int(end.max()) + 2
            reach = np.maximum.accumulate(end + group * span) - group * span
            new = fresh.copy()
            new[1:] |= start[1:] > reach[:-1]
            at = np.flatnonzero(new)
            last = np.append(at[1:], n) - 1
            out = t.take(pa.array(at))
            out = out.set_column(out.schema.get_field_index("end"), t.schema.field("end"), pa.array(reach[last]))
            held = out.slice(out.num_rows - 1)
            if out.num_rows > 1:
                yield from out.slice(0, out.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    rows = rows.select(*keys, "start", "end", "source", "at")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "start", "end", "source", "at")
    return dealt.mapInArrow(join, rows.schema)
