"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies. Documents are paired: word mass moves
at random from one to the other, so that expected copies stay, until one of the two is integral; the other one goes on to the next
pair. Sources are dealt into chunks, each leaves one residual, and residuals are paired again, level by level,
until one document of a source is fractional. That one is taken in part, so a source's words are its target's but for
rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from torvane.llm import textnum as tn
from torvane.llm.shared import cut, release

WEIGHTS = (3, 1, 2)
#: Documents, or residuals, that one chunk pairs, about.
CHUNK = 4096
_SIZED = "doc_id long, source string, size long, key long"
_STATE = "doc_id long, source string, size long, source_size long, target double, whole long, p double, key long, chunk long, settled boolean"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for ws in tn.slices(batch.column("text"), tn.SPACED, tn.AS_IS):
            n[ws.lo : ws.hi] = ws.count
        yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(n), batch.column("key")], names=["doc_id", "source", "size", "key"])


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Rows (source, source_size, n, target), one for each source of the rows (source, size).

    Sources by code point, null last, take the weights in turn and share in proportion to them share times all sizes;
    what goes beyond most times a source's size is shared again by weight among the others. That is the level at
    which min(cap, level * weight) sum up to the whole, found by a scan over the sources in order of cap / weight.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    by = by.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    by = by.withColumn("level", level).withColumn("free", F.col("level") <= F.col("cap") / F.col("w"))
    by = by.withColumn("at", F.min(F.when(F.col("free"), F.col("level"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.select("source", "source_size", "n", F.least("cap", F.coalesce(first * F.col("w"), F.col("cap"))).alias("target"))


def transfer(x: float, a: float, y: float, b: float, u: float) -> tuple[float, float]:
    """Masses 0 < x < a and 0 < y < b after a random move of which either outcome makes one of them 0 or full; u is uniform."""
    up, down = min(a - x, y), min(x, b - y)
    if u * (up + down) < down:
        return (a, y - up) if up == a - x else (x + up, 0.0)
    return (0.0, y + down) if down == x else (x - down, b)


def _paired(level: int, seed: int):
    """Of each (source, chunk), in order: rows that are settled now, and one that is still fractional at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        schema = None
        for batch in batches:
            schema = batch.schema
            rows = batch.to_pylist()
            salt = np.uint64((seed * 1_000_003 + level) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            draws = (tn.mix(batch.column("key").to_numpy().view(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) / 2.0**53
            out = []
            for row, u in zip(rows, draws.tolist(), strict=True):
                if (row["source"], row["chunk"]) != group:
                    if held is not None:
                        out.append(held)
                    group, held = (row["source"], row["chunk"]), None
                if held is None:
                    held = row
                    continue
                a, b = held["size"], row["size"]
                x, y = transfer(held["p"] * a, a, row["p"] * b, b, u)
                held["p"], row["p"] = x / a, y / b
                pair = [held, row]
                held = None
                for r in pair:
                    if 0 < r["p"] < 1:
                        held = r
                    else:
                        out.append(r | {"settled": True})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema)

    return run


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken) of all documents (doc_id, text, source).

    size counts a text's words; taken are the words that the mix takes of the document: its copies times its size, but for the one
    document of a source that is taken in part. None is above most (a whole number) times its size. Texts that are null or have no words take
    nothing. Choices come from a hash of doc_id and text, so that reruns agree whatever the partitions; repeated rows
    are rounded like any others, each on its own. A null source is a source, the last one. Without words all targets
    are 0; an empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    sized = cut(docs.mapInArrow(_sizes, _SIZED))
    goals = cut(targets(sized, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("r", rate).withColumn("whole", F.floor("r").cast("long"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("long")
    p = F.when(F.col("size") > 0, F.col("r") - F.col("whole")).otherwise(0.0)
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "whole", p.alias("p"), "key", F.pmod("key", chunks).alias("chunk"))
    rows = cut(rows.withColumn("settled", (F.col("p") <= 0) | (F.col("p") >= 1)))
    release(sized)
    done, left, tables = rows.filter("settled"), rows.filter("not settled"), [goals, rows]
    most_chunks, level = goals.agg(F.max(chunks)).first()[0] or 0, 0
    while most_chunks:
        dealt = left.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "key", "doc_id")
        after = cut(dealt.mapInArrow(_paired(level, seed), _STATE))
        tables.append(after)
        done = done.unionByName(after.filter("settled"))
        left = after.filter("not settled").withColumn("chunk", F.floor(F.col("chunk") / CHUNK).cast("long"))
        most_chunks, level = 0 if most_chunks == 1 else -(-most_chunks // CHUNK), level + 1
    copies = F.col("whole") * F.col("size") + F.round(F.col("p") * F.col("size")).cast("long")
    out = cut(done.unionByName(left).select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("taken")))
    release(*tables)
    return out
