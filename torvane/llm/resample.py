"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A document's log importance weight is the sum, over its hashed word and word-pair features, of the log ratio between
the target model (labelled good rows) and the raw model (all rows). Adding Gumbel noise and keeping the k largest
draws k documents without replacement in proportion to their weights. k is the number of documents whose weight
reaches the level that best separates the labelled rows, or a given share. The k-th largest key is found by radix
selection over counts, so nothing is sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.llm import textnum as tn
from torvane.llm.shared import cut, longs, release

#: Buckets of features. Both models together are 1 MB, whatever the corpus.
BITS = 16
#: Labelled rows that the target model and the level are fitted on, at most: a sample by hash of the id.
MAX_LABELLED = 1 << 17
#: A labelled good row above the level counts as much as so many bad rows below it.
GOOD_COUNTS = 8
SMOOTH = 0.5
_MARKS = np.zeros(256, np.uint8)
_MARKS[33:127] = 2
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _MARKS[_lo : _hi + 1] = 1


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets, bounds by text): runs of letters and digits, and of marks, one by one and in pairs. Case counts."""
    for ws in tn.slices(column, tn.SPACED, tn.AS_IS):
        kind = _MARKS[ws.data]
        turn = np.ones(len(kind), bool)
        turn[1:] = kind[1:] != kind[:-1]
        turn[ws.offsets[:-1][ws.offsets[:-1] < len(kind)]] = True
        start = np.flatnonzero(turn & (kind > 0))
        every = np.append(np.flatnonzero(turn), len(kind))
        end = every[np.searchsorted(every, start, "right")]
        first = np.searchsorted(start, ws.offsets)
        tokens = tn.Words(ws.lo, ws.hi, ws.data, ws.offsets, start, end, first, ws.low)
        h = tokens.hashes()
        pair, whole = tokens.windows(h, 2)
        both = np.stack([h, np.where(whole, pair, 0)], 1).ravel()
        use = np.stack([np.ones(len(h), bool), whole], 1).ravel()
        edge = np.concatenate([[0], np.cumsum(use)])[2 * first]
        yield ws.lo, (both[use] >> np.uint64(64 - BITS)).astype(np.int32), edge


def _models(labels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, good = labels.value
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            own = batch.column("doc_id").fill_null(-1).to_numpy()
            at = np.searchsorted(ids, own)
            at[at == len(ids)] = 0
            is_good = (ids[at] == own) & good[at] & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(own), bool)
            for lo, b, edge in features(batch.column("text")):
                raw += np.bincount(b, minlength=1 << BITS)
                target += np.bincount(b[np.repeat(is_good[lo : lo + len(edge) - 1], np.diff(edge))], minlength=1 << BITS)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return run


def _weights(ratio, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, b, edge in features(batch.column("text")):
                rows = np.flatnonzero(np.diff(edge))
                n[lo : lo + len(edge) - 1] = np.diff(edge)
                if len(rows):
                    weight[lo + rows] = np.add.reduceat(ratio.value[b], edge[:-1][rows])
            h = tn.mix(batch.column("doc_id").fill_null(-1).to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            key = weight - np.log(-np.log(u))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(weight), pa.array(key), longs(_ordered(key)), longs(_ordered(weight))], names=["doc_id", "n_features", "log_weight", "key", "key_order", "weight_order"])

    return run


def _ordered(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(rows: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest of a column of longs: 16 bits a round, by counts of at most 65,536 values each. None if k < 1 or there are fewer."""
    if k < 1:
        return None
    prefix, rest = None, k
    for shift in (48, 32, 16, 0):
        own = rows if prefix is None else rows.filter(F.shiftright(key, shift + 16) == prefix)
        counts = sorted(((r[0], r[1]) for r in own.groupBy(F.shiftright(key, shift).alias("p")).count().collect()), reverse=True)
        for p, n in counts:
            if rest <= n:
                prefix = p
                break
            rest -= n
        else:
            return None
    return prefix


def _level(scored: DataFrame) -> int | None:
    """Of the labelled rows (weight_order, good), the order of the weight that separates them best: the middle of the best gap."""
    cells = scored.groupBy(F.shiftright("weight_order", 46).alias("p")).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).orderBy("p").collect()
    if not cells:
        return None
    bad_below = good_below = 0
    good, bad = (sum(c[x] for c in cells) for x in "gb")
    best, found = GOOD_COUNTS * good, [cells[0]["p"]]  # keeping all
    for c, after in zip(cells, [*[x["p"] for x in cells[1:]], None], strict=True):
        good_below, bad_below = good_below + c["g"], bad_below + c["b"]
        if after is None:
            break
        gain = GOOD_COUNTS * (good - good_below) + bad_below
        if gain > best:
            best, found = gain, [c["p"], after]
    if not bad:
        return None
    return (sum(found) // len(found)) << 46


def _kept(ratio, last: int | None, seed: int):
    weigh = _weights(ratio, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if last is None:
                continue
            slim = pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("text").cast(pa.string())], names=["doc_id", "text"])
            for scored in weigh(iter([slim])):
                yield batch.filter(pa.array(scored.column("key_order").to_numpy() >= last))

    return run


def _fitted(docs: DataFrame, labels: DataFrame, share: float | None, seed: int) -> tuple[DataFrame, object, int | None]:
    """(scored rows, broadcast ratio, key of the last row that is drawn)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    n = marked.count()
    if n > MAX_LABELLED:  # 31 bits of a hash; some thousand under the bound, so that the sample is within it
        marked = marked.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 33) < int((MAX_LABELLED - 4 * MAX_LABELLED**0.5) / n * (1 << 31)))
    held = marked.orderBy("doc_id").toArrow()
    ids, good = held.column("doc_id").to_numpy(), held.column("good").to_numpy().astype(bool)

    counts = docs.mapInArrow(_models(spark.sparkContext.broadcast((ids, good))), "bucket int, raw long, target long")
    counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    at, raw, target = counts.column("bucket").to_numpy(), np.full(1 << BITS, SMOOTH), np.full(1 << BITS, SMOOTH)
    raw[at] += counts.column("raw").to_numpy()
    if good.any():
        target[at] += counts.column("target").to_numpy()
    else:
        target = raw
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    ratio = spark.sparkContext.broadcast(ratio)
    scored = cut(docs.mapInArrow(_weights(ratio, seed), "doc_id long, n_features long, log_weight double, key double, key_order long, weight_order long"))

    if share is None:
        level = _level(scored.join(F.broadcast(marked), "doc_id").select("weight_order", "good"))
        k = scored.count() if level is None else scored.filter(F.col("weight_order") >= level).count()
    else:
        k = round(share * scored.count())
    return scored, ratio, kth_largest(scored, "key_order", k)


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, seed: int = 7) -> DataFrame:
    """Rows (doc_id, n_features, log_weight, key, kept) of all documents (doc_id, text); labels: (doc_id, quality, toxic).

    The target are rows labelled with quality 1 that aren't toxic; an id with labels that disagree is no target. Of
    the labelled rows a sample of at most MAX_LABELLED by hash is used; the raw model and all weights take every row.
    share: of the rows to keep; None for as many as reach the level that the labels give (all, if no label is bad).
    Null and empty texts have weight 0. Noise depends on seed and doc_id only, so repeated rows share one fate; rows
    tied with the k-th are kept. A null doc_id is never labelled. Without labels all rows are kept (or the share).
    Other columns are ignored; an empty table gives no rows.
    """
    scored, _, last = _fitted(docs, labels, share, seed)
    kept: Column = F.lit(False) if last is None else F.col("key_order") >= last
    return scored.select("doc_id", "n_features", "log_weight", "key", kept.alias("kept"))


def drawn(docs: DataFrame, labels: DataFrame, *, share: float | None = None, seed: int = 7) -> DataFrame:
    """The rows of docs, with all their columns, that resample() keeps. Weights are taken again row by row, so nothing is joined."""
    scored, ratio, last = _fitted(docs, labels, share, seed)
    release(scored)
    return docs.mapInArrow(_kept(ratio, last, seed), docs.schema)
