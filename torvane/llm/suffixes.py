"""Suffix-array dedup over sparse suffixes: those at content-selected minimiser positions, sorted, compared with neighbours, extended.

A suffix is kept where the hash of its first k words is the least in a window of such hashes, so every span of min_words
words that occurs twice keeps a suffix at the same place in each occurrence. Suffixes whose first k words occur once
are left out. The others meet those with the same first words, sorted by what follows, and once more by what goes before.
Neighbours that are compared in either order say with which suffixes one shares how many words to the right, and to
the left; where the two together make min_words, the match is extended by them. Of equal passages the first one, by
document and place, stays. Beginnings that more than ROWS suffixes have would fill a task: their windows of min_words
words are grouped by hash instead, summed up before they are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torvane.llm import textnum as tn
from torvane.llm.shared import bitmap, cut, groups, longs, merged, release

#: Words of a passage that counts as repeated, and of the hashed beginning of a suffix.
MIN_WORDS, K = 50, 40
#: Suffixes with one beginning that a task sorts, at most.
ROWS = 1 << 17
#: Parts that the places of one window are dealt into, where a beginning is beyond that.
SALTS = 64
_ROW = "g long, doc_id long, key long, pos long, lefts binary, rights binary"
_SPAN = "doc_id long, key long, start long, end long, source long"


def _minimisers(column: pa.Array, span: int, k: int) -> Iterator[tuple[tn.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, their hashes, hashes of k words, places of minimisers) of some texts at a time."""
    for ws in tn.slices(column, tn.SPACED):
        h = ws.hashes()
        g, _ = ws.windows(h, k)
        _, whole = ws.windows(h, span)
        w = span - k + 1
        least, sel = tn.sliding_min(g, w), np.zeros(len(g), bool)
        for d in range(min(w, len(g))):
            n = len(g) - d
            sel[d:] |= whole[:n] & (g[d:] == least[:n])
        yield ws, h, g, np.flatnonzero(sel)


def _beginnings(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [g[at] for _, _, g, at in _minimisers(batch.column("text"), span, k)]
            g, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            yield pa.record_batch([longs(g), pa.array(n.astype(np.int64))], names=["g", "n"])

    return run


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of 32-bit numbers as binary values in their order."""
    data = np.ascontiguousarray(values.astype(">u4"))
    offsets = (np.arange(len(data) + 1) * data.shape[1] * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _suffixes(span: int, k: int, shared, hot):
    m = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ws, h, g, at in _minimisers(batch.column("text"), span, k):
                at = at[shared.value.has(g[at])]
                if hot is not None:
                    at = at[~hot.value.has(g[at])]
                if not len(at):
                    continue
                small = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))  # 0 stands for no word
                doc = ws.doc[at]
                first, last = ws.first[doc][:, None], ws.first[doc + 1][:, None]
                left, right = at[:, None] - 1 - np.arange(m), at[:, None] + k + np.arange(m)
                lefts = np.where(left >= first, small[np.maximum(left, 0)], 0)
                rights = np.where(right < last, small[np.minimum(right, len(h) - 1)], 0)
                row = pa.array(doc + ws.lo)
                yield pa.record_batch(
                    [longs(g[at]), batch.column("doc_id").take(row), batch.column("key").take(row), pa.array((at - first[:, 0]).astype(np.int64)), _fixed(lefts), _fixed(rights)],
                    names=["g", "doc_id", "key", "pos", "lefts", "rights"],
                )

    return run


def _hot_windows(span: int, k: int, hot):
    """Rows (h, doc_id, key, start) of the windows of span words around hot beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ws, h, g, at in _minimisers(batch.column("text"), span, k):
                at = at[hot.value.has(g[at])]
                start = np.unique((at[:, None] - np.arange(span - k + 1)).ravel())
                win, whole = ws.windows(h, span)
                start = start[start >= 0]
                start = start[whole[start]]
                if len(start):
                    doc = ws.doc[start]
                    row = pa.array(doc + ws.lo)
                    yield pa.record_batch([longs(win[start]), batch.column("doc_id").take(row), batch.column("key").take(row), pa.array((start - ws.first[doc]).astype(np.int64))], names=["h", "doc_id", "key", "start"])

    return run


def _classes(words: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For suffixes in order of g and words: row p numbers those that share g and the first p words with a neighbour alike."""
    n, m = words.shape
    lcp = np.cumprod((words[1:] == words[:-1]) & (words[1:] > 0), axis=1).sum(1)
    lcp[g[1:] != g[:-1]] = -1
    out = np.zeros((m + 1, n), np.int64)
    for p in range(m + 1):
        np.cumsum(lcp < p, out=out[p, 1:])
    return out


def repeats(g: np.ndarray, rank: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes in order of g and rights: words to the left and right that together each shares with an earlier-ranked one (-1: with
    none), and the first in rank with which it shares the most to the left. lefts and rights are as many words as are needed."""
    n, m = rights.shape
    more, less, source = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    right = _classes(rights, g)
    two = lefts[:, ::2].astype(np.uint64) << np.uint64(32)  # two words at a time
    two[:, : m // 2] |= lefts[:, 1::2]
    order = np.lexsort((*two.T[::-1], g))
    left = np.empty_like(right)
    left[:, order] = _classes(lefts[order], g[order])
    for many in range(m + 1):  # words to the left
        a, b = right[m - many], left[many]
        own = np.flatnonzero((np.bincount(a)[a] > 1) & (np.bincount(b)[b] > 1))
        pair = a[own] * n + b[own]
        by = np.lexsort((rank[own], pair))
        own, pair = own[by], pair[by]
        fresh = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
        head = own[np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))]
        later = rank[own] > rank[head]
        i, j = own[later], head[later]
        less[i] = np.maximum(less[i], m - many)
        more[i], source[i] = many, j
    return more, less, source


def _matches(span: int, k: int):
    """Of rows in order of g and rights: spans that occur earlier."""
    m = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in groups(batches, ["g"]):
            g, pos = t.column("g").to_numpy(), t.column("pos").to_numpy()
            lefts, rights = (np.frombuffer(b"".join(t.column(c).to_pylist()), ">u4").reshape(-1, m).astype(np.uint32) for c in ("lefts", "rights"))
            doc, key = t.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy(), t.column("key").to_numpy()
            order = np.lexsort((pos, key, doc))
            fresh = np.ones(len(g), bool)
            fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1]) | (pos[order][1:] != pos[order][:-1])
            rank = np.empty(len(g), np.int64)
            rank[order] = np.cumsum(fresh)  # repeated rows share a rank
            more, less, source = repeats(g, rank, lefts, rights)
            at = np.flatnonzero(source >= 0)
            doc_id = t.column("doc_id")
            out = [doc_id.take(pa.array(at)), t.column("key").take(pa.array(at)), pa.array(pos[at] - more[at]), pa.array(pos[at] + k + less[at]), doc_id.take(pa.array(source[at]))]
            yield from pa.table(out, names=["doc_id", "key", "start", "end", "source"]).to_batches()

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))


def repeated_spans(docs: DataFrame, *, min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """Rows (doc_id, key, start_word, end_word, first_doc_id) of the documents (doc_id, text): passages that occur earlier.

    A passage is a union of windows of min_words words (between white space, A-Z lower-cased), each of which another document, or an
    earlier place of the same one, holds too; the occurrence first by doc_id (null last), key (a hash of id and text) and
    place is not returned, and of each window it stays. Windows that overlap or touch are one row. Words are counted from 0, end_word is the one
    behind. first_doc_id is the first document with the passage's first window. Rows that repeat an id and its text
    are one document here. Null, empty and short texts have no passages; other columns are ignored; an empty table
    gives no rows. Beginnings are compared by 64-bit hashes, words of the extension by 32-bit ones.
    """
    sc = docs.sparkSession.sparkContext
    docs = keyed(docs)
    counts = docs.select("text").mapInArrow(_beginnings(min_words, k), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter("n > 1"))
    shared = sc.broadcast(bitmap(counts, "g"))
    often = counts.filter(F.col("n") > ROWS)
    hot = None if often.isEmpty() else sc.broadcast(bitmap(often, "g"))
    release(counts)
    rows = docs.mapInArrow(_suffixes(min_words, k, shared, hot), _ROW)
    spans = rows.repartition("g").sortWithinPartitions("g", "rights").mapInArrow(_matches(min_words, k), _SPAN)
    if hot is not None:
        windows = docs.mapInArrow(_hot_windows(min_words, k, hot), "h long, doc_id long, key long, start long").distinct()
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start")
        firsts = windows.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
        # one window may have very many places: they are dealt by a salt, and its first place goes to each
        firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = windows.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)).cast("int"))
        later = dealt.join(firsts, ["h", "salt"]).filter(place != F.col("first"))
        spans = spans.unionByName(later.select("doc_id", "key", "start", (F.col("start") + min_words).alias("end"), F.col("first.doc_id").alias("source")))
    whole = spans.select("key", "start", "end", "source", F.col("start").alias("at"), F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"))
    whole = merged(whole, ["id", "key"])
    return cut(whole.select(F.when(F.col("id") != -1 << 63, F.col("id")).alias("doc_id"), "key", F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("source").alias("first_doc_id")))


def _without(schema: pa.Schema, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, texts = batch.column("torvane_cuts").to_pylist(), batch.column("text").to_pylist()
            for ws in tn.slices(batch.column("text"), tn.SPACED):
                for i in range(ws.lo, ws.hi):
                    if not cuts[i]:
                        continue
                    a, b = ws.first[i - ws.lo], ws.first[i - ws.lo + 1]
                    left, keep = int(ws.offsets[i - ws.lo]), []
                    for c in sorted(cuts[i], key=lambda c: c["start_word"]):
                        keep.append(ws.data[left : ws.start[a + c["start_word"]]])
                        left = int(ws.start[a + c["end_word"]]) if a + c["end_word"] < b else int(ws.offsets[i - ws.lo + 1])
                    keep.append(ws.data[left : ws.offsets[i - ws.lo + 1]])
                    texts[i] = b"".join(x.tobytes() for x in keep).decode()
            out = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.record_batch(out, names=names)

    return run


def without_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """docs (doc_id, text and any other columns) without the passages that repeated_spans() returns.

    Documents of which nothing but white space is left go, if a passage was cut from them. n_chars, where there is
    such a column, follows the text.
    """
    spans = repeated_spans(docs, min_words=min_words, k=k)
    cuts = spans.groupBy(F.col("doc_id").alias("torvane_id"), F.col("key").alias("torvane_key")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("torvane_cuts"))
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    both = docs.withColumn("torvane_own", key)
    both = both.join(cuts, (both["torvane_own"] == cuts["torvane_key"]) & both["doc_id"].cast("long").eqNullSafe(cuts["torvane_id"]), "left").drop("torvane_own", "torvane_id", "torvane_key")
    out = both.mapInArrow(_without(None, [*docs.columns, "torvane_cuts"]), both.schema)
    out = out.filter(F.col("torvane_cuts").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("torvane_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
