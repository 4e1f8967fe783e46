"""Benchmark decontamination by winnowing: minimal k-gram hashes of sliding windows, joined and extended to whole windows.

Any span of w + k - 1 words keeps the least hash of its w k-grams, in a document as in an item, so every window of that
length which both hold shows itself by a common fingerprint. A document's fingerprints are first looked up in a
bitmap of the benchmark's, whose size has a fixed bound; around those found, the windows that cover them are hashed
whole and joined with the benchmark's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from torvane.llm import textnum as tn
from torvane.llm.shared import Bitmap, bitmap, cut, longs, release

#: Words of a fingerprint.
K = 5


def _selected(ws: tn.Words, h: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes, and which are the least of a window of span words inside one text."""
    g, _ = ws.windows(h, k)
    _, whole = ws.windows(h, span)
    w = span - k + 1
    least, sel = tn.sliding_min(g, w), np.zeros(len(g), bool)
    for d in range(min(w, len(g))):
        n = len(g) - d
        sel[d:] |= whole[:n] & (g[d:] == least[:n])
    return g, sel


def _item_rows(span: int, k: int):
    """kind 0: fingerprints; 1: windows, of whole items where those are shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ws in tn.slices(batch.column("text"), tn.ALNUM):
                h = ws.hashes()
                g, sel = _selected(ws, h, span, k)
                doc = ws.doc + ws.lo
                win, whole = ws.windows(h, span)
                parts = [(0, k, doc[sel], g[sel]), (1, span, doc[whole], win[whole])]
                for n in range(1, span):
                    short = np.flatnonzero(ws.count == n)
                    if len(short):
                        parts.append((1, n, short + ws.lo, ws.windows(h, n)[0][ws.first[short]]))
                for kind, n, rows, hashes in parts:
                    if len(rows):
                        yield pa.record_batch([pa.array(np.full(len(rows), kind, np.int8)), pa.array(np.full(len(rows), n, np.int32)), longs(hashes), batch.column("item").take(pa.array(rows))], names=["kind", "len", "h", "item"])

    return run


def _doc_rows(span: int, k: int, marks, shorts):
    """A row of each text (kind 0), and its windows that may be an item's (kind 1)."""
    schema = pa.schema([("kind", pa.int8()), ("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("len", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked: Bitmap = marks.value
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            n, found = np.zeros(batch.num_rows, np.int64), []
            for ws in tn.slices(batch.column("text"), tn.ALNUM):
                n[ws.lo : ws.hi] = ws.count
                h = ws.hashes()
                g, sel = _selected(ws, h, span, k)
                at = np.flatnonzero(sel)
                at = at[marked.has(g[at])]
                parts = []
                if len(at):  # windows that cover the fingerprint
                    starts = np.unique((at[:, None] - np.arange(span - k + 1)).ravel())
                    win, whole = ws.windows(h, span)
                    starts = starts[starts >= 0]
                    starts = starts[whole[starts]]
                    parts.append((span, starts, win[starts]))
                for m, few in shorts.value.items():
                    win, whole = ws.windows(h, m)
                    starts = np.flatnonzero(whole)
                    starts = starts[few.has(win[starts])]
                    parts.append((m, starts, win[starts]))
                doc = ws.doc
                for m, starts, hashes in parts:
                    own = doc[starts]
                    found.append((own + ws.lo, starts - ws.first[own], np.full(len(starts), m, np.int32), hashes))
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int8)), pa.array(base + np.arange(len(n))), batch.column("doc_id"), batch.column("key"), pa.array(n), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())], schema=schema)
            if found:
                row, start, size, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch([pa.array(np.ones(len(row), np.int8)), pa.array(base + row), batch.column("doc_id").take(pa.array(row)), pa.nulls(len(row), pa.int64()), pa.array(start), pa.array(size), longs(hashes)], schema=schema)
            base += len(n)

    return run


def hits(docs: DataFrame, items: DataFrame, *, span: int = 10, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(rows, places, windows, tables): rows (row, doc_id, key, n_words) of all documents, (row, start, len, h) of each place where one
    holds a window of some item, (len, h, item) of the items' windows, and the tables to release once these aren't read any more."""
    sc = docs.sparkSession.sparkContext
    told = cut(items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).mapInArrow(_item_rows(span, k), "kind byte, len int, h long, item string").distinct())
    marks = bitmap(told.filter("kind = 0").select("h").distinct(), "h")
    lengths = [r[0] for r in told.filter(f"kind = 1 and len < {span}").select("len").distinct().collect()]  # fewer than span
    shorts = {n: bitmap(told.filter(f"kind = 1 and len = {n}").select("h").distinct(), "h", 22) for n in sorted(lengths)}
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    slim = docs.select(doc_id, text, F.xxhash64(doc_id, text).alias("key"))
    kinds = "kind byte, row long, doc_id long, key long, start long, len int, h long"
    seen = cut(slim.mapInArrow(_doc_rows(span, k, sc.broadcast(marks), sc.broadcast(shorts)), kinds))
    rows = seen.filter("kind = 0").select("row", "doc_id", "key", F.col("start").alias("n_words"))
    windows = told.filter("kind = 1").select("len", "h", "item")
    places = cut(seen.filter("kind = 1").select("row", "start", "len", "h").join(windows.select("len", "h").distinct(), ["len", "h"], "left_semi"))
    return rows, places, windows, [told, seen, places]


def contamination(docs: DataFrame, items: DataFrame, *, span: int = 10, k: int = K) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of all documents (doc_id, text); items: (item_id, text).

    A window is span consecutive words of an item, or a whole item of fewer words, but not none. n_hit counts a
    document's words inside any window that occurs in it, n_items the distinct non-null item ids whose windows occur;
    the digest is of those ids, sorted as strings and joined by commas. Null and empty texts have no words; repeated
    rows are judged one by one; items with a null id count as hits, not as items. Equality of windows is that of
    64-bit hashes. Other columns are ignored; no items means no hits, and an empty table gives no rows.
    """
    rows, places, windows, tables = hits(docs, items, span=span, k=k)
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = places.select("row", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    # an item is told once for each document and window, wherever and however often the window stands
    named = places.select("row", "len", "h").distinct().join(windows, ["len", "h"]).select("row", "item").distinct().groupBy("row").agg(F.count("item").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("ids"))
    out = rows.join(covered.join(named, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = cut(out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))
    release(*tables)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, *, span: int = 10, k: int = K) -> DataFrame:
    """The rows of docs, with all their columns, that contamination() doesn't call contaminated. Rows alike in id and text share one fate."""
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    rows, places, _, tables = hits(docs, items, span=span, k=k)
    bad = cut(rows.join(places.select("row").distinct(), "row", "left_semi").select(F.col("key").alias("torvane_bad")).distinct())
    release(*tables)
    return docs.withColumn("torvane_key", key).join(bad, F.col("torvane_key") == F.col("torvane_bad"), "left_anti").drop("torvane_key")
