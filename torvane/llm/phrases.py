"""Substring dedup by automata of repeated phrases: passages that an earlier document holds too are taken out word by word.

A phrase is k words at a minimiser: where the hash of the k words from a place on is the least in a window of span words. Equal windows
have equal phrases, so a window that two documents share shows itself by a phrase that both have. Phrases of two documents or
more are dealt into shards; each shard is compiled into an Aho-Corasick automaton, and the parts of all documents that may hold one of its
phrases are streamed through it. Around every occurrence the windows of span words are compared: one that a document
with a smaller id has as well is taken out. Phrases with more than ROWS places are dealt into many shards by document, and
the windows around them meet by hash afterwards, the first document of each found by partial minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torvane.llm import textnum as tn
from torvane.llm.shared import bitmap, cut, groups, longs, merged, release
from torvane.llm.suffixes import keyed
from torvane.llm.winnow import _selected

#: Words of a window that counts as a copy, and of a phrase.
SPAN, K = 50, 10
#: Places of phrases in a shard, about; phrases with more of them are dealt into SALTS shards.
ROWS, SALTS = 1 << 15, 64
_LAST = np.iinfo(np.int64).max
_PIECE = "shard int, kind tinyint, doc long, key long, start long, words binary"
_FOUND = "h long, doc long, key long, spans array<struct<start: long, end: long>>"


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Ids as numbers; null comes last."""
    return batch.column("doc_id").fill_null(_LAST).to_numpy()


def _phrases(span: int, k: int):
    """Of each phrase of a batch: the least and the largest id of its documents, and how many places it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, gs, docs = _ids(batch), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for ws in tn.slices(batch.column("text"), tn.SPACED, tn.AS_IS):
                g, sel = _selected(ws, ws.hashes(), span, k)
                gs.append(g[sel])
                docs.append(ids[ws.doc[sel] + ws.lo])
            g, doc = np.concatenate(gs), np.concatenate(docs)
            by = np.lexsort((doc, g))
            g, doc = g[by], doc[by]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
            end = np.append(first[1:], len(g))[: len(first)]
            yield pa.record_batch([longs(g[first]), longs(doc[first]), longs(doc[end - 1]), longs(end - first)], names=["g", "lo", "hi", "n"])

    return run


def _binary(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """values[lo:hi] for each pair, four bytes a value."""
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    offsets = np.r_[0, np.cumsum(n) * 4].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values[at].astype("<u4").tobytes())])


def _pieces(span: int, k: int, shards: int, shared, hot):
    """Rows by shard: its phrases (kind 0, or 1 where they have very many places), and what may hold them (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _ids(batch), batch.column("key").to_numpy()
            for ws in tn.slices(batch.column("text"), tn.SPACED, tn.AS_IS):
                h = ws.hashes()
                g, sel = _selected(ws, h, span, k)
                at = np.flatnonzero(sel)
                at = at[shared.value.has(g[at])]
                if not len(at):
                    continue
                small = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))  # 0 stands between pieces
                doc, own = ws.doc[at], g[at]
                very = hot.value.has(own) if hot is not None else np.zeros(len(at), bool)
                salt = keys[doc + ws.lo].view(np.uint64) % np.uint64(SALTS)
                shard = (tn.mix(np.where(very, own + salt + np.uint64(1), own)) % np.uint64(shards)).astype(np.int64)
                _, once = np.unique(own + tn.mix(shard.astype(np.uint64)), return_index=True)
                # what lies around places of one shard is one piece where it touches
                by = np.lexsort((at, shard))
                a, d, s = at[by], doc[by], shard[by]
                lo, hi = np.maximum(a - (span - k), ws.first[d]), np.minimum(a + span, ws.first[d + 1])
                new = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (lo[1:] > hi[:-1])]
                end = np.append(np.flatnonzero(new)[1:], len(a)) - 1
                lo, hi, d, s = lo[new], hi[end], d[new], s[new]
                for kind, shard_of, doc_of, key_of, start, a, b in (
                    (very[once].astype(np.int8), shard[once], np.zeros(len(once), np.int64), np.zeros(len(once), np.int64), np.zeros(len(once), np.int64), at[once], at[once] + k),
                    (np.full(len(lo), 2, np.int8), s, ids[d + ws.lo], keys[d + ws.lo], lo - ws.first[d], lo, hi),
                ):
                    yield pa.record_batch([pa.array(shard_of.astype(np.int32)), pa.array(kind), longs(doc_of), longs(key_of), longs(start), _binary(small, a, b)], names=["shard", "kind", "doc", "key", "start", "words"])

    return run


def automaton(phrases: list[bytes], values: list[int]) -> ahocorasick.Automaton:
    """Finds phrases of four bytes a word in text of such words; a byte is a letter, so that places have few branches."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p, v in zip(phrases, values, strict=True):
        out.add_word(p.decode("latin-1"), v)
    out.make_automaton()
    return out


def _occurrences(of: ahocorasick.Automaton, text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of all phrases of k words in a text of words."""
    ends = np.fromiter((x for pair in of.iter(text.decode("latin-1")) for x in pair), np.int64).reshape(-1, 2)
    at = ends[:, 0] + 1 - 4 * k
    whole = at % 4 == 0  # the others begin inside of a word
    return at[whole] // 4, ends[whole, 1]


def _windows(words: np.ndarray, span: int) -> np.ndarray:
    up, down = tn._in_window(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(tn.mix(words.astype(np.uint64)) * up[: len(words)], out=total[1:])
    return tn.mix((total[span:] - total[:-span]) * down[: len(words) - span + 1])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before in some column."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _told(first: np.ndarray, h: np.ndarray | None, doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """A row for each group of spans, which begin at first."""
    spans = pa.StructArray.from_arrays([longs(start), longs(end)], names=["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(start)).astype(np.int32)), spans)
    return pa.record_batch([pa.nulls(len(first), pa.int64()) if h is None else longs(h[first]), longs(doc[first]), longs(key[first]), lists], names=["h", "doc", "key", "spans"])


def _search(span: int, k: int):
    """Of whole shards, phrases first: windows that an earlier document of the shard has (h is null), and those around phrases with very many places, unjudged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in groups(batches, ["shard"]):
            kinds, words = t.column("kind").to_numpy(), t.column("words").to_pylist()
            docs, keys, starts = (t.column(c).to_numpy() for c in ("doc", "key", "start"))
            for lo, hi in zip(edges, np.append(edges[1:], t.num_rows), strict=False):
                first = lo + int(np.searchsorted(kinds[lo:hi], 2))
                if lo == first or first == hi:
                    continue
                find = automaton(words[lo:first], kinds[lo:first].tolist())
                size = np.array([len(w) // 4 + 1 for w in words[first:hi]])
                off = np.cumsum(size) - size
                text = b"\0\0\0\0".join([*words[first:hi], b""])
                at, very = _occurrences(find, text, k)
                flat = np.frombuffer(text, "<u4")
                whole = np.cumsum(flat == 0)
                win = _windows(flat, span) if len(flat) >= span else np.zeros(0, np.uint64)
                for value in np.unique(very).tolist():
                    own = at[very == value]
                    near = np.zeros(len(flat) + 1, np.int64)
                    np.add.at(near, np.maximum(own - (span - k), 0), 1)
                    np.add.at(near, own + 1, -1)
                    s = np.flatnonzero(np.cumsum(near[:-1])[: len(win)])
                    s = s[whole[s + span - 1] == whole[s]]
                    s = s[flat[s] > 0]
                    piece = np.searchsorted(off, s, "right") - 1
                    h, doc, key, start = win[s], docs[first:hi][piece], keys[first:hi][piece], starts[first:hi][piece] + s - off[piece]
                    if value:  # a row for each window of a document, however often it has it
                        by = np.lexsort((start, key, doc, h))
                        h, doc, key, start = h[by], doc[by], key[by], start[by]
                        yield _told(_starts(h, doc, key), h, doc, key, start, start + span)
                        continue
                    by = np.lexsort((doc, h))
                    fresh = np.r_[True, h[by][1:] != h[by][:-1]][: len(by)]
                    least = doc[by][np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))]
                    late = np.sort(by[doc[by] > least])
                    if len(late):  # a row for each piece; windows at consecutive places are one span
                        s, piece, doc, key, start = s[late], piece[late], doc[late], key[late], start[late]
                        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1] + 1])
                        last = np.append(head[1:], len(s)) - 1
                        yield _told(_starts(piece[head]), None, doc[head], key[head], start[head], start[last] + span)

    return run


def _found(docs: DataFrame, span: int, k: int, rows: int) -> DataFrame:
    """Rows (doc, key, spans) of keyed() documents: spans to take out, which may overlap. A null id is _LAST."""
    spark = docs.sparkSession
    counts = docs.select("doc_id", "text").mapInArrow(_phrases(span, k), "g long, lo long, hi long, n long")
    counts = cut(counts.groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).filter("lo < hi").select("g", "n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows))
    shared = spark.sparkContext.broadcast(bitmap(counts, "g"))
    often = counts.filter(F.col("n") > rows)
    hot = None if often.isEmpty() else spark.sparkContext.broadcast(bitmap(often, "g"))
    release(counts)
    pieces = docs.mapInArrow(_pieces(span, k, shards, shared, hot), _PIECE).repartition("shard").sortWithinPartitions("shard", "kind")
    found = pieces.mapInArrow(_search(span, k), _FOUND)
    if hot is not None:
        found = cut(found)
        unjudged = found.filter("h is not null")
        firsts = unjudged.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("h", "least")
        found = found.filter("h is null").unionByName(unjudged.join(firsts, "h").filter("doc > least").select(found.columns))
    return found.select("doc", "key", "spans")


def located(docs: DataFrame, *, span: int = SPAN, k: int = K, rows: int = ROWS) -> DataFrame:
    """Rows (doc_id, key, start_word, end_word) of the documents (doc_id, text): the words that windows of span words cover which a document with a smaller id has too.

    Words stand between white space and are compared as they are; windows that touch or overlap are one row; places count from 0, end_word is the one
    behind. key is a hash of id and text, which names rows: repeated rows are one document, and an id with several texts has
    several. A row without an id comes after all others. Null, empty and short texts have no windows; copies within one document stay;
    other columns are ignored; an empty table gives no rows. Windows are compared by 32-bit hashes of their words.
    """
    spans = _found(keyed(docs), span, k, rows).select("doc", "key", F.inline("spans"))
    spans = merged(spans.select("doc", "key", "start", "end", F.lit(0).cast("long").alias("source"), F.col("start").alias("at")), ["doc", "key"])
    return spans.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "key", F.col("start").alias("start_word"), F.col("end").alias("end_word"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            words = (text or "").encode().split()  # at ASCII white space
            keep, at = [], 0
            for a, b in sorted((c["start"], c["end"]) for c in cuts or ()):
                keep += words[at:a]
                at = max(at, b)
            keep += words[at:]
            rows.append((len(words), len(words) - len(keep), b" ".join(keep).decode()))
        n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def without_copies(docs: DataFrame, *, span: int = SPAN, k: int = K, rows: int = ROWS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one for each of the documents: its words but those that located() says, joined by a blank.

    Null and empty texts have no words, and kept is empty; repeated rows are repeated.
    """
    own = keyed(docs)
    cuts = _found(own, span, k, rows).groupBy(F.col("doc").alias("id"), F.col("key").alias("of")).agg(F.flatten(F.collect_list("spans")).alias("cuts"))
    both = own.join(cuts, (own["key"] == cuts["of"]) & (F.coalesce(own["doc_id"], F.lit(_LAST)) == cuts["id"]), "left")
    return both.select("doc_id", "text", "cuts").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept string")
