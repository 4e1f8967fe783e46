"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by language in each partition and sums the counts in Spark; the matrix of log-probabilities,
whose size has a fixed bound, is broadcast, and documents are scored in sparse batches with numpy.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.llm.textnum import mix

#: Buckets of n-grams, and cells of the matrix at most: with more languages there are fewer buckets.
BITS, CELLS = 16, 1 << 24
ORDERS = (1, 2, 3)
#: Characters that are scored at once.
SLICE = 1 << 19
SMOOTH = 0.5


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; that of a null id is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % n


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, bounds) of some texts at a time, lower-cased; null texts are empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    lo, held, size = 0, [], 0
    for i in range(len(texts)):
        held.append(texts[i].as_py().lower())
        size += len(held[-1])
        if size >= SLICE or i == len(texts) - 1:
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in held])])
            yield lo, np.frombuffer("".join(held).encode("utf-32-le"), np.uint32), bounds
            lo, held, size = i + 1, [], 0


def _grams(points: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds by text) of each order; runs of anything but letters count as one space."""
    letters = _letters()[points]
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first other character after a letter stands for the run
    keep[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    c = np.where(letters, points, 32).astype(np.uint64)[keep]
    edge = np.concatenate([[0], np.cumsum(keep)])[bounds]
    code = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            code = code[: len(code) - 1]
        code = (code << np.uint64(21)) | c[n - 1 :]
        if n in ORDERS:
            b = (mix(code + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int32)
            inside = np.minimum(np.maximum(edge[1:] - (n - 1), edge[:-1]), len(b))
            yield b, np.stack([np.minimum(edge[:-1], len(b)), inside], 1)


def _count(langs, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {lang: i for i, lang in enumerate(langs.value)}
        counts, docs = np.zeros(len(code) << bits, np.int64), np.zeros(len(code), np.int64)
        for batch in batches:
            lang = np.array([code[x] for x in batch.column("lang").to_pylist()], np.int64)
            docs += np.bincount(lang, minlength=len(code))
            for lo, points, bounds in _texts(batch.column("text")):
                for b, span in _grams(points, bounds, bits):
                    for k in np.unique(lang[lo : lo + len(span)]):
                        own = [b[s:e] for s, e in span[lang[lo : lo + len(span)] == k]]
                        counts[k << bits : (k + 1) << bits] += np.bincount(np.concatenate(own), minlength=1 << bits)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.concatenate([at, -1 - np.arange(len(docs))])), pa.array(np.concatenate([counts[at], docs]))], names=["cell", "n"])

    return run


def train(rows: DataFrame) -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """Languages by code point, bits, log priors and the matrix [bucket, language] of rows (text, lang) without null lang."""
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(CELLS >> 8).collect())
    if len(langs) >= CELLS >> 8:
        raise ValueError(f"{CELLS >> 8} languages or more")
    if not langs:
        return [], 1, np.zeros(0), np.zeros((2, 0), np.float32)
    bits = min(BITS, int(np.log2(CELLS // len(langs))))
    held = rows.sparkSession.sparkContext.broadcast(langs)
    cells = rows.mapInArrow(_count(held, bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
    counts, docs = np.zeros(len(langs) << bits), np.zeros(len(langs))
    counts[cell[cell >= 0]] = n[cell >= 0]
    docs[-1 - cell[cell < 0]] = n[cell < 0]
    counts = counts.reshape(len(langs), -1) + SMOOTH
    matrix = np.log(counts / counts.sum(1, keepdims=True)).T
    return langs, bits, np.log(docs / docs.sum()), np.ascontiguousarray(matrix, np.float32)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, bits, prior, matrix = model.value
        for batch in batches:
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for lo, points, bounds in _texts(batch.column("text") if langs else batch.column("text").slice(0, 0)):
                n = len(bounds) - 1
                has = np.diff(np.concatenate([[0], np.cumsum(_letters()[points])])[bounds]) > 0
                total = np.tile(prior, (n, 1))
                for b, span in _grams(points, bounds, bits):
                    rows = np.flatnonzero(span[:, 1] > span[:, 0])
                    if len(rows):
                        sums = np.add.reduceat(np.concatenate([matrix[b], np.zeros((1, len(langs)), np.float32)]), span[rows].ravel(), axis=0, dtype=np.float64)
                        total[rows] += sums[::2]
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i in np.flatnonzero(has):
                    pred[lo + i], score[lo + i] = langs[best[i]], share[i]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) of docs (doc_id, held_out, text), read from texts only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_score(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, *, folds: int = 3, test: int = 1) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) of all documents (doc_id, text, lang), learnt from those not held out.

    held_out: crc32 of the id as text, modulo folds, is test (a null id counts as remainder 0). score is the posterior
    probability of lang_pred. Texts that are null or have no letter are `und` with score 0, and so is every text
    if no row has a lang to learn. Ties go to the first language by code point. Repeated rows count as often as they
    occur; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), (remainder(F.col("doc_id"), folds) == test).alias("held_out"))
    return predict(docs, train(docs.filter("not held_out and lang is not null").select("text", "lang")))
