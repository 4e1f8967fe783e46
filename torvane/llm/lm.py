"""LM scoring by a gated recurrent network in numpy, with a class-factored softmax, beside a smoothed unigram base.

Words are counted over all training documents in Spark. The most frequent ones are the network's vocabulary; any
other word is one symbol for the network, times its smoothed share among such words, so a text's score is the
log-probability of its very words. Training is by truncated backpropagation over all training documents, dealt by a hash
into as many disjoint parts as there are rounds, and each part into shards of about SHARD tokens; a shard's documents come in one
order, and the weights that shards end with are averaged in Spark after each round, so that neither files nor partitions matter. Scoring
carries the state of each document from window to window to its end. Counts of the words that one broadcast table of fixed size can't hold are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torvane.llm import textnum as tn
from torvane.llm.langid import remainder
from torvane.llm.shared import cut, groups, longs, release

#: State size, classes of the softmax, words in a class. Their product bounds the vocabulary: 1,024 symbols.
HIDDEN, CLASSES, IN_CLASS = 16, 32, 32
VOCABULARY = CLASSES * IN_CLASS
#: Words whose counts are broadcast, at most (4 MB); the others' are joined.
HEAVY = 1 << 18
#: Training: rounds, each over its own part of the documents, streams side by side, steps of backpropagation, learning rate.
ROUNDS, STREAMS, STEPS, RATE = 2, 128, 16, 0.01
#: Updates that a pass over few symbols makes at least, if need be with fewer streams.
LEAST = 64
#: Tokens of a shard, about: their number grows with the corpus.
SHARD = 1 << 21
#: Weights are summed up as whole numbers of this part, in which no order of additions shows.
PART = 1 << 32
#: Steps that scoring takes before it turns states into probabilities.
WINDOW = 32
SMOOTH = 0.1
#: Hash of the end of a text, and the symbols for other words and for the end.
ENDING = np.uint64(0x5851F42D4C957F2D)
OTHER, END = 0, 1


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words and ends, bounds by text) of some texts at a time."""
    for ws in tn.slices(column, tn.SPACED):
        n = ws.hi - ws.lo
        bounds = ws.first + np.arange(n + 1)
        h = np.empty(bounds[-1], np.uint64)
        own = np.ones(len(h), bool)
        own[bounds[1:] - 1] = False
        h[own], h[~own] = ws.hashes(), ENDING
        yield ws.lo, h, bounds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.unique(h, return_counts=True) for _, h, _ in _tokens(batch.column("text"))]
        if parts:
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, at = np.unique(h, return_inverse=True)
            yield pa.record_batch([longs(u), pa.array(np.bincount(at, n).astype(np.int64))], names=["h", "n"])


class Table:
    """Hashes of words to their places, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.at, self.keys = np.full(1 << bits, -1, np.int32), np.append(keys, np.uint64(0))
        left = np.arange(len(keys))
        slot = (keys >> self.shift).astype(np.int64)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            again = self.at[slot] != left
            left, slot = left[again], (slot[again] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Of each hash, its place or -1."""
        out, left, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(left):
            at = self.at[slot]
            ok = (at >= 0) & (self.keys[at] == h[left])
            out[left[ok]] = at[ok]
            again = (at >= 0) & ~ok
            left, slot = left[again], (slot[again] + 1) & self.mask
        return out


class Network:
    """E: symbols to gate inputs, U: state to gates, C and c: classes, W and w: words in classes."""

    SHAPES = {"E": (VOCABULARY, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "C": (HIDDEN, CLASSES), "c": (CLASSES,), "W": (VOCABULARY, HIDDEN), "w": (VOCABULARY,)}
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in self.SHAPES.items():
            setattr(self, name, self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @classmethod
    def start(cls, counts: np.ndarray, seed: int) -> Network:
        """Small random weights, and biases that give each symbol its share of the counts."""
        net = cls(np.random.default_rng(seed).normal(0, 0.1, cls.SIZE))
        share = (counts + SMOOTH) / (counts + SMOOTH).sum()
        by_class = share.reshape(CLASSES, IN_CLASS).sum(1)
        net.c[:] = np.log(by_class)
        net.w[:] = np.log(share / np.repeat(by_class, IN_CLASS))
        return net

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = self.E[x], h @ self.U
        m = b[:, 2 * HIDDEN :]
        gates = a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN]
        gates *= np.float32(0.5)
        np.tanh(gates, out=gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = r * m
        n += a[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, m, n

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of the symbols y after the states h."""
        kind = y // IN_CLASS
        a = h @ self.C + self.c
        out = a[np.arange(len(y)), kind] - np.log(np.exp(a).sum(1))
        order, classes = self.by_class(kind)
        b = self.in_classes(h[order], classes)
        b += self.w.reshape(CLASSES, IN_CLASS)[kind[order]]
        out[order] += b[np.arange(len(y)), y[order] % IN_CLASS] - np.log(np.exp(b).sum(1))
        return out

    @staticmethod
    def by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """The order by class, and of each class that occurs its rows in that order and its words."""
        order = np.argsort(kind.astype(np.int16), kind="stable")
        ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        return order, [(slice(ends[k], ends[k + 1]), slice(k * IN_CLASS, (k + 1) * IN_CLASS)) for k in range(CLASSES) if ends[k] < ends[k + 1]]

    def in_classes(self, h: np.ndarray, classes: list[tuple[slice, slice]]) -> np.ndarray:
        """States, ordered by class, times the words of their classes."""
        out = np.empty((len(h), IN_CLASS), np.float32)
        for rows, own in classes:
            np.dot(h[rows], self.W[own].T, out=out[rows])
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the mean loss over [streams, steps], state h carried in (and reset where a text begins); the state to carry on."""
        g = Network(np.zeros(self.SIZE))
        steps, n = x.shape[1], x.shape[0]
        going = (x.T != END).astype(np.float32)[:, :, None]
        before, z, r, m, c, states = (np.empty((steps, n, HIDDEN), np.float32) for _ in range(6))
        for t in range(steps):
            before[t] = h * going[t]
            h, z[t], r[t], m[t], c[t] = self.step(x[:, t], before[t])
            states[t] = h
        hs, ys = states.reshape(-1, HIDDEN), y.T.ravel()
        kind, rows, scale = ys // IN_CLASS, np.arange(len(ys)), np.float32(1 / len(ys))
        p = hs @ self.C + self.c
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        loss = -np.log(p[rows, kind]).sum()
        p[rows, kind] -= 1
        p *= scale
        g.C[:], g.c[:], back = hs.T @ p, p.sum(0), p @ self.C.T
        order, classes = self.by_class(kind)
        ordered, word = hs[order], ys[order] % IN_CLASS
        q = self.in_classes(ordered, classes)
        q += self.w.reshape(CLASSES, IN_CLASS)[kind[order]]
        q -= q.max(1, keepdims=True)
        np.exp(q, out=q)
        q /= q.sum(1, keepdims=True)
        loss -= np.log(q[rows, word]).sum()
        q[rows, word] -= 1
        q *= scale
        more = np.empty_like(back)
        for at, own in classes:
            np.dot(q[at].T, ordered[at], out=g.W[own])
            g.w[own] = q[at].sum(0)
            np.dot(q[at], self.W[own], out=more[at])
        back[order] += more
        # how the gates' inputs change with the state, apart from d, the loss's slope there
        dn = (1 - z) * (1 - c * c)
        slopes = np.stack([(before - c) * z * (1 - z), dn * m * r * (1 - r), dn * r], 2)
        back, later = back.reshape(steps, n, HIDDEN), np.zeros_like(h)
        ds, inner, across = np.empty_like(z), np.empty((steps, n, 3 * HIDDEN), np.float32), np.ascontiguousarray(self.U.T)
        for t in reversed(range(steps)):
            d = np.add(back[t], later, out=ds[t])
            np.multiply(d[:, None], slopes[t], out=inner[t].reshape(n, 3, HIDDEN))
            later = inner[t] @ across
            later += d * z[t]
            later *= going[t]
        g.U[:] = before.reshape(-1, HIDDEN).T @ inner.reshape(-1, 3 * HIDDEN)
        inputs = inner  # of n its own input's slope, without r
        np.multiply(ds, dn, out=inputs[:, :, 2 * HIDDEN :])
        seen = x.T.ravel()
        order = np.argsort(seen, kind="stable")
        ids, first = np.unique(seen[order], return_index=True)
        g.E[ids] = np.add.reduceat(inputs.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        return g.flat, h, float(loss)


class _Adam:
    def __init__(self, n: int):
        self.m, self.v, self.t = np.zeros(n, np.float32), np.zeros(n, np.float32), 0

    def step(self, net: Network, g: np.ndarray) -> None:
        self.t += 1
        norm = float(np.sqrt(g @ g))
        g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        for mean, x, part in ((self.v, g * g, 0.001), (self.m, g, 0.1)):
            x -= mean
            x *= np.float32(part)
            mean += x
        rate = RATE * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        by = np.sqrt(self.v)
        by += np.float32(1e-8)
        np.divide(self.m, by, out=by)
        by *= np.float32(rate)
        net.flat -= by


def train_on(net: Network, symbols: np.ndarray, adam: _Adam, streams: int = STREAMS) -> float:
    """One pass over texts that follow each other, each closed by END. Returns the sum of losses."""
    streams = max(1, min(streams, len(symbols) // (LEAST * STEPS)))
    size = len(symbols) // streams
    if size < 1:
        return 0.0
    y = symbols[: size * streams].reshape(streams, size)
    x = np.concatenate([np.full((streams, 1), END, y.dtype), y[:, :-1]], 1)
    h, loss = np.zeros((streams, HIDDEN), np.float32), 0.0
    for t in range(0, size, STEPS):
        g, h, part = net.gradient(x[:, t : t + STEPS], y[:, t : t + STEPS], h)
        adam.step(net, g)
        loss += part
    rest = symbols[size * streams :]  # fewer than there are streams
    return loss + train_on(net, rest, adam, 1) if len(rest) else loss


def _dealt(words):
    """Rows (shard, key, ids): each text's symbols as 16-bit numbers, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, h, bounds in _tokens(batch.column("text")):
                ids = words.value.find(h)
                ids[(ids < 0) | (ids >= VOCABULARY)] = OTHER
                data = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((2 * bounds).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
                own = slice(lo, lo + len(bounds) - 1)
                yield pa.record_batch([batch.column("shard")[own], batch.column("key")[own], data], names=["shard", "key", "ids"])

    return run


def _trained(weights):
    """Of rows (shard, key, ids) in order: the weights that each shard ends with, in whole parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in groups(batches, ["shard"]):
            texts = t.column("ids").to_pylist()
            for a, b in zip(start[:-1], start[1:], strict=True):
                net = Network(weights.value.copy())
                train_on(net, np.frombuffer(b"".join(texts[a:b]), "<u2").astype(np.int32), _Adam(Network.SIZE))
                yield pa.record_batch([pa.array(np.arange(Network.SIZE, dtype=np.int32)), pa.array(np.rint(net.flat.astype(np.float64) * PART).astype(np.int64))], names=["at", "v"])

    return run


def document_scores(net: Network, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log-probabilities (natural) of whole texts side by side; their states go on from window to window."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    start, size = bounds[:-1][order], length[order]
    out = np.zeros(len(order))
    h, x = np.zeros((len(order), HIDDEN), np.float32), np.full(len(order), END, ids.dtype)
    t = 0
    while len(size) and t < size[0]:
        states, symbols, own = [], [], []
        for t in range(t, min(t + WINDOW, int(size[0]))):
            n = int(np.searchsorted(-size, -t, "left"))  # texts that have a symbol at t
            h[:n] = net.step(x[:n], h[:n])[0]
            y = ids[start[:n] + t]
            states.append(h[:n].copy())
            symbols.append(y)
            own.append(np.arange(n))
            x[:n] = y
        out += np.bincount(np.concatenate(own), net.log_probability(np.concatenate(states), np.concatenate(symbols)), len(out))
        t += 1
    result = np.empty(len(out))
    result[order] = out
    return result


def _scored(model):
    schema = pa.schema([("kind", pa.int8()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("h", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, table, heavy, log_all, log_other = model.value
        net, base_row = Network(flat), TaskContext.get().partitionId() << 33
        logs = np.log10(heavy + SMOOTH)
        for batch in batches:
            rows = batch.num_rows
            held = list(_tokens(batch.column("text")))
            ids, bounds, tails, base, score, known = [], [np.zeros(1, np.int64)], [], np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64)
            for lo, h, b in held:
                at, n = table.find(h), np.diff(b)
                doc = np.repeat(np.arange(lo, lo + len(n)), n)
                hit, inner = at >= 0, (at >= 0) & (at < VOCABULARY)
                counted = hit & (heavy[at] > 0)
                own = np.where(hit, logs[at], 0.0)
                base += np.bincount(doc, own, rows) - np.bincount(doc, minlength=rows) * log_all
                known += np.bincount(doc[counted], minlength=rows)
                other = ~inner
                score += np.bincount(doc[other], own[other], rows) - np.bincount(doc[other], minlength=rows) * log_other
                ids.append(np.where(inner, at, OTHER).astype(np.int32))
                bounds.append(bounds[-1][-1] + b[1:])
                if not hit.all():
                    d, x = doc[~hit], h[~hit]
                    order = np.lexsort((x, d))
                    d, x = d[order], x[order]
                    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
                    tails.append((d[first], x[first], np.diff(np.append(first, len(d)))))
            if rows:
                score += document_scores(net, np.concatenate(ids), np.concatenate(bounds)) / math.log(10)
                n = np.diff(np.concatenate(bounds))
                yield pa.record_batch([pa.array(np.zeros(rows, np.int8)), pa.array(base_row + np.arange(rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(known), pa.nulls(rows, pa.int64()), pa.array(base), pa.array(score)], schema=schema)
            if tails:
                d, x, tf = (np.concatenate(v) for v in zip(*tails, strict=True))
                void = [pa.nulls(len(d), k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.record_batch([pa.array(np.ones(len(d), np.int8)), pa.array(base_row + d), void[0], void[1], pa.array(tf.astype(np.int64)), void[2], longs(x), void[3], void[4]], schema=schema)
            base_row += rows

    return run


def score(docs: DataFrame, *, folds: int = 10, seed: int = 5) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents (doc_id, text).

    Learns from rows whose crc32 of the id as text isn't 0 modulo folds (a null id counts as 0). Tokens are words between white
    space, A-Z lower-cased, and one end for each text; a null text has its end only. base_score: sum of log10((c + 0.1) / (N + 0.1 * (V +
    1))) over tokens; score: the network's log10 probability of the text, other words at their smoothed share. Repeated rows
    count, and are scored, as often as they occur; other columns are ignored. Scores don't depend on how the table is partitioned. Without training rows the network stays
    as it starts; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (remainder(F.col("doc_id"), folds) == 0).alias("held_out"))
    learnt = docs.filter("not held_out")
    counts = cut(learnt.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # the counts from which on all words fit into the broadcast table: bins by eighths of a power of two, at most 512 of them
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("b")).count().orderBy(F.desc("b")).collect()
    least, room = None, HEAVY
    for b, n in bins:
        if n > room:
            break
        least, room = b, room - n
    often = counts.filter(F.lit(False) if least is None else F.floor(F.log2("c") * 8) >= least)
    rare = counts.join(often.select("h"), "h", "left_anti") if least is None else counts.filter(F.floor(F.log2("c") * 8) < least)
    ranked = often.toArrow()  # at most HEAVY rows
    h, c = ranked.column("h").to_numpy().view(np.uint64), ranked.column("c").to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    ends = int(c[h == ENDING].sum())
    h, c = h[h != ENDING], c[h != ENDING]
    inner = np.r_[0, ends, c[: VOCABULARY - 2]]
    inner = np.pad(inner, (0, VOCABULARY - len(inner)))
    left, left_kinds = total - int(inner.sum()), distinct - int((inner > 0).sum())
    # places in the table are symbols up to VOCABULARY; unused ones get keys that no word has but by chance
    filler = tn.mix(np.arange(1, VOCABULARY + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    keys = np.concatenate([[filler[0], ENDING], h[: VOCABULARY - 2], filler[2 + len(h[: VOCABULARY - 2]) :], h[VOCABULARY - 2 :]])
    heavy = np.concatenate([inner, c[VOCABULARY - 2 :]])
    table = Table(keys.astype(np.uint64))

    symbols = inner.copy()
    symbols[OTHER] = left
    flat = Network.start(symbols, seed).flat
    words = sc.broadcast(table)
    shards = max(1, -(-int(total) // (SHARD * ROUNDS)))
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    keyed = learnt.select("text", key.alias("key"))
    for k in range(ROUNDS):
        own = keyed.filter(F.pmod("key", F.lit(ROUNDS)) == k).withColumn("shard", F.pmod(F.shiftright("key", 8), F.lit(shards)).cast("int"))
        dealt = own.mapInArrow(_dealt(words), "shard int, key long, ids binary").repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "ids")
        told = dealt.mapInArrow(_trained(sc.broadcast(flat)), "at int, v long")
        mean = told.groupBy("at").agg((F.sum("v") / F.count("*") / PART).alias("v")).toArrow()  # a row for each weight
        if mean.num_rows:
            flat = np.zeros(Network.SIZE, np.float32)
            flat[mean.column("at").to_numpy()] = mean.column("v").to_numpy()

    log_all, log_other = math.log10(total + SMOOTH * (distinct + 1)), math.log10(left + SMOOTH * (left_kinds + 1))
    model = sc.broadcast((flat, table, heavy, log_all, log_other))
    kinds = "kind byte, row long, doc_id long, held_out boolean, n long, known long, h long, base double, score double"
    told = cut(docs.mapInArrow(_scored(model), kinds))
    tails = told.filter("kind = 1").select("row", "h", "n").join(rare, "h", "left")
    sums = tails.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"))
    out = told.filter("kind = 0").join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    out = cut(out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    ))
    release(told, counts)
    return out
