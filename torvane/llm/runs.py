"""Periodic runs of words by partition refinement: classes of places with equal factors, refined from length to length.

At length l two places are in one class where the same l words stand from each on, in one text. Going to l + 1, the places before
a small class (all parts of a split class but its largest) are the only ones that can leave theirs, so a word is handled as often
as its class halves. Neighbours of a class that lie l apart at length l begin a square whose half is no power; squares of one period
at consecutive places are a run. A task refines some texts side by side, level by level, as numpy arrays: nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torvane.llm import textnum as tn

#: Words of the shortest run that counts.
LEAST = 12
#: Bytes of text whose words are refined side by side, unless a single text is longer.
SLICE = 1 << 22


class _Classes:
    """Places in classes: a class is a block of elems, and a list of its places in order by succ and pred (-1 at the ends)."""

    def __init__(self, doc: np.ndarray, symbol: np.ndarray):
        n = len(doc)
        order = np.lexsort((symbol, doc))  # stable: places of a class stay in order
        fresh = np.ones(n, bool)
        fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (symbol[order][1:] != symbol[order][:-1])
        ids = np.cumsum(fresh) - 1
        self.doc, self.elems, self.at = doc, order, np.empty(n, np.int64)
        self.at[order] = np.arange(n)
        self.of = np.empty(n, np.int64)
        self.of[order] = ids
        self.count = int(ids[-1]) + 1 if n else 0
        self.start, self.size = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.start[: self.count] = np.flatnonzero(fresh)
        self.size[: self.count] = np.diff(np.append(self.start[: self.count], n))
        self.succ, self.pred = np.full(n, -1), np.full(n, -1)
        inner = np.flatnonzero(~fresh)
        self.succ[order[inner - 1]], self.pred[order[inner]] = order[inner], order[inner - 1]

    def small_first(self) -> np.ndarray:
        """Places in all classes but the largest one of each text."""
        c = np.arange(self.count)
        doc = self.doc[self.elems[self.start[: self.count]]]
        order = np.lexsort((self.size[: self.count], doc))
        last = np.append(doc[order][1:] != doc[order][:-1], True)
        small = np.ones(self.count, bool)
        small[c[order][last]] = False
        return np.flatnonzero(small[self.of])

    def refine(self, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next length. small: places in the small classes of this one. Gives those of the next, and the places whose succ is new."""
        none = np.zeros(0, np.int64)
        x, sub = small - 1, self.of[small]
        own = x >= 0
        own[own] = (self.doc[x[own]] == self.doc[small[own]]) & (self.size[self.of[x[own]]] > 1)
        x, sub = x[own], sub[own]
        if not len(x):
            return none, none
        c = self.of[x]
        by = np.lexsort((x, sub, c))
        x, sub, c = x[by], sub[by], c[by]
        new_c = np.r_[True, c[1:] != c[:-1]]
        new_g = new_c | np.r_[True, sub[1:] != sub[:-1]]
        g_at = np.flatnonzero(new_g)
        g_n, g_c, g_top = np.diff(np.append(g_at, len(x))), c[g_at], new_c[g_at]
        top = np.flatnonzero(g_top)
        whose = np.cumsum(g_top) - 1  # of each group, its class among those met
        met = g_c[top]
        rest = self.size[met] - np.add.reduceat(g_n, top)
        # the part that keeps the class: what stays, or the largest group where nothing does
        most = np.maximum.reduceat(g_n, top)
        is_most = g_n == most[whose]
        first_most = is_most & (np.cumsum(is_most) - 1 == (np.cumsum(is_most) - is_most)[top][whose])
        keeps = first_most & (rest[whose] == 0)
        kept_n = np.where(rest == 0, most, rest)
        moves = ~keeps
        if not moves.any():
            return none, none
        in_group = np.cumsum(new_g) - 1
        go = moves[in_group]
        x, c, in_group = x[go], c[go], in_group[go]
        # the smaller parts: all but the largest of each class
        big_moves = (moves & first_most) & (most > kept_n)[whose]
        out = [x[~big_moves[in_group]]]
        # lists: moved places leave theirs, what they leave is joined, and each group is a list of its own
        by = np.lexsort((x, c))
        y, yc = x[by], c[by]
        chain = np.r_[True, (yc[1:] != yc[:-1]) | (self.succ[y[:-1]] != y[1:])]
        before, after = self.pred[y[chain]], self.succ[y[np.append(chain[1:], True)]]
        left, right = before >= 0, after >= 0
        self.succ[before[left]], self.pred[after[right]] = after[left], before[right]
        changed = before[left & right]
        first = np.r_[True, in_group[1:] != in_group[:-1]]
        was = self.succ[x]
        self.pred[x] = np.where(first, -1, np.r_[-1, x[:-1]])
        self.succ[x] = np.where(np.append(first[1:], True), -1, np.append(x[1:], -1))
        # blocks: moved places fill the end of theirs, group by group
        n_moved = np.bincount(np.searchsorted(met, c), minlength=len(met))
        touched = np.flatnonzero(n_moved)
        t_c, t_n = met[touched], n_moved[touched]
        zone_lo = self.start[t_c] + self.size[t_c] - t_n
        base = np.cumsum(t_n) - t_n
        slot = np.repeat(zone_lo - base, t_n) + np.arange(len(x))  # x is in order of classes, as the zones are
        inside = self.at[x] >= np.repeat(zone_lo, t_n)
        moved = np.zeros(len(x), bool)
        there = self.elems[slot]
        # what stays but lies in the zone swaps with what moves from outside of it
        zone_at = self.at[x[inside]] - np.repeat(zone_lo - base, t_n)[inside]
        moved[zone_at] = True
        stay = there[~moved]
        free = self.at[x[~inside]]
        self.elems[free], self.at[stay] = stay, free
        self.elems[slot], self.at[x] = x, slot
        # classes of their own for the groups that move
        g = np.flatnonzero(moves)
        ids = self.count + np.arange(len(g))
        n_g = g_n[g]
        name = np.empty(len(g_n), np.int64)
        name[g] = ids
        self.of[x] = name[in_group]
        self.start[ids], self.size[ids] = slot[first], n_g
        self.count += len(g)
        self.size[t_c] -= t_n
        # where a group that moved is the largest part, what stays is small
        small_stay = met[np.unique(whose[big_moves])]
        if len(small_stay):
            n = self.size[small_stay]
            at = np.repeat(self.start[small_stay] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(self.elems[at])
        return np.concatenate(out), np.concatenate([changed, x[self.succ[x] != was]])


def squares(doc: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, half) of all squares whose half is no power itself. doc doesn't fall; symbols are compared within one."""
    n_docs = int(doc[-1]) + 1 if len(doc) else 0
    count = np.bincount(doc, minlength=n_docs)
    # a place of its own behind each text ends its factors
    shift = np.arange(len(doc)) + doc
    n = len(doc) + n_docs
    whose, sym = np.repeat(np.arange(n_docs), count + 1), np.zeros(n, np.uint64)
    ends = np.cumsum(count + 1) - 1
    _, small = np.unique(symbol, return_inverse=True)
    sym[shift] = small + 1
    limit = np.repeat(ends, count + 1)  # of each place, the end of its text
    k = _Classes(whose, sym)
    room = (limit - np.arange(n)) // 2  # the longest half of a square from here
    due: dict[int, list[np.ndarray]] = {}
    found_at, found_l = [], []

    def push(at: np.ndarray, length: int) -> None:
        d = k.succ[at] - at
        ok = (d >= length) & (d <= room[at])
        at, d = at[ok], d[ok]
        if len(at) == 0:
            return
        by = np.argsort(d, kind="stable")
        at, d = at[by], d[by]
        cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        for v, part in zip(d[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
            due.setdefault(v, []).append(part)

    live = np.ones(n_docs, bool)
    length, small, look = 1, k.small_first(), 8
    push(np.flatnonzero(k.succ >= 0), 1)
    while True:
        for at in due.pop(length, ()):
            at = at[k.succ[at] - at == length]
            found_at.append(at)
            found_l.append(np.full(len(at), length))
        if length >= look:
            # a text is done once no two neighbours can begin a square any more: two places that lie at most half a length from
            # their neighbours belong to one period, and a square between such ones is a power
            d = k.succ - np.arange(n)
            open_ = (k.succ >= 0) & (2 * d > length) & (d <= room)
            live = np.bincount(whose[open_], minlength=n_docs) > 0
            look = length + length // 8 + 8
            small = small[live[whose[small]]]
        if not len(small):
            break
        small, changed = k.refine(small)
        length += 1
        if len(changed):
            push(changed, length)
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, half = np.concatenate(found_at), np.concatenate(found_l)
    return at - whose[at], half


def runs(doc: np.ndarray, symbol: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of runs of at least least words and two periods, by start, then period. Places count through all texts."""
    at, half = squares(doc, symbol)
    by = np.lexsort((at, half))
    at, half = at[by], half[by]
    # squares of one period at consecutive places of one text are one run
    new = np.ones(len(at), bool)
    new[1:] = (half[1:] != half[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    start, length, period = at[first], at[last] - at[first] + 2 * half[first], half[first]
    long = length >= least
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def planted(n: int, doc_id: int) -> np.ndarray:
    """Which of a text's n words stands at each place, where documents get a period by the CRC-32 of their id: a test bed for runs."""
    h = zlib.crc32(str(doc_id).encode())
    own, g = np.arange(n), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own[a:] = a + (own[a:] - a) % p
    return own


def _scan(least: int, plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for ws in tn.slices(batch.column("text"), tn.SPACED, tn.AS_IS, SLICE):
                symbol, doc, count = ws.hashes(), ws.doc, ws.count
                moved = {}
                if plant:
                    for i in np.flatnonzero(count):
                        own = planted(int(count[i]), ids[ws.lo + i]) if ids[ws.lo + i] is not None else None
                        if own is not None and own[-1] != len(own) - 1:
                            moved[i] = own
                            symbol[ws.first[i] : ws.first[i + 1]] = symbol[ws.first[i] + own]
                start, length, period = runs(doc, symbol, least)
                whose = doc[start]
                start = start - ws.first[whose]
                edge = np.searchsorted(whose, np.arange(ws.hi - ws.lo + 1))
                raw, rows = ws.data.tobytes(), []
                for i in range(ws.hi - ws.lo):
                    lo, hi = edge[i], edge[i + 1]
                    words = raw[ws.offsets[i] : ws.offsets[i + 1]].split()
                    if i in moved:
                        words = [words[j] for j in moved[i].tolist()]
                    found = list(zip(start[lo:hi].tolist(), length[lo:hi].tolist(), period[lo:hi].tolist(), strict=True))
                    if found:
                        drop = np.zeros(len(words) + 1, np.int32)
                        for s, n, q in found:
                            drop[s + q] += 1
                            drop[s + n] -= 1
                        words = [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]
                    rows.append((len(found), found, b" ".join(words).decode()))
                n_runs, found, texts = zip(*rows, strict=True)
                cols = [pa.array(n_runs, pa.int64()), pa.array([[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found], _RUNS), pa.array(texts, pa.string())]
                yield pa.record_batch([batch.column("doc_id").slice(ws.lo, ws.hi - ws.lo), *cols], names=["doc_id", "n_runs", "runs", "collapsed"])

    return run


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, *, least: int = LEAST, plant: bool = False) -> DataFrame:
    """Rows (doc_id, n_runs, runs, collapsed) of the documents (doc_id, text), one for each.

    A run is a stretch of words (between white space) with a smallest period q, of at least least words and two periods, that no
    neighbouring word extends; runs come by start, then period. collapsed has the words that no run holds behind its first q, joined by
    a blank. Null and empty texts have no words and no runs; repeated rows stay; ties are several runs; other columns are ignored; an empty table gives no rows.
    Words are compared by 64-bit hashes. plant: texts are first changed by planted(), but for rows without an id.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(least, plant), "doc_id long, n_runs long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """periodic_runs() with its longest run (then the first, then the shortest period) and digests in place of texts."""
    top = F.element_at(F.array_sort("runs", lambda x, y: F.when(x.length != y.length, F.signum((y.length - x.length).cast("double"))).when(x.start != y.start, F.signum((x.start - y.start).cast("double"))).otherwise(F.signum((x.period - y.period).cast("double"))).cast("int")), 1)
    line = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n"), F.lit("\n"))
    with_top = found.select("doc_id", "n_runs", F.when(F.col("n_runs") > 0, top).alias("top"), F.when(F.col("n_runs") > 0, line).otherwise("").alias("lines"), "collapsed")
    milli = F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return with_top.select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        milli.cast("long").alias("exponent_milli"), sha("lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"),
    )
