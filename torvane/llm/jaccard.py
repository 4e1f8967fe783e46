"""N-gram Jaccard join: documents whose shingle sets overlap enough, found with signature trees.

Every document becomes the set of hashes of its word shingles. Equal sets are one class from the start. Classes meet
under the first shingles of their sets in one global order (frequent ones last): two classes above the threshold share
such a shingle, and the first one that they share lies early enough in both. Each shingle's classes form a block.

Signature trees are built in each block: leaves hold a class's token bitmap, inner nodes the OR of their children's
bitmaps and the range of their sizes, and a dual traversal from the roots drops node pairs whose greatest possible
overlap is too small, or which are one group already. What is left connects classes to clusters outside of which there
are no links. In each cluster trees are built again, over bitmaps of the cluster's own shingles, whose leaves give
overlaps exactly; the traversal skips what links have joined already. Tasks hand on what joins their rows, a row for each
class at most, never pairs. Blocks and clusters beyond CHUNK are dealt into chunks: first, each is compared with one and the same chunk of
pivots, which joins groups of near copies in linear time; then what still stands apart from a group's main part is
compared with the rest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.llm import textnum as tn
from torvane.llm.shared import bitmap, components, cut, groups, longs, release

#: The table of frequent shingles has this many buckets: a fixed bound for what is broadcast.
SKETCH_BITS = 18
#: Classes, and shingles of sets, that a task compares with as many others; larger blocks and clusters are dealt as pairs of chunks.
CHUNK, TOKENS = 2048, 1 << 21
#: Children of a node, and node pairs that a traversal looks at together.
FANOUT, SLICE = 8, 1 << 14
#: Bits of a token bitmap for each shingle, at least; bits of one in a cluster, at most.
SPREAD, WIDEST = 2, 8192
#: Rows of one shingle that are looked at together before they are handed on as they are; frequent shingles are dealt into parts of about as many.
HELD = 1 << 15


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text that has words."""
    for ws in tn.slices(column, tn.SPACED):
        h = ws.hashes()
        win, whole = ws.windows(h, k)
        for i in range(ws.hi - ws.lo):
            a, b = ws.first[i], ws.first[i + 1]
            if b - a >= k:
                yield ws.lo + i, np.unique(win[a : b - k + 1])
            elif b > a:
                short = tn.Words(0, 1, ws.data, ws.offsets, ws.start[a:b], ws.end[a:b], np.array([0, b - a]), ws.low)
                yield ws.lo + i, short.windows(h[a:b], int(b - a))[0][:1]


def digest(s: np.ndarray) -> np.uint64:
    """Of a set, whatever its order; 0 is kept for no set."""
    return tn.mix(np.array([tn.mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0] | np.uint64(1)


def signature(s: np.ndarray) -> bytes:
    """Token bitmap of a set, of 64 bits or as many as the power of two that holds its size SPREAD times."""
    bits = max(64, 1 << int(SPREAD * len(s) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[s & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _summaries(k: int):
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            n, node, sig = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), [b""] * batch.num_rows
            buckets = [np.zeros(0, np.int64)]
            for row, s in shingle_sets(batch.column("text"), k):
                n[row], node[row], sig[row] = len(s), digest(s), signature(s)
                buckets.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
            sketch += np.bincount(np.concatenate(buckets), minlength=len(sketch))
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int8)), batch.column("doc_id"), pa.array(n), longs(node), pa.array(sig, pa.binary())], schema=schema)
        # buckets well above what an even spread would give; any set of them leaves the join exact
        mean = sketch.mean()
        at = np.flatnonzero(sketch > mean + 6 * np.sqrt(mean) + 6)
        if len(at):
            yield pa.record_batch([pa.array(np.ones(len(at), np.int8)), pa.nulls(len(at), pa.int64()), pa.array(sketch[at]), pa.array(at), pa.nulls(len(at), pa.binary())], schema=schema)

    return run


def _prefixes(k: int, num: int, den: int, level):
    """Rows (token, part, node, w) of the first shingles of each set; w: the set's size and, below 32 bits, the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = []
            for _, s in shingle_sets(batch.column("text"), k):
                if (d := int(digest(s))) in seen:
                    continue
                seen.add(d)
                rank = level.value[s >> np.uint64(64 - SKETCH_BITS)]
                if rank.any():
                    order = np.argsort(rank, kind="stable")
                    s, rank = s[order], rank[order]
                m = len(s) - -(-num * len(s) // den) + 1
                parts = 1 << np.maximum(rank[:m].astype(np.int64) - HELD.bit_length(), 0)
                part = np.where(parts > 1, 1 + int(tn.mix(np.array([d], np.uint64))[0] >> np.uint64(40)) % parts, 0)
                found.append((s[:m], part, np.full(m, d, np.uint64), (len(s) << 32) + np.arange(m)))
            if found:
                yield pa.record_batch([longs(np.concatenate(x)) for x in zip(*found, strict=True)], names=["token", "part", "node", "w"])

    return run


def _fits(n: np.ndarray, m: np.ndarray, most: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m shingles that share at most so many can be similar enough."""
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & ((num + den) * most >= num * (n + m))


def _shared(num: int, den: int):
    """Of rows (token, part, node, w) in order, those whose token another set has that may be similar, as far as sizes and places say."""

    def told(rows: np.ndarray, big: np.ndarray) -> pa.RecordBatch:
        n = rows[:, 3] >> 32
        rest = n - (rows[:, 3] & (1 << 32) - 1)
        return pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 2]), pa.array(n), pa.array(rest), pa.array(big)], names=["token", "node", "n", "rest", "big"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = np.zeros((0, 4), np.int64), None  # rows of a block that isn't over; the block of which rows are told
        for batch in itertools.chain(batches, [None]):
            rows = held
            if batch is not None:
                rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], 1)])
            if not len(rows):
                continue
            rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]]
            start = np.r_[0, np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1]
            size = np.diff(np.append(start, len(rows)))
            held = rows[:0]
            if batch is not None:
                held, start, size = rows[start[-1] :], start[:-1], size[:-1]
            keep, big = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
            if len(start) and begun == (*rows[0, :2],):
                keep[: size[0]] = big[: size[0]] = True
                start, size = start[1:], size[1:]
            n = rows[:, 3] >> 32
            rest = n - (rows[:, 3] & (1 << 32) - 1)
            salted = rows[start, 1] > 0
            for a, m in zip(start[salted], size[salted], strict=True):
                keep[a : a + m] = big[a : a + m] = True
            for m in np.unique(size[~salted & (size > 1)]):
                own = start[~salted & (size == m)]
                if m <= 64:
                    for lo in range(0, len(own), -(-(1 << 21) // (m * m))):
                        at = own[lo : lo + -(-(1 << 21) // (m * m)), None] + np.arange(m)
                        x, r = n[at], rest[at]
                        ok = _fits(x[:, :, None], x[:, None], np.minimum(r[:, :, None], r[:, None]), num, den)
                        ok[:, np.arange(m), np.arange(m)] = False
                        keep[at] = ok.any(2)
                else:
                    for a in own:
                        order = a + np.argsort(n[a : a + m], kind="stable")
                        near = den * n[order[:-1]] >= num * n[order[1:]]
                        keep[order[:-1]] |= near
                        keep[order[1:]] |= near
                        big[a : a + m] = m > CHUNK
            begun = None if batch is None or begun != (*held[0, :2],) else begun
            if len(held) > HELD:
                begun = (*held[0, :2],)
                yield told(held[:-1], np.ones(len(held) - 1, bool))
                held = held[-1:]
            if keep.any():
                yield told(rows[keep], big[keep])

    return run


class Tree:
    """Signature tree over sets of one bitmap width: level 0 are the leaves, each next level ORs FANOUT nodes of the one below.

    row: places of the sets in their block; rest: shingles of each, at most, that another one can share.
    """

    def __init__(self, row: np.ndarray, n: np.ndarray, rest: np.ndarray, filled: np.ndarray, sig: np.ndarray):
        self.row, self.n, self.rest, self.filled, self.narrower = row, n, rest, filled, {}
        slack = filled - np.bitwise_count(sig).sum(1, dtype=np.int64)  # shingles that share a bit with another of their set
        self.levels = [(sig, n, n, slack, rest)]
        while len(self.levels[-1][0]) > 1:
            sig, least, most, slack, rest = self.levels[-1]
            at = np.arange(0, len(sig), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(sig, at, 0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(slack, at), np.maximum.reduceat(rest, at)))

    def folded(self, width: int) -> Tree:
        """The tree of the same sets at a bitmap width, where more shingles of a set share bits."""
        sig = self.levels[0][0]
        if sig.shape[1] == width:
            return self
        if width not in self.narrower:
            self.narrower[width] = Tree(self.row, self.n, self.rest, self.filled, _fold(sig, width))
        return self.narrower[width]

    def named(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the nodes of each level, the least and the largest label below."""
        out = [(label[self.row],) * 2]
        while len(out) < len(self.levels):
            at = np.arange(0, len(out[-1][0]), FANOUT)
            out.append((np.minimum.reduceat(out[-1][0], at), np.maximum.reduceat(out[-1][1], at)))
        return out


def _fold(sig: np.ndarray, width: int) -> np.ndarray:
    while sig.shape[1] > width:
        half = sig.shape[1] // 2
        sig = sig[:, :half] | sig[:, half:]
    return sig


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives the rows i and j, pair by pair, one label: the least row that they reach."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label[np.maximum(a, b)] = np.minimum(a, b)
        while (label[label] != label).any():
            label[:] = label[label]


def traverse(x: Tree, y: Tree, label: np.ndarray, num: int, den: int, verify=None) -> None:
    """Unites the labels of sets, one of either tree, that may overlap enough, or do by verify(rows, rows). Pairs of one label are skipped."""
    width = min(x.levels[0][0].shape[1], y.levels[0][0].shape[1])
    x, y = x.folded(width), y.folded(width)
    cx, cy = x.named(label), y.named(label)
    ahead = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while ahead:
        lx, ly, i, j = ahead.pop()
        if len(i) > SLICE:
            ahead += [(lx, ly, i[lo : lo + SLICE], j[lo : lo + SLICE]) for lo in range(0, len(i), SLICE)]
            continue
        if x is y and lx == ly:
            i, j = i[i <= j], j[i <= j]
        (sx, nx, mx, kx, rx), (sy, ny, my, ky, ry) = x.levels[lx], y.levels[ly]
        (ax, bx), (ay, by) = cx[lx], cy[ly]
        keep = (den * mx[i] >= num * ny[j]) & (den * my[j] >= num * nx[i])  # sizes
        keep &= ~((ax[i] == bx[i]) & (ay[j] == by[j]) & (ax[i] == ay[j]))  # one label already
        i, j = i[keep], j[keep]
        most = np.bitwise_count(sx[i] & sy[j]).sum(1, dtype=np.int64) + np.minimum(kx[i], ky[j])
        most = np.minimum(most, np.minimum(rx[i], ry[j]))
        keep = (num + den) * most >= num * (nx[i] + ny[j])
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if lx == 0 and ly == 0:
            i, j = x.row[i], y.row[j]
            if verify is not None:
                ok = verify(i, j, label)
                i, j = i[ok], j[ok]
            if len(i):
                unite(label, i, j)
                cx, cy = x.named(label), y.named(label)
            continue
        up = max(lx, ly)
        for side in (0, 1):  # each node of the upper level gives way to its children
            if (lx, ly)[side] < up:
                continue
            here, other = (i, j) if side == 0 else (j, i)
            child = (here[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            other, ok = np.repeat(other, FANOUT), child < len((x, y)[side].levels[up - 1][0])
            i, j = (child[ok], other[ok]) if side == 0 else (other[ok], child[ok])
        ahead.append((lx - (lx == up), ly - (ly == up), i, j))


def _binary(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([*column.to_pylist(), None], object)[:-1]


class _Joined:
    """Nodes that a task has told as joined; a pair is told if it joins more. Forgets when it holds too many, and may tell twice then."""

    def __init__(self):
        self.head: dict[int, int] = {}

    def find(self, v: int) -> int:
        head, path = self.head, []
        while (up := head.get(v, v)) != v:
            path.append(v)
            v = up
        for p in path:
            head[p] = v
        return v

    def new(self, pairs: Iterator[tuple[int, int]]) -> pa.RecordBatch | None:
        if len(self.head) > 1 << 20:
            self.head = {}
        out = []
        for a, b in pairs:
            x, y = self.find(a), self.find(b)
            if x != y:
                self.head[max(x, y)] = min(x, y)
                self.head.setdefault(min(x, y), min(x, y))
                out.append((a, b))
        if out:
            a, b = np.array(out, np.int64).T
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
        return None


def _star(node: np.ndarray, label: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of nodes that join what labels have joined beyond the first ones."""
    at = np.flatnonzero(label != first)
    return zip(node[at].tolist(), node[label[at]].tolist(), strict=True)


def _first_labels(comp: np.ndarray) -> np.ndarray:
    _, first, at = np.unique(comp, return_index=True, return_inverse=True)
    return first[at]


def _few(c: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of nodes that may link in blocks of at most FANOUT rows, which are trees of one level: leaves against leaves."""
    held = []
    for m in np.unique(size):
        i, j = np.triu_indices(m, 1)
        own = start[size == m][:, None]
        held.append(((own + i).ravel(), (own + j).ravel()))
    if not held:
        return
    i, j = (np.concatenate(x) for x in zip(*held, strict=True))
    n, rest, comp, side = c["n"], c["rest"], c["comp"], c["side"]
    keep = _fits(n[i], n[j], np.minimum(rest[i], rest[j]), num, den) & (comp[i] != comp[j]) & (side[i] + side[j] > 0)
    i, j = i[keep], j[keep]
    wide = c["width"]
    for u, v in {*zip(wide[i].tolist(), wide[j].tolist(), strict=True)}:
        at = np.flatnonzero((wide[i] == u) & (wide[j] == v))
        for lo in range(0, len(at), SLICE):
            a, b = i[at[lo : lo + SLICE]], j[at[lo : lo + SLICE]]
            p, q = (_fold(np.frombuffer(b"".join(c["sig"][x]), np.uint64).reshape(len(x), -1), min(u, v) // 8) for x in (a, b))
            slack = np.minimum(n[a] - np.bitwise_count(p).sum(1, dtype=np.int64), n[b] - np.bitwise_count(q).sum(1, dtype=np.int64))
            most = np.bitwise_count(p & q).sum(1, dtype=np.int64) + slack
            ok = (num + den) * most >= num * (n[a] + n[b])
            yield from zip(c["node"][a[ok]].tolist(), c["node"][b[ok]].tolist(), strict=True)


def joined_in_block(c: dict[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, labels before) of the rows of one block: those that a chain of candidates joins have one label. Rows of side 0 aren't compared among themselves."""
    first = _first_labels(c["comp"])
    label, by = first.copy(), {}
    for width in np.unique(c["width"]):
        for side in (1, 0):
            own = np.flatnonzero((c["width"] == width) & (c["side"] == side))
            if len(own):
                own = own[np.lexsort((c["n"][own], label[own]))]
                sig = np.frombuffer(b"".join(c["sig"][own]), np.uint64).reshape(len(own), -1)
                by[width, side] = Tree(own, c["n"][own], c["rest"][own], c["n"][own], sig)
    for (w, s), x in by.items():
        for (v, r), y in by.items():
            if s + r and w <= v and num * v <= 2 * den * w and (w < v or s >= r):  # widths of sets whose sizes may fit
                traverse(x, y, label, num, den)
    return label, first


def _candidates(num: int, den: int):
    """Pairs of nodes that join, block by block, the sets that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        for t, start in groups(batches, ["token", "c", "d"]):
            c = {k: t.column(k).to_numpy() for k in ("node", "comp", "n", "rest", "side")}
            c["sig"] = _binary(t.column("sig"))
            c["width"] = np.array([len(s) for s in c["sig"]])
            size = np.diff(start)
            few = size <= FANOUT
            if (out := joined.new(_few(c, start[:-1][few], size[few], num, den))) is not None:
                yield out
            for a, m in zip(start[:-1][~few], size[~few], strict=True):
                own = {k: v[a : a + m] for k, v in c.items()}
                if (out := joined.new(_star(own["node"], *joined_in_block(own, num, den)))) is not None:
                    yield out

    return run


def linked_in_cluster(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, labels before) of sets: those that a chain of links joins have one label. Rows of side 0 aren't compared among themselves.

    The bitmaps are of the shingles that two of the sets have, a bit for each as long as there are at most WIDEST, so that their
    common bits are the overlap; beyond, bits are shared and the overlap is counted.
    """
    first = _first_labels(comp)
    label, n = first.copy(), np.array([len(s) for s in sets])
    row, (token, at) = np.repeat(np.arange(len(sets)), n), np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at) > 1
    row, at = row[often[at]], (np.cumsum(often) - 1)[at[often[at]]]
    kinds = int(often.sum())
    width = -(-max(1, min(kinds, WIDEST)) // 64)
    flags = np.zeros((len(sets), width * 64), np.uint8)
    flags[row, at % (width * 64)] = 1
    sig = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
    filled = np.bincount(row, minlength=len(sets))

    def overlaps(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(i), bool)
        done: set[tuple[int, int]] = set()
        for x, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            if (label[a], label[b]) not in done:
                both = np.concatenate([sets[a], sets[b]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok[x] = den * common >= num * (len(both) - common)
                if ok[x]:
                    done |= {(label[a], label[b]), (label[b], label[a])}
        return ok

    least = np.array([s[0] for s in sets])
    trees = {}
    for s in (1, 0):
        own = np.flatnonzero(side == s)
        if len(own):
            own = own[np.lexsort((n[own], least[own], label[own]))]
            trees[s] = Tree(own, n[own], filled[own], filled[own], sig[own])
    for s, y in trees.items():
        traverse(trees[1], y, label, num, den, overlaps if kinds > WIDEST else None)
    return label, first


def _links(num: int, den: int):
    """Pairs of nodes that join, cluster by cluster, the sets that links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        for t, start in groups(batches, ["token", "c", "d"]):
            node, comp, side = (t.column(k).to_numpy() for k in ("node", "comp", "side"))
            s = _binary(t.column("s"))
            for a, b in zip(start[:-1], start[1:], strict=True):
                if (side[a:b] == 1).any():
                    sets = [np.frombuffer(x, np.uint64) for x in s[a:b]]
                    if (out := joined.new(_star(node[a:b], *linked_in_cluster(sets, comp[a:b], side[a:b], num, den)))) is not None:
                        yield out

    return run


def _wanted_sets(k: int, wanted, nameless: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            near = np.flatnonzero(np.where(none, nameless, wanted.value.has(tn.mix(ids.astype(np.int64).view(np.uint64)))))
            if not len(near):
                continue
            nodes, sets = [], []
            for _, s in shingle_sets(batch.column("text").take(pa.array(near)), k):
                if (d := digest(s)) not in seen:
                    seen.add(int(d))
                    nodes.append(d)
                    sets.append(s.tobytes())
            yield pa.record_batch([longs(np.array(nodes, np.uint64)), pa.array(sets, pa.binary())], names=["node", "s"])

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([longs(tn.mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)))], names=["h"])


def _whole_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Rows (node, s) of the nodes (node, doc_id), their sets built again from the texts: of documents with such an id, and of all without one if a node has none."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(nodes.filter("doc_id is not null").select("doc_id").mapInArrow(_mixed, "h long"), "h"))
    nameless = not nodes.filter("doc_id is null").isEmpty()
    sets = docs.select("doc_id", "text").mapInArrow(_wanted_sets(k, wanted, nameless), "node long, s binary")
    return cut(sets.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")))


def _chunk(q: Column) -> Column:
    return F.pmod(F.xxhash64("node"), q).cast("int")


def _pivots(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of the tokens in sizes (token, q), dealt into q chunks each, of which the first one meets itself and every other; these meet themselves too."""
    own = rows.join(sizes, "token").withColumn("own", _chunk(F.col("q")))
    own = own.withColumn("d", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("q") - 1)).otherwise(F.array("own"))))
    return own.withColumn("side", (F.col("own") == F.col("d")).cast("int")).withColumn("c", F.lit(0)).withColumn("comp", F.col("node")).drop("own", "q")


def _apart(rows: DataFrame, sizes: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the same tokens where components (node, comp) leave several: chunks of the rows outside of a token's largest one meet all chunks."""
    rows = cut(rows.join(sizes, "token").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    by = rows.groupBy("token", "comp", "q").agg(F.count("*").alias("m")).groupBy("token", "q")
    by = by.agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("m")).filter("m > most.m")
    part = lambda m: F.greatest(F.lit(1), F.ceil(F.col("q") * m / F.col("m"))).cast("int")
    by = by.select("token", F.col("most.comp").alias("main"), part(F.col("m") - F.col("most.m")).alias("o"), part(F.col("most.m")).alias("g"))
    own = rows.drop("q").join(by, "token")
    main = F.col("comp") == F.col("main")
    own = own.withColumn("z", F.when(main, F.col("o") + _chunk(F.col("g"))).otherwise(_chunk(F.col("o"))))
    spot = lambda c, d, side: F.struct(c.cast("int").alias("c"), d.cast("int").alias("d"), F.lit(side).alias("side"))
    later = F.transform(F.sequence(F.col("z"), F.col("o") + F.col("g") - 1), lambda c: spot(c, F.col("z"), 1))
    before = lambda n: F.filter(F.transform(F.sequence(F.lit(0), n), lambda d: spot(F.col("z"), d, 0)), lambda s: s.d < n)
    spots = F.when(main, before(F.col("o"))).otherwise(F.concat(later, before(F.col("z"))))
    return own.withColumn("spot", F.explode(spots)).select("*", "spot.c", "spot.d", "spot.side").drop("spot", "main", "o", "g", "z")


def _resolved(rows: DataFrame, sizes: DataFrame, attach, task, done: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) that join the nodes of rows (token, node, big, ...), as task finds in tokens and, where sizes (token, q) say so, in pairs of chunks."""

    def found(dealt: DataFrame) -> DataFrame:
        dealt = attach(dealt).repartition("token", "c", "d").sortWithinPartitions("token", "c", "d")
        done.append(cut(dealt.mapInArrow(task, "a long, b long")))
        return done[-1]

    zero = F.lit(0)
    small = rows.filter("not big").withColumns({"d": zero, "side": F.lit(1), "c": zero, "comp": F.col("node")})
    if sizes.isEmpty():
        return found(small)
    large = rows.filter("big")
    edges = found(small.unionByName(_pivots(large, sizes)))
    done.append(components(edges))
    return edges.union(found(_apart(large, sizes, done[-1])))


def similar_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of all documents (doc_id, text; other columns don't matter).

    Documents are linked when den * |common shingles| >= num * |all shingles of both|. A document of fewer than k words
    has its whole sequence as one shingle; one without words (or with a null text) has none, is linked with nothing and
    is its own component. component_id is the smallest doc_id that links reach. Repeated rows are linked like any copies
    and all returned; a null doc_id keeps its row, links like any other, never names a component, and gets that of what it links (null if none has an id).
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    told = cut(docs.mapInArrow(_summaries(k), "kind byte, doc_id long, n long, node long, sig binary"))
    each, filled = told.filter("kind = 0"), told.filter("kind = 0 and n > 0")
    classes = cut(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    frequent = told.filter("kind = 1").groupBy(F.col("node").alias("bucket")).agg(F.log2(F.sum("n")).cast("int").alias("level"))
    for bucket, rank in frequent.collect():  # at most 2 ** SKETCH_BITS rows
        level[bucket] = rank + 1
    prefixes = docs.filter("text is not null").mapInArrow(_prefixes(k, num, den, spark.sparkContext.broadcast(level)), "token long, part long, node long, w long")
    ordered = prefixes.repartition("token", "part").sortWithinPartitions("token", "part", "node")
    members = cut(ordered.mapInArrow(_shared(num, den), "token long, node long, n long, rest long, big boolean"))
    done = [told, classes, members]

    chunks = lambda m, w: F.ceil(F.greatest(m / CHUNK, w / TOKENS)).cast("int")
    sizes = cut(members.filter("big").groupBy("token").agg(chunks(F.count("*"), F.lit(0)).alias("q")))
    done.append(sizes)
    signed = lambda rows: rows.join(classes.select("node", "sig"), "node")
    near = _resolved(members, sizes, signed, _candidates(num, den), done)
    clusters = components(near)

    inside = cut(clusters.join(classes.select("node", "doc_id", "n"), "node").select(F.col("comp").alias("token"), "node", "doc_id", "n"))
    sizes = cut(inside.groupBy("token").agg(chunks(F.count("*"), F.sum("n")).alias("q")).filter("q > 1"))
    sets = _whole_sets(docs, inside, k)
    rows = inside.join(sizes.withColumnRenamed("token", "t"), F.col("token") == F.col("t"), "left").select("token", "node", F.col("t").isNotNull().alias("big"))
    done += [clusters, inside, sizes, sets]
    edges = _resolved(rows, sizes, lambda rows: rows.join(sets, "node"), _links(num, den), done)
    comps = components(edges)

    smallest = classes.join(comps, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    heads = smallest.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    heads = cut(smallest.join(heads, "comp").select("node", "component_id"))
    linked = filled.select("doc_id", "n", "node").join(heads, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = cut(linked.unionByName(each.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))
    release(heads, comps, *done)
    return out
