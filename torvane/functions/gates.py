"""The protocols of share.py over numpy arrays, for tasks that take whole batches of rows: two arrays are a share of many values.

Arrays are of unsigned 64-bit numbers, which wrap. In rings of more bits they hold Python's whole numbers, which is slow, so those are for few values.
"""

from __future__ import annotations

import numpy as np

Share = tuple[np.ndarray, np.ndarray]


def add(x: Share, y: Share) -> Share:
    return x[0] + y[0], x[1] + y[1]


def subtract(x: Share, y: Share) -> Share:
    return x[0] - y[0], x[1] - y[1]


def xor(x: Share, y: Share) -> Share:
    return x[0] ^ y[0], x[1] ^ y[1]


def constant(c: int, like: Share) -> Share:
    """Public: party 1 holds it."""
    return np.zeros_like(like[0]), np.full_like(like[1], c)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers, in place: two multiplications, after each of which high bits are folded onto low ones."""
    high = np.empty_like(x)
    for by, shift in ((0xBF58476D1CE4E5B9, 32), (0x94D049BB133111EB, 29)):
        x *= by
        x ^= np.right_shift(x, shift, out=high)
    return x


class Gates:
    """Protocols in the ring of so many bits, a power of two. Randomness is a hash of seed, of how much was drawn before and of the place in an array, so a task
    that runs again on the same rows makes the same shares.
    """

    def __init__(self, *seed: int, bits: int = 64):
        if bits < 64 or bits & bits - 1:
            raise ValueError(f"64 bits or a power of two beyond: {bits}")
        self.bits, self.every, self.drawn = bits, (1 << bits) - 1, 0
        self.key, self.base = np.random.SeedSequence([s % (1 << 64) for s in seed]).generate_state(2, np.uint64), np.zeros(0, np.uint64)

    def kept(self, *parts: np.ndarray) -> Share:
        """What is left of numbers in the ring."""
        return parts if self.bits == 64 else tuple(x & self.every for x in parts)

    def random(self, n: int, like: np.ndarray) -> list[np.ndarray]:
        """So many arrays: hashes of places times odd numbers, other ones each time."""
        words, size = n * (self.bits // 64), len(like)
        if size > len(self.base):
            self.base = mixed(mixed(np.arange(size, dtype=np.uint64) + self.key[0]) + self.key[1])
        odd = mixed(np.arange(self.drawn, self.drawn + words, dtype=np.uint64) + self.key[1]) | 1
        self.drawn += words
        out = mixed(self.base[:size] * odd[:, None])
        if self.bits == 64:
            return list(out)
        return [sum(word << 64 * k for k, word in enumerate(w)) for w in out.reshape(n, self.bits // 64, size).astype(object)]

    def multiply(self, x: Share, y: Share) -> Share:
        """Beaver's product: x - u and y - v are opened, nothing else."""
        u0, u1, v0, v1, w0 = self.random(5, x[0])
        d, e = self.kept((x[0] - u0) + (x[1] - u1), (y[0] - v0) + (y[1] - v1))
        w1 = (u0 + u1) * (v0 + v1) - w0
        return self.kept(w0 + d * v0 + u0 * e, w1 + d * v1 + u1 * e + d * e)

    def ands(self, x: Share, *others: Share) -> list[Share]:
        """XOR shares of x AND each of the others; x is opened under its mask once."""
        u0, u1 = self.random(2, x[0])
        d, u = (x[0] ^ u0) ^ (x[1] ^ u1), u0 ^ u1
        out = []
        for y in others:
            v0, v1, w0 = self.random(3, x[0])
            e = (y[0] ^ v0) ^ (y[1] ^ v1)
            w1 = u & (v0 ^ v1) ^ w0
            out.append((w0 ^ d & v0 ^ u0 & e, w1 ^ d & v1 ^ u1 & e ^ d & e))
        return out

    def carry(self, x: Share, p: int) -> Share:
        """XOR shares of the carry out of the lowest p places of a shared value, where its two shares are added.

        Runs of places are joined two by two: g tells whether one makes a carry, q whether it passes one on. A run of 2 d places takes up one bit of 2 d, so after each
        round words are put together two by two, in which one's bits are d places lower, and a round is half the work of the one before.
        """
        n, blocks = len(x[0]), -(-len(x[0]) // self.bits)
        x = self.kept(*(np.concatenate([v, np.zeros(blocks * self.bits - n, v.dtype)]) << self.bits - p for v in x))
        zero, d, places = np.zeros_like(x[0]), 1, [0]
        (g,), q = self.ands((x[0], zero), (zero, x[1])), x
        while d < self.bits:
            more, *q = self.ands(q, *(self.kept(v[0] << d, v[1] << d) for v in ((g, q) if 2 * d < self.bits else (g,))))
            g, *q = (self._together(v, d) for v in (xor(g, more), *q))
            q, places, d = q[0] if q else None, [at + side * d for at in places for side in (0, 1)], 2 * d
        at = np.array([self.bits - 1 - k for k in places]).astype(g[0].dtype)[:, None]
        return tuple((v[None, :] >> at & 1).reshape(-1)[:n] for v in g)

    def _together(self, x: Share, d: int) -> Share:
        """Words of the first half with those of the second, of both the places whose number has the digit d."""
        half, places = len(x[0]) // 2, sum(1 << k for k in range(self.bits) if k & d)
        return tuple(v[:half] & places | (v[half:] & places) >> d for v in x)

    def to_ring(self, b: Share) -> Share:
        """An XOR-shared bit as additive shares: each party shares its own bit."""
        zero = np.zeros_like(b[0])
        both = self.multiply((b[0], zero), (zero, b[1]))
        return self.kept(b[0] - 2 * both[0], b[1] - 2 * both[1])

    def geq(self, x: Share, y: Share, p: int) -> Share:
        """Additive shares of 1 where x >= y, for differences below 2 ** p in size."""
        d = self.kept(*subtract(x, y))
        g = self.carry(d, p)
        b = [d[k] >> p & 1 ^ g[k] for k in (0, 1)]
        return self.to_ring((b[0], b[1] ^ 1))

    def mux(self, bit: Share, x: Share, y: Share) -> Share:
        """y + bit * (x - y)."""
        return self.kept(*add(y, self.multiply(bit, self.kept(*subtract(x, y)))))

    def widened(self, x: Share) -> Share:
        """Shares in this ring of what 64-bit shares add up to as an unsigned number: without 2 ** 64 where they pass it, which a shared bit tells."""
        if self.bits == 64:
            return x
        over = self.to_ring(tuple(v.astype(object) for v in Gates(*map(int, self.key), self.drawn).carry(x, 64)))
        return self.kept(*(x[k].astype(object) - (over[k] << 64) for k in (0, 1)))

    def narrowed(self, x: Share) -> Share:
        """64-bit shares of the same value modulo 2 ** 64."""
        return x if self.bits == 64 else tuple((v & (1 << 64) - 1).astype(np.uint64) for v in x)
