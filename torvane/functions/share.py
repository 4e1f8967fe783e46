"""Values as two shares, and operators on shares that open to what the plain operators give.

A share is a struct (s0, s1); additive ones sum to the value, XOR ones (Z_2) combine to it bit by bit. Randomness comes from
hashes of a row's own columns and a salt, so a task that runs again makes the same shares. One job that holds both
shares checks the algebra; it keeps nothing secret.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.functions.ring import big


@dataclass(frozen=True)
class Pair:
    """The two parts of a share as expressions. A struct column of a frame serves as one too, as it has the same fields."""

    s0: Column
    s1: Column

    def __getitem__(self, part: str) -> Column:
        return getattr(self, part)

    @property
    def column(self) -> Column:
        return F.struct(self.s0.alias("s0"), self.s1.alias("s1"))

    def alias(self, name: str) -> Column:
        return self.column.alias(name)


def pair(s0: Column, s1: Column) -> Pair:
    return Pair(s0.cast("bigint"), s1.cast("bigint"))


class Held:
    """Rows that get the intermediate shares of an operator as plain columns, round by round, so that each is computed once, in generated code."""

    def __init__(self, rows: DataFrame):
        self.rows, self.own, self.n = rows, rows.columns, 0

    def hold(self, *shares: Pair) -> list[Pair]:
        """The same shares, read from columns."""
        names = [f"torvane_{self.n + i}_" for i in range(len(shares))]
        self.n += len(shares)
        self.rows = self.rows.withColumns({name + part: x[part] for name, x in zip(names, shares, strict=True) for part in ("s0", "s1")})
        return [Pair(F.col(f"{name}s0"), F.col(f"{name}s1")) for name in names]

    def done(self, **columns: Column) -> DataFrame:
        """The rows with these columns, and without what was held."""
        return self.rows.select(*self.own, *(c.alias(k) for k, c in columns.items()))


def open_sum(s: Pair) -> Column:
    return s.s0 + s.s1


def open_xor(s: Pair) -> Column:
    return s.s0.bitwiseXOR(s.s1)


def add(x: Pair, y: Pair) -> Pair:
    return pair(x.s0 + y.s0, x.s1 + y.s1)


def subtract(x: Pair, y: Pair) -> Pair:
    return pair(x.s0 - y.s0, x.s1 - y.s1)


def scale(x: Pair, by: int) -> Pair:
    return pair(x.s0 * big(by), x.s1 * big(by))


def constant(c: int) -> Pair:
    """Public: party 1 holds it."""
    return pair(big(0), big(c))


def negate01(x: Pair) -> Pair:
    """1 - x."""
    return pair(-x.s0, big(1) - x.s1)


def xor_shares(x: Pair, y: Pair) -> Pair:
    return pair(x.s0.bitwiseXOR(y.s0), x.s1.bitwiseXOR(y.s1))


def truncate_local(x: Pair, f: int) -> Pair:
    """Each party shifts its own share; the opened value is that of truncate() or one more, unless shares wrap (about |x| / 2 ** 64)."""
    return pair(-F.shiftrightunsigned(-x.s0, f), F.shiftrightunsigned(x.s1, f))


def _place(v: Column, p: int) -> Column:
    return F.shiftrightunsigned(v, p).bitwiseAND(big(1))


@dataclass(frozen=True)
class Dealer:
    """Shares and correlated randomness for rows that differ in keys; each use takes a salt of its own."""

    keys: tuple[str, ...]
    seed: int = 1

    def random(self, *salt: str | Column) -> Column:
        return F.xxhash64(*(F.col(k) for k in self.keys), F.lit(self.seed), *(s if isinstance(s, Column) else F.lit(s) for s in salt))

    def share(self, x: Column, *salt) -> Pair:
        r = self.random("share", *salt)
        return pair(r, x - r)

    def share_bits(self, x: Column, *salt) -> Pair:
        r = self.random("bits", *salt)
        return pair(r, x.bitwiseXOR(r))

    def triple(self, *salt) -> tuple[Pair, Pair, Pair]:
        """Additive shares of u, v and u * v."""
        u, v = self.random("u", *salt), self.random("v", *salt)
        split = lambda x, name: pair(self.random(name, *salt), x - self.random(name, *salt))
        return split(u, "u0"), split(v, "v0"), split(u * v, "w0")

    def bit_triple(self, *salt) -> tuple[Pair, Pair, Pair]:
        """XOR shares of u, v and u & v."""
        u, v = self.random("bu", *salt), self.random("bv", *salt)
        split = lambda x, name: pair(self.random(name, *salt), x.bitwiseXOR(self.random(name, *salt)))
        return split(u, "bu0"), split(v, "bv0"), split(u.bitwiseAND(v), "bw0")

    def multiply(self, x: Pair, y: Pair, *salt) -> Pair:
        """Beaver's product: x - u and y - v are opened, nothing else."""
        u, v, w = self.triple(*salt)
        d, e = open_sum(subtract(x, u)), open_sum(subtract(y, v))
        return pair(w.s0 + d * v.s0 + u.s0 * e, w.s1 + d * v.s1 + u.s1 * e + d * e)

    def multiply_bits(self, x: Pair, y: Pair, *salt) -> Pair:
        """The AND of XOR-shared bits."""
        u, v, w = self.bit_triple(*salt)
        d, e = open_xor(xor_shares(x, u)), open_xor(xor_shares(y, v))
        one = lambda k: w[k].bitwiseXOR(d.bitwiseAND(v[k])).bitwiseXOR(u[k].bitwiseAND(e))
        return pair(one("s0"), one("s1").bitwiseXOR(d.bitwiseAND(e)))

    def xor01(self, x: Pair, y: Pair, *salt) -> Pair:
        return subtract(add(x, y), scale(self.multiply(x, y, "xor", *salt), 2))

    def or01(self, x: Pair, y: Pair, *salt) -> Pair:
        return subtract(add(x, y), self.multiply(x, y, "or", *salt))

    def mux(self, bit: Pair, x: Pair, y: Pair, *salt) -> Pair:
        """y + bit * (x - y)."""
        return add(y, self.multiply(bit, subtract(x, y), "mux", *salt))

    def bits_to_ring(self, b: Pair, *salt) -> Pair:
        """An XOR-shared bit as additive shares: s0 + s1 - 2 * s0 * s1, where each party shares its own bit."""
        return self.xor01(pair(b.s0.bitwiseAND(big(1)), big(0)), pair(big(0), b.s1.bitwiseAND(big(1))), "z2", *salt)

    def carries(self, at: Held, x: Pair, places: int, *salt) -> Pair:
        """XOR shares of the carries out of the lowest places of a shared value, where its two shares are added: all places
        together, in as many rounds of word-wide shared ANDs as the highest place has binary digits."""
        up = lambda v, d: pair(F.shiftleft(v.s0, d), F.shiftleft(v.s1, d))
        # all places at once: g has those that make a carry, q those that pass one on, over runs twice as long each time
        (g,), q, d = at.hold(self.multiply_bits(pair(x.s0, big(0)), pair(big(0), x.s1), "make", *salt)), x, 1
        while d < places:
            more = self.multiply_bits(q, up(g, d), "carry", str(d), *salt)
            g, q = at.hold(xor_shares(g, more), self.multiply_bits(q, up(q, d), "pass", str(d), *salt))
            d *= 2
        return g

    def bits(self, at: Held, x: Pair, places: Sequence[int], *salt) -> list[Pair]:
        """XOR shares of some bits of a shared value: both shares' bits and the carry into them."""
        (x,) = at.hold(x)
        g = self.carries(at, x, max(places), *salt)
        carry = lambda v, p: _place(v, p - 1) if p else big(0)
        return [pair(_place(x.s0, p).bitwiseXOR(carry(g.s0, p)), _place(x.s1, p).bitwiseXOR(carry(g.s1, p))) for p in places]

    def truncate(self, at: Held, x: Pair, f: int, *salt) -> Pair:
        """Shares of a signed value without its lowest f bits, rounded down: exactly what ring.truncate() gives.

        Both parties cut their own share, and add the carry out of the bits that are cut; where the shares as unsigned numbers pass 2 ** 64,
        and where the value is negative, 2 ** (64 - f) goes.
        """
        (x,) = at.hold(x)
        g = self.carries(at, x, 64, "cut", *salt)
        low = pair(_place(g.s0, f - 1), _place(g.s1, f - 1))
        over = pair(_place(g.s0, 63), _place(g.s1, 63))
        sign = pair(_place(x.s0, 63).bitwiseXOR(_place(g.s0, 62)), _place(x.s1, 63).bitwiseXOR(_place(g.s1, 62)))
        low, over, sign = at.hold(*(self.bits_to_ring(b, name, *salt) for b, name in ((low, "low"), (over, "over"), (sign, "sign"))))
        one = lambda k: F.shiftrightunsigned(x[k], f) + low[k] - F.shiftleft(over[k] + sign[k], 64 - f)
        return pair(one("s0"), one("s1"))

    def geq(self, at: Held, x: Pair, y: Pair, p: int, *salt) -> Pair:
        """XOR shares of 1 where x >= y, for differences below 2 ** p in size."""
        (b,) = self.bits(at, subtract(x, y), [p], "geq", *salt)
        return pair(b.s0, b.s1.bitwiseXOR(big(1)))

    def equal_bits(self, at: Held, x: Pair, y: Pair, n: int, *salt) -> Pair:
        """XOR shares of 1 where the lowest n bits of two XOR-shared words agree: the AND of all bits of ~(x ^ y), halved step by step."""
        every = big((1 << n) - 1 if n < 64 else -1)
        return self.and_all(at, pair(x.s0.bitwiseXOR(y.s0).bitwiseAND(every), x.s1.bitwiseXOR(y.s1).bitwiseXOR(big(-1)).bitwiseAND(every)), n, *salt)

    def and_all(self, at: Held, b: Pair, n: int, *salt) -> Pair:
        """XOR shares of the AND of the lowest n bits; the higher ones of both shares must be 0."""
        while n > 1:
            (b,), half = at.hold(b), n // 2
            low = big((1 << (n - half)) - 1)
            upper = pair(F.shiftrightunsigned(b.s0, n - half), F.shiftrightunsigned(b.s1, n - half))
            if n % 2:  # the odd bit out meets a one
                upper = pair(upper.s0, upper.s1.bitwiseOR(big(1 << half)))
            z = self.multiply_bits(pair(b.s0.bitwiseAND(low), b.s1.bitwiseAND(low)), upper, "and", str(n), *salt)
            b, n = pair(z.s0.bitwiseAND(low), z.s1.bitwiseAND(low)), n - half
        return b

    def clipped_relu(self, at: Held, x: Pair, f: int, p: int, *salt) -> Pair:
        """Shares of clipped_relu: two comparisons, then two products."""
        half = 1 << (f - 1)
        (x,) = at.hold(x)
        above = self.geq(at, x, constant(half), p, "hi", *salt)
        inside = self.geq(at, x, constant(-half), p, "lo", *salt)
        above, inside = at.hold(self.bits_to_ring(above, "hi", *salt), self.bits_to_ring(inside, "lo", *salt))
        (ramp,) = at.hold(self.multiply(inside, add(x, constant(half)), "ramp", *salt))
        return self.mux(above, constant(1 << f), ramp, "clip", *salt)
