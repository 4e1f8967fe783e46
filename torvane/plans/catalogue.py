"""Registry of the engine's queries and of the SQL that each must agree with.

Every query runs over whole tables. Choices at random are by hashes that SQL has too.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torvane.functions import bits, share
from torvane.functions import ring as rg
from torvane.functions.ring import big, ring
from torvane.functions.share import Dealer, Held
from torvane.operators import aggregates as ag
from torvane.operators import discretize as dz
from torvane.operators import linalg, packing, sets, shared
from torvane.operators.lineage import cut, release, shared_dir, with_index
from torvane.operators.models import logistic, naive_bayes, oblivious, trees
from torvane.sources import files

#: Fraction bits, and the bit that comparisons look at: for values below 2 ** 40 in size.
FB, TOP = 10, 41
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, table) by its name; table(name) reads one. It is run inside the ring guard."""

    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with ring(spark):
                return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["shared_product_sum"](spark, sf_dir)


def enc(c: str):
    return rg.encode(F.col(c), FB)


def _orders(table) -> DataFrame:
    """o_orderkey and two fixed-point numbers x, y of either sign, from orders."""
    y = rg.encode(F.col("o_totalprice") - 200000.0, FB)
    return table("orders").select("o_orderkey", rg.encode(F.col("o_totalprice") / 100.0 - 1000.0, FB).alias("x"), F.shiftright(y, 6).alias("y"), F.col("o_custkey").alias("c"))


ORDERS = "(SELECT o_orderkey, trunc((o_totalprice / 100.0 - 1000.0) * 1024)::BIGINT AS x, trunc((o_totalprice - 200000.0) * 1024)::BIGINT >> 6 AS y, o_custkey AS c FROM orders)"
D = Dealer(("o_orderkey", "c"))


# Fixed point, sharing, elementwise arithmetic


@query("SELECT l_returnflag, sum(trunc(l_quantity * 1024)::BIGINT * trunc(l_discount * 1024)::BIGINT)::BIGINT AS prod FROM lineitem GROUP BY 1")
def shared_product_sum(spark, table):
    d = Dealer(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = table("lineitem").select("l_returnflag", *d.keys, enc("l_quantity").alias("x"), enc("l_discount").alias("y"))
    z = d.multiply(d.share(F.col("x"), "x"), d.share(F.col("y"), "y"), "xy")
    return rows.select("l_returnflag", z.alias("z")).groupBy("l_returnflag").agg((F.sum("z.s0") + F.sum("z.s1")).alias("prod"))


@query("SELECT c_custkey, trunc(c_acctbal * 1024)::BIGINT AS v, CASE WHEN c_acctbal < 0 THEN -floor(-c_acctbal * 1024)::BIGINT ELSE floor(c_acctbal * 1024)::BIGINT END AS v_floor FROM customer")
def ring_encode(spark, table):
    return table("customer").select("c_custkey", enc("c_acctbal").alias("v"), rg.encode_floor(F.col("c_acctbal"), FB).alias("v_floor"))


@query("SELECT c_custkey, trunc(c_acctbal * 1024)::BIGINT / 1024.0 AS x FROM customer")
def ring_decode(spark, table):
    return table("customer").select("c_custkey", rg.decode(enc("c_acctbal"), FB).alias("x"))


@query(f"SELECT o_orderkey, (x * y) >> 10 AS v FROM {ORDERS}")
def truncate_exact(spark, table):
    return _orders(table).select("o_orderkey", rg.truncate(F.col("x") * F.col("y"), FB).alias("v"))


@query(f"SELECT o_orderkey, true AS within_one FROM {ORDERS}")
def truncate_local(spark, table):
    got = share.open_sum(share.truncate_local(D.share(F.col("x") * F.col("y"), "t"), FB)) - rg.truncate(F.col("x") * F.col("y"), FB)
    return _orders(table).select("o_orderkey", ((got == 0) | (got == 1)).alias("within_one"))


@query(f"SELECT o_orderkey, x FROM {ORDERS}")
def share_open_zq(spark, table):
    return _orders(table).select("o_orderkey", share.open_sum(D.share(F.col("x"))).alias("x"))


@query(f"SELECT o_orderkey, x FROM {ORDERS}")
def share_open_z2(spark, table):
    return _orders(table).select("o_orderkey", share.open_xor(D.share_bits(F.col("x"))).alias("x"))


@query(f"SELECT o_orderkey, x * y AS v FROM {ORDERS}")
def multiply(spark, table):
    return _orders(table).select("o_orderkey", share.open_sum(D.multiply(D.share(F.col("x"), "x"), D.share(F.col("y"), "y"))).alias("v"))


@query(f"SELECT o_orderkey, x & c AS v FROM {ORDERS}")
def multiply_z2(spark, table):
    return _orders(table).select("o_orderkey", share.open_xor(D.multiply_bits(D.share_bits(F.col("x"), "x"), D.share_bits(F.col("c"), "c"))).alias("v"))


_BITS = "o_orderkey, (o_orderkey & 1) AS a, (c & 1) AS b"


def _two_bits(table) -> DataFrame:
    one = big(1)
    return _orders(table).select("*", F.col("o_orderkey").bitwiseAND(one).alias("a"), F.col("c").bitwiseAND(one).alias("b"))


@query(f"SELECT o_orderkey, xor(a, b) AS x, a | b AS o, 1 - a AS n, CASE WHEN a = 1 THEN x ELSE y END AS m FROM (SELECT {_BITS}, x, y FROM {ORDERS})")
def bit_arithmetic(spark, table):
    a, b = F.col("a"), F.col("b")
    return _two_bits(table).select("o_orderkey", rg.xor01(a, b).alias("x"), rg.or01(a, b).alias("o"), rg.not01(a).alias("n"), rg.mux(a, F.col("x"), F.col("y")).alias("m"))


@query(f"SELECT o_orderkey, xor(a, b) AS x, a | b AS o, 1 - a AS n, CASE WHEN a = 1 THEN x ELSE y END AS m, b AS z FROM (SELECT {_BITS}, x, y FROM {ORDERS})")
def bit_arithmetic_shared(spark, table):
    a, b = D.share(F.col("a"), "a"), D.share(F.col("b"), "b")
    x, y = D.share(F.col("x"), "x"), D.share(F.col("y"), "y")
    opened = {"x": D.xor01(a, b), "o": D.or01(a, b), "n": share.negate01(a), "m": D.mux(a, x, y), "z": D.bits_to_ring(D.share_bits(F.col("b"), "b"))}
    return _two_bits(table).select("o_orderkey", *(share.open_sum(v).alias(k) for k, v in opened.items()))


@query("SELECT c_custkey, CASE WHEN x <= -512 THEN 0 WHEN x >= 512 THEN 1024 ELSE x + 512 END AS v FROM (SELECT c_custkey, trunc(c_acctbal / 4096.0 * 1024)::BIGINT AS x FROM customer)")
def clipped_relu(spark, table):
    x = rg.encode(F.col("c_acctbal") / 4096.0, FB)
    return table("customer").select("c_custkey", rg.clipped_relu(x, FB).alias("v"))


@query(_SQL["clipped_relu"])
def clipped_relu_shared(spark, table):
    d = Dealer(("c_custkey",))
    rows = table("customer").select("c_custkey", rg.encode(F.col("c_acctbal") / 4096.0, FB).alias("x"))
    at = Held(rows)
    v = d.clipped_relu(at, d.share(F.col("x")), FB, 26)
    return at.done(v=share.open_sum(v)).drop("x")


@query("SELECT c_custkey, CASE WHEN x > 0 THEN trunc(1.0 / sqrt(x / 1024.0) * 1024)::BIGINT END AS v FROM (SELECT c_custkey, trunc(c_acctbal * 1024)::BIGINT AS x FROM customer)")
def inverse_sqrt(spark, table):
    return table("customer").select("c_custkey", rg.inverse_sqrt(enc("c_acctbal"), FB).alias("v"))


@query("SELECT l_orderkey, l_linenumber, gcd(l_orderkey, l_partkey)::BIGINT AS g, lcm(l_orderkey, l_partkey)::BIGINT AS l FROM lineitem")
def gcd_lcm(spark, table):
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return table("lineitem").select("l_orderkey", "l_linenumber", rg.gcd(a, b).alias("g"), rg.lcm(a, b).alias("l"))


# Bits and comparisons


@query("SELECT p_partkey, p_partkey & (p_partkey << 1) & -6148914691236517206 AS pairs, (p_partkey & 15 = 15)::BIGINT AS every, ((p_partkey & 255) = (p_size & 255))::BIGINT AS same FROM part")
def bit_words(spark, table):
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return table("part").select("p_partkey", bits.pairwise_and(k).alias("pairs"), bits.and_all(k, 4).alias("every"), bits.equal_bits(k, s, 8).alias("same"))


@query(_SQL["bit_words"])
def bit_words_shared(spark, table):
    d, k, s = Dealer(("p_partkey",)), F.col("p_partkey"), F.col("p_size").cast("bigint")
    at = Held(table("part").select("p_partkey", "p_size"))
    x, y = at.hold(d.share_bits(k, "k"), d.share_bits(s, "s"))
    up = share.pair(F.shiftleft(x.s0, 1), F.shiftleft(x.s1, 1))
    pairs = share.open_xor(d.multiply_bits(x, up, "pairs")).bitwiseAND(big(bits.ODD_BITS))
    every = d.and_all(at, share.pair(x.s0.bitwiseAND(big(15)), x.s1.bitwiseAND(big(15))), 4, "every")
    same = d.equal_bits(at, x, y, 8, "same")
    return at.done(pairs=pairs, every=share.open_xor(every), same=share.open_xor(same)).drop("p_size")


PLACES = (0, 1, 3, 7, 15, 31, 63)
_BIT = ", ".join(f"((x * y) >> {p}) & 1 AS b{p}" for p in PLACES)


@query(f"SELECT o_orderkey, {_BIT}, list_transform(range(8), lambda i: ((o_orderkey >> i::INTEGER) & 1)::TINYINT) AS low FROM {ORDERS}")
def bit_extract(spark, table):
    v = F.col("x") * F.col("y")
    return _orders(table).select("o_orderkey", *(bits.bit(v, p).alias(f"b{p}") for p in PLACES), bits.to_bits(F.col("o_orderkey"), 8).alias("low"))


@query(f"SELECT o_orderkey, {_BIT} FROM {ORDERS}")
def bit_extract_shared(spark, table):
    at = Held(_orders(table))
    found = D.bits(at, D.share(F.col("x") * F.col("y"), "v"), PLACES)
    return at.done(**{f"b{p}": share.open_xor(b) for p, b in zip(PLACES, found, strict=True)}).drop("x", "y", "c")


@query(f"SELECT o_orderkey, (x >= y)::BIGINT AS ge, (x < y)::BIGINT AS lt, [(x >= y)::BIGINT, (x < y)::BIGINT] AS hot FROM {ORDERS}")
def compare(spark, table):
    x, y = F.col("x"), F.col("y")
    return _orders(table).select("o_orderkey", bits.geq(x, y, TOP).alias("ge"), bits.less_than(x, y, TOP).alias("lt"), bits.argmax_of_two(x, y, TOP).alias("hot"))


@query(f"SELECT o_orderkey, (x >= y)::BIGINT AS ge FROM {ORDERS}")
def geq_shared(spark, table):
    at = Held(_orders(table))
    ge = D.geq(at, D.share(F.col("x"), "x"), D.share(F.col("y"), "y"), TOP)
    return at.done(ge=share.open_xor(ge)).select("o_orderkey", "ge")


@query("SELECT p_partkey, lpad(lower(hex(p_partkey)), 32, '0') AS h, p_partkey AS lo, 0::BIGINT AS hi FROM part")
def hex_words(spark, table):
    text = bits.hex128(big(0), F.col("p_partkey"))
    back = bits.parse_hex128(F.concat(F.lit("0x"), text))
    return table("part").select("p_partkey", text.alias("h"), back.lo.alias("lo"), back.hi.alias("hi"))


def _fields(table) -> DataFrame:
    return table("part").select(F.col("p_partkey").alias("i"), F.col("p_partkey").alias("v"))


_PACKED = """
SELECT word, sum(CASE WHEN j < 8 THEN (v & 255)::HUGEINT << (56 - 8 * j)::INTEGER ELSE 0 END) AS hi, sum(CASE WHEN j >= 8 THEN (v & 255)::HUGEINT << (120 - 8 * j)::INTEGER ELSE 0 END) AS lo
FROM (SELECT p_partkey // 16 AS word, p_partkey % 16 AS j, p_partkey AS v FROM part) GROUP BY 1
"""


@query(f"SELECT word, (CASE WHEN hi >= 9223372036854775808 THEN hi - 18446744073709551616 ELSE hi END)::BIGINT AS hi, (CASE WHEN lo >= 9223372036854775808 THEN lo - 18446744073709551616 ELSE lo END)::BIGINT AS lo FROM ({_PACKED})")
def pack_bits(spark, table):
    return packing.pack(_fields(table), 8)


@query("SELECT p_partkey AS i, p_partkey & 2047 AS v FROM part")
def unpack_bits(spark, table):
    rows = _fields(table)
    n = rows.count()
    return packing.unpack(packing.pack(rows, 11, pad=1), 11, n, padded=True)


@query("SELECT p_partkey AS i, ((p_partkey >> 1) & 1) | (((p_partkey >> 3) & 1) << 1) | (((p_partkey >> 5) & 1) << 2) | (((p_partkey >> 7) & 1) << 3) AS v FROM part")
def repack_bits(spark, table):
    rows = _fields(table)
    n = rows.count()
    return packing.unpack(packing.repack(packing.pack(rows, 8), 4, n), 4, n)


# Aggregates


@query("SELECT l_returnflag, sum(v)::BIGINT AS total, sum(q * q)::BIGINT AS squares FROM (SELECT l_returnflag, trunc(l_extendedprice * 1024)::BIGINT AS v, trunc(l_quantity * 1024)::BIGINT AS q FROM lineitem) GROUP BY 1")
def sums(spark, table):
    return table("lineitem").groupBy("l_returnflag").agg(ag.ring_sum(enc("l_extendedprice")).alias("total"), ag.sum_of_squares(enc("l_quantity")).alias("squares"))


@query("SELECT o_orderkey // 100 AS chunk, sum(x * y)::BIGINT AS dot FROM (SELECT o_orderkey, o_custkey AS x, trunc(o_totalprice * 1024)::BIGINT AS y FROM orders) GROUP BY 1")
def dot_chunks(spark, table):
    return ag.dot_chunks(table("orders").select("o_orderkey", F.col("o_custkey").alias("x"), enc("o_totalprice").alias("y")), "o_orderkey", "x", "y", 100)


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS col, trunc({c} * 1024)::BIGINT AS v FROM lineitem" for c in FEATURES) + ")"


def _features(table) -> DataFrame:
    return table("lineitem").select(*(enc(c).alias(c) for c in FEATURES), (F.col("l_returnflag") == "R").cast("int").alias("label"))


@query(f"SELECT col, min(v) AS lo, max(v) AS hi FROM {_LONG} GROUP BY 1")
def min_max(spark, table):
    return ag.min_max(_features(table), FEATURES)


_WHOLE = "SELECT l_orderkey AS o_orderkey, list_reduce(list(l_linenumber::HUGEINT + 1), lambda a, b: (a * b) % 18446744073709551616::HUGEINT) AS p FROM lineitem GROUP BY 1"


@query(f"SELECT o_orderkey, (CASE WHEN p >= 9223372036854775808 THEN p - 18446744073709551616 ELSE p END)::BIGINT AS product FROM ({_WHOLE})")
def products(spark, table):
    """Of all rows of every order, however many."""
    rows = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber").cast("bigint") + 1).alias("v"))
    return ag.long_product(rows, ["o_orderkey"], "v")


@query(_SQL["products"])
def products_whole(spark, table):
    """The same with the factors of a group gathered at once: for groups that a task holds, as orders are."""
    rows = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber").cast("bigint") + 1).alias("v"))
    return rows.groupBy("o_orderkey").agg(ag.product(F.col("v")).alias("product"))


@query("SELECT o_custkey, bit_and(o_orderkey) AS every FROM orders GROUP BY 1")
def and_aggregate(spark, table):
    return table("orders").groupBy("o_custkey").agg(ag.and_all(F.col("o_orderkey")).alias("every"))


@query("SELECT o_custkey, arg_max(o_orderkey, (v, -o_orderkey)) AS first_best FROM (SELECT o_custkey, o_orderkey, trunc(o_totalprice / 50000)::BIGINT AS v FROM orders) GROUP BY 1")
def argmax_first(spark, table):
    return table("orders").groupBy("o_custkey").agg(ag.first_argmax((F.col("o_totalprice") / 50000).cast("bigint"), F.col("o_orderkey")).alias("first_best"))


_RATIOS = "(SELECT l_returnflag, l_partkey AS p, sum(trunc(l_extendedprice)::BIGINT)::HUGEINT AS n, sum(trunc(l_quantity)::BIGINT)::HUGEINT AS d FROM lineitem GROUP BY 1, 2)"
_BEST = f"SELECT a.l_returnflag, a.p FROM {_RATIOS} a WHERE NOT EXISTS (SELECT 1 FROM {_RATIOS} b WHERE b.l_returnflag = a.l_returnflag AND (b.n * a.d > a.n * b.d OR b.n * a.d = a.n * b.d AND b.p < a.p))"


def _part_ratios(table) -> DataFrame:
    return table("lineitem").groupBy("l_returnflag", F.col("l_partkey").alias("p")).agg(F.sum(F.col("l_extendedprice").cast("bigint")).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("d"))


@query(_BEST)
def argmax_ratio(spark, table):
    return ag.first_argmax_ratio(_part_ratios(table), ["l_returnflag"], "n", "d", "p")


@query(f"SELECT r.l_returnflag, r.p, (b.p IS NOT NULL)::BIGINT AS hot FROM {_RATIOS} r LEFT JOIN ({_BEST}) b USING (l_returnflag, p)")
def argmax_ratio_shared(spark, table):
    """Which part has the largest ratio, told as shares of a one-hot vector over all parts of a flag."""
    d = Dealer(("l_returnflag", "p"))
    rows = _part_ratios(table).select("l_returnflag", "p", d.share(F.col("n"), "n").alias("n"), d.share(F.col("d"), "d").alias("d"))
    hot = shared.argmax_ratio(rows, ["l_returnflag"], "p", "n", "d", Dealer(()), TOP)
    return hot.select("l_returnflag", "p", share.open_sum(F.col("hot")).alias("hot"))


def _shared_features(table) -> DataFrame:
    """Rows of shared features."""
    rows = _features(table).withColumn(shared.I, F.monotonically_increasing_id())
    d = Dealer((shared.I,))
    return rows.select(*(d.share(F.col(c), c).alias(c) for c in FEATURES))


@query(_SQL["min_max"])
def min_max_shared(spark, table):
    """Of every column, by trees of shared comparisons over all rows."""
    found = shared.column_ends(_shared_features(table), FEATURES, Dealer(()), TOP)
    return found.select("col", share.open_sum(F.col("lo")).alias("lo"), share.open_sum(F.col("hi")).alias("hi"))


@query(_SQL["products"])
def products_shared(spark, table):
    """Of all rows of every order, by a tree of shared products."""
    rows = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber").cast("bigint") + 1).alias("v"))
    placed = shared.positions(rows, ["o_orderkey"], ["v"])
    d = Dealer(("o_orderkey", shared.I))
    found = shared.products(placed.select("o_orderkey", shared.I, d.share(F.col("v"), "v").alias("v")), ["o_orderkey"], "v", Dealer(()))
    release(placed)
    return found.select("o_orderkey", share.open_sum(F.col("v")).alias("product"))


# Linear algebra, over embeddings as a matrix


def _matrix(table) -> DataFrame:
    cells = table("embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return cells.select("row", F.col("col").cast("bigint").alias("col"), rg.encode(F.col("v").cast("double"), FB).alias("v"))


_CELLS = "(SELECT vec_id AS row, unnest(range(64)) AS col, trunc(unnest(embedding)::DOUBLE * 1024)::BIGINT AS v FROM embeddings)"
_WEIGHT = "SELECT i AS row, j AS col, (i * 7 + j * 3) % 11 - 5 AS v FROM range(64) a(i), range(8) b(j)"


def _weights(spark, k: int = 1) -> DataFrame:
    """k matrices of 64 by 8."""
    at = F.col("id")
    k_, i, j = F.floor(at / 512).cast("bigint"), F.floor(at / 8).cast("bigint") % 64, at % 8
    return spark.range(k * 512).select(k_.alias("k"), i.alias("row"), j.alias("col"), ((i * 7 + j * 3 + k_) % 11 - 5).alias("v"))


@query(f"SELECT a.row, b.col, sum(a.v * b.v)::BIGINT AS v FROM {_CELLS} a JOIN ({_WEIGHT}) b ON a.col = b.row GROUP BY 1, 2")
def matmul(spark, table):
    return linalg.matmul(_matrix(table), _weights(spark).drop("k"))


@query(_SQL["matmul"])
def matmul_shared(spark, table):
    d = Dealer(("row", "m", "col"))
    a, b = Dealer(("row", "col")), Dealer(("row", "col"), 2)
    x = _matrix(table).select("row", "col", a.share(F.col("v"), "a").alias("v"))
    y = _weights(spark).select("row", "col", b.share(F.col("v"), "b").alias("v"))
    return linalg.shared_matmul(x, y, d).select("row", "col", share.open_sum(F.col("v")).alias("v"))


@query(f"SELECT k, a.row, b.col, sum(a.v * b.v)::BIGINT AS v FROM {_CELLS} a JOIN (SELECT k, i AS row, j AS col, (i * 7 + j * 3 + k) % 11 - 5 AS v FROM range(3) c(k), range(64) a(i), range(8) b(j)) b ON a.col = b.row GROUP BY 1, 2, 3")
def batch_matmul(spark, table):
    return linalg.matmul(_matrix(table), _weights(spark, 3), batch=True)


@query(f"SELECT k, a.row, b.col, sum(a.v * b.v)::BIGINT AS v FROM {_CELLS} a JOIN (SELECT k, i AS row, j AS col, (i * 7 + j * 3 + k) % 11 - 5 AS v FROM range(4) c(k), range(64) a(i), range(8) b(j)) b ON a.col = b.row GROUP BY 1, 2, 3")
def matmul_masked(spark, table):
    """Two batches of products with one matrix, which is opened under its mask once."""
    a, b = Dealer(("row", "col")), Dealer(("k", "row", "col"), 2)
    once = shared.masked(_matrix(table).select("row", "col", a.share(F.col("v"), "a").alias("v")), Dealer(("row", "m")))
    weights = _weights(spark, 4).select("k", "row", "col", b.share(F.col("v"), "b").alias("v"))
    parts = [shared.matmul_masked(once, weights.filter(own), Dealer(()), name, batch=True) for own, name in ((F.col("k") < 2, "first"), (F.col("k") >= 2, "second"))]
    return parts[0].unionByName(parts[1]).select("k", "row", "col", share.open_sum(F.col("v")).alias("v"))


@query(f"SELECT col AS row, row AS col, v FROM {_CELLS}")
def transpose(spark, table):
    return linalg.transpose(_matrix(table))


@query(f"SELECT row // 7 AS k, row % 7 AS row, col, v FROM {_CELLS} WHERE row // 7 < (SELECT count(*) FROM embeddings) // 7")
def group_tensor(spark, table):
    return linalg.group_tensor(_matrix(table), table("embeddings").count(), 7)


@query(f"SELECT row, col, CASE WHEN s > 0 THEN (v * trunc(1.0 / sqrt(s / 1024.0) * 1024)::BIGINT) >> 10 ELSE 0 END AS v FROM (SELECT *, (sum(v * v) OVER (PARTITION BY col))::BIGINT >> 10 AS s FROM {_CELLS})")
def normalize(spark, table):
    return linalg.normalize(_matrix(table), FB)


# Discretisation and choices by hash

_EDGES = f"(SELECT col, list_transform([204, 409, 614, 819], lambda r: lo + ((r * (hi - lo)) >> 10)) AS edges FROM ({_SQL['min_max']}))"


@query(f"SELECT * FROM {_EDGES}")
def discretize_edges(spark, table):
    return dz.edges(_features(table), FEATURES, 5, FB)


_BINNED = "(SELECT " + ", ".join(f"len(list_filter((SELECT edges FROM {_EDGES} WHERE col = '{c}'), lambda e: trunc({c} * 1024)::BIGINT >= e)) AS s{i}" for i, c in enumerate(FEATURES)) + ", (l_returnflag = 'R')::INTEGER AS label FROM lineitem)"


@query("SELECT slot, bin, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {i} AS slot, s{i}::INTEGER AS bin FROM {_BINNED}" for i in range(4)) + ") GROUP BY 1, 2")
def bin_counts(spark, table):
    cells = dz.binned(_features(table), FEATURES, 5, FB).select(F.posexplode("bins").alias("slot", "bin"))
    return cells.groupBy("slot", "bin").agg(F.count("*").alias("n"))


@query("SELECT slot, " + ", ".join(f"sum((bin = {b})::BIGINT)::BIGINT AS b{b}" for b in range(5)) + " FROM (" + " UNION ALL ".join(f"SELECT {i} AS slot, s{i} AS bin FROM {_BINNED}" for i in range(4)) + ") GROUP BY 1")
def one_hot_sums(spark, table):
    cells = dz.binned(_features(table), FEATURES, 5, FB).select(F.posexplode("bins").alias("slot", "bin"))
    return cells.select("slot", dz.one_hot(F.col("bin"), 5).alias("hot")).groupBy("slot").agg(*(F.sum(F.get("hot", F.lit(b))).alias(f"b{b}") for b in range(5)))



@query(_SQL["one_hot_sums"])
def one_hot_sums_shared(spark, table):
    """Bins between shared ends of each column, told as shares of one-hot vectors, summed share by share."""
    rows = _shared_features(table)
    ends = shared.column_ends(rows, FEATURES, Dealer(()), TOP)
    sums = shared.bin_counts(rows, FEATURES, ends, 5, FB, Dealer(()), TOP + FB)
    slot = F.array_position(F.array(*(F.lit(c) for c in FEATURES)), F.col("col")).cast("int") - 1
    return sums.select(slot.alias("slot"), *(share.open_sum(F.col(f"b{k}")).alias(f"b{k}") for k in range(5)))


def _sql_hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 15))::BIGINT"


_PICKS = f"(SELECT tree::INTEGER AS tree, slot::INTEGER AS slot, ({_sql_hash('tree', 'slot', '1')} % 4)::INTEGER AS attr FROM range(5) a(tree), range(5) b(slot))"


@query(f"SELECT * FROM {_PICKS}")
def pick_with_replacement(spark, table):
    return dz.pick_with_replacement(spark, 5, 5, len(FEATURES), 1)


@query(f"SELECT * FROM (SELECT tree::INTEGER AS tree, (row_number() OVER (PARTITION BY tree ORDER BY {_sql_hash('tree', 'attr', '1')}, attr) - 1)::INTEGER AS slot, attr::INTEGER AS attr FROM range(5) a(tree), range(4) b(attr)) WHERE slot < 3")
def pick_without_replacement(spark, table):
    return dz.pick_without_replacement(spark, 5, 3, len(FEATURES), 1)


@query(f"""WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_suppkey FROM supplier), n AS (SELECT count(*) AS n FROM s),
d AS (SELECT tree::INTEGER AS tree, {_sql_hash('tree', 'slot', '1')} % n AS i FROM range(3) a(tree), (SELECT n, unnest(range(n // 2)) AS slot FROM n))
SELECT i, tree, s_suppkey FROM d JOIN s USING (i)""")
def bootstrap_rows(spark, table):
    rows = table("supplier").select("s_suppkey").sort("s_suppkey")
    n = rows.count()
    return dz.bootstrap(with_index(rows), 3, n // 2, n, 1)


@query(f"SELECT tree, slot, attr, lo + (((hi - lo) * ({_sql_hash('tree', 'slot', '1', "'ratio'")} % 1024)) >> 10) AS cut FROM {_PICKS} p JOIN ({_SQL['min_max']}) r ON r.col = [{', '.join(map(repr, FEATURES))}][attr + 1]")
def random_cuts(spark, table):
    return dz.random_cuts(_features(table), FEATURES, dz.pick_with_replacement(spark, 5, 5, len(FEATURES), 1), FB, 1)


# Set matching and models


def _words(table, name: str, key: str) -> DataFrame:
    return table(name).select(F.col(key).alias("id"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''")


def _sql_words(name: str, key: str) -> str:
    return f"(SELECT {key} AS id, w AS word FROM (SELECT {key}, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM {name}) WHERE w <> '')"


@query(f"SELECT d.word, count(e.word) AS m FROM (SELECT DISTINCT word FROM {_sql_words('benchmark', 'item_id')}) d LEFT JOIN {_sql_words('documents', 'doc_id')} e USING (word) GROUP BY 1")
def psi_counts(spark, table):
    return sets.match_counts(_words(table, "benchmark", "item_id").select("word").distinct(), _words(table, "documents", "doc_id"))


@query(f"SELECT DISTINCT word FROM {_sql_words('benchmark', 'item_id')} WHERE word NOT IN (SELECT word FROM {_sql_words('documents', 'doc_id')})")
def psi_missing(spark, table):
    return sets.members(_words(table, "benchmark", "item_id").select("word").distinct(), _words(table, "documents", "doc_id"), present=False)


@query(f"SELECT word, (word IN (SELECT word FROM {_sql_words('documents', 'doc_id')}))::BIGINT AS m FROM (SELECT DISTINCT word FROM {_sql_words('benchmark', 'item_id')})")
def psi_bits_shared(spark, table):
    """Whether the documents have a word, by equality tests on shares of 60-bit hashes."""
    dictionary, example = (_words(table, name, key).select("word").distinct().withColumn("h", dz.hashed(F.col("word"))) for name, key in (("benchmark", "item_id"), ("documents", "doc_id")))
    return sets.shared_members(dictionary, example, "h", 60, Dealer(("h", "torvane_h"))).select("word", "m")


_QUALITY = "(SELECT doc_id AS id, max(quality)::INTEGER AS class FROM labels GROUP BY 1)"
_NB = f"""
t AS MATERIALIZED (SELECT * FROM {_sql_words('documents', 'doc_id')}), q AS MATERIALIZED (SELECT * FROM {_QUALITY} WHERE id IN (SELECT doc_id FROM documents)),
tw AS MATERIALIZED (SELECT t.*, q.class FROM t JOIN q USING (id)), own AS (SELECT class, word, count(*) AS n FROM tw GROUP BY 1, 2),
voc AS (SELECT DISTINCT word FROM tw), cls AS (SELECT class, count(*) AS rows FROM q GROUP BY 1), tot AS (SELECT class, coalesce(sum(n), 0) AS total FROM cls LEFT JOIN own USING (class) GROUP BY 1),
lp AS (SELECT voc.word, tot.class, trunc(ln((coalesce(n, 0) + 1.0)::DOUBLE / (total + (SELECT count(*) FROM voc))::DOUBLE) * 1024)::BIGINT AS logp FROM voc CROSS JOIN tot LEFT JOIN own ON own.word = voc.word AND own.class = tot.class),
pr AS (SELECT class, trunc(ln(rows::DOUBLE / (SELECT sum(rows) FROM cls)::DOUBLE) * 1024)::BIGINT AS prior FROM cls)
"""


def _nb(table):
    labels = table("labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("class"))
    words = cut(naive_bayes.counted(_words(table, "documents", "doc_id")))
    known = words.join(labels.select("id"), "id", "left_semi")
    labels = labels.join(table("documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    logp, prior = naive_bayes.learn(known, labels, FB)
    return words, (cut(logp), cut(prior))


@query(f"WITH {_NB} SELECT word, class, logp FROM lp")
def nb_learn(spark, table):
    return _nb(table)[1][0]


@query(f"""WITH {_NB}, m AS (SELECT id, word, count(*) AS m FROM t GROUP BY 1, 2), s AS (SELECT id, class, sum(m * logp) AS part FROM m JOIN lp USING (word) GROUP BY 1, 2),
z AS (SELECT d.id, pr.class, prior + coalesce(part, 0) AS score FROM (SELECT DISTINCT id FROM t) d CROSS JOIN pr LEFT JOIN s ON s.id = d.id AND s.class = pr.class)
SELECT id, arg_max(class, (score, -class)) AS class FROM z GROUP BY 1""")
def nb_predict(spark, table):
    words, (logp, prior) = _nb(table)
    return naive_bayes.predict(words, logp, prior)


@query(_SQL["nb_predict"])
def nb_predict_shared(spark, table):
    """The same with counts, log-probabilities and priors as shares, words matched by equality tests, and the largest score found by comparisons on shares."""
    words, (logp, prior) = _nb(table)
    hashed = dz.hashed(F.col("word")).alias("h")
    own = cut(words.select("id", hashed, "m"))
    counts = own.select("id", "h", Dealer(("id", "h")).share(F.col("m"), "m").alias("m"))
    said = logp.select(hashed, "class", "logp").select("h", "class", Dealer(("h", "class")).share(F.col("logp"), "p").alias("p"))
    first = prior.select("class", Dealer(("class",)).share(F.col("prior"), "p").alias("p"))
    best = oblivious.bayes_predict(counts, said, first, 60, TOP)
    release(words, own, logp, prior)
    return best.select("id", share.open_sum(F.col("class")).cast("int").alias("class"))


LR = ["one", "size", "english"]
_LR_ROWS = "(SELECT doc_id, 1024::BIGINT AS one, trunc(n_chars / 8000.0 * 1024)::BIGINT AS size, (lang = 'en')::BIGINT * 1024 AS english, quality::BIGINT * 1024 AS label FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"


def _lr_rows(table) -> DataFrame:
    labels = table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    size = rg.encode(F.col("n_chars") / 8000.0, FB)
    return table("documents").join(labels, "doc_id").select("doc_id", big(1024).alias("one"), size.alias("size"), ((F.col("lang") == "en").cast("bigint") * 1024).alias("english"), (F.col("quality").cast("bigint") * 1024).alias("label"))


#: As many rounds as the method takes.
ROUNDS = 300


def _lr_sql() -> tuple[str, str]:
    z = "(" + " + ".join(f"x.{c} * w.{c}" for c in LR) + ") >> 10"
    clip = f"CASE WHEN {z} <= -512 THEN 0 WHEN {z} >= 512 THEN 1024 ELSE ({z}) + 512 END"
    g = ", ".join(f"w.{c} + (((sum(x.{c} * (x.label - ({clip})))::BIGINT >> 10) * 16) >> 10)" for c in LR)
    own = ", ".join(f"w.{c}" for c in LR)
    first = ", ".join("0::BIGINT" for _ in LR)
    return f"WITH RECURSIVE x AS MATERIALIZED (SELECT * FROM {_LR_ROWS}), w(k, {', '.join(LR)}) AS (SELECT 0, {first} UNION ALL SELECT w.k + 1, {g} FROM w, x WHERE w.k < {ROUNDS} GROUP BY w.k, {own})", clip


_LR_WITH, _LR_CLIP = _lr_sql()


@query(_LR_WITH + f" SELECT one, size, english FROM w WHERE k = {ROUNDS}")
def lr_learn(spark, table):
    w = logistic.learn(_lr_rows(table), LR, "label", f=FB, rate=16, rounds=ROUNDS)
    return spark.range(1).select(*(big(v).alias(c) for c, v in zip(LR, w, strict=True)))


#: Rounds of the regression on shares: each compares on shares twice.
SHARED_ROUNDS = 2


@query(_LR_WITH + f" SELECT one, size, english FROM w WHERE k = {SHARED_ROUNDS}")
def lr_learn_shared(spark, table):
    """The weights after some rounds on shares, exactly those of lr_learn after as many."""
    d = Dealer(("doc_id",))
    rows = _lr_rows(table).select("doc_id", *(d.share(F.col(c), c).alias(c) for c in (*LR, "label")))
    w = logistic.learn_shared(rows, LR, "label", d, f=FB, rate=16, rounds=SHARED_ROUNDS, top=TOP)
    return spark.range(1).select(*((big(a) + big(b)).alias(c) for c, (a, b) in zip(LR, w, strict=True)))


@query(_LR_WITH + f" SELECT x.doc_id, (({_LR_CLIP}) >= 512)::INTEGER AS predicted FROM x, w WHERE k = {ROUNDS}")
def lr_predict(spark, table):
    rows = _lr_rows(table)
    w = logistic.learn(rows, LR, "label", f=FB, rate=16, rounds=ROUNDS)
    return logistic.predict(rows, LR, w, FB).select("doc_id", "predicted")


# Trees


def _tree_rows(table) -> DataFrame:
    return dz.binned(_features(table), FEATURES, 5, FB).select(F.lit(0).alias("tree"), "label", "bins", F.lit(0).cast("bigint").alias("node"))


@query(f"SELECT label, count(*) AS n, count(*) = (SELECT count(*) FROM lineitem) AS constant FROM {_BINNED} GROUP BY 1")
def class_frequencies(spark, table):
    f = trees.frequencies(_tree_rows(table), 2)
    return f.select(F.posexplode("freqs").alias("label", "n"), trees.is_constant(F.col("freqs"), F.col("size")).alias("constant")).filter("n > 0")


_CONT = "(" + " UNION ALL ".join(f"SELECT {i} AS slot, s{i} AS bin, label, count(*) AS n FROM b GROUP BY 2, 3" for i in range(4)) + ")"


def _gini_sql(cells: str, by: str = "") -> str:
    """Scores of slots from cells (slot, bin, label, n): with all bins over one denominator, first in 1024ths, then 40 binary digits at a time, all in whole numbers of 128 bits."""
    by = f"{by}, " if by else ""
    sums = f"(SELECT {by}slot, bin, sum(n * n)::HUGEINT AS s, (sum(n) + 1)::HUGEINT AS y FROM {cells} GROUP BY ALL)"
    whole = f"(SELECT {by}slot, any_value(p) AS d, sum(s * (p // y))::HUGEINT AS r FROM {sums} JOIN (SELECT {by}slot, list_reduce(list(y), lambda a, b: a * b) AS p FROM {sums} GROUP BY ALL) USING ({by}slot) GROUP BY ALL)"
    out = f"(SELECT {by}slot, d, ((r * 1024) // d)::BIGINT AS score, r // d AS g0, r % d AS r FROM {whole})"
    for k in range(1, 5):
        own = ", ".join(f"g{j}" for j in range(k))
        out = f"(SELECT {by}slot, d, score, {own}, (r * 1099511627776) // d AS g{k}, (r * 1099511627776) % d AS r FROM {out})"
    return out


_KEY = "(g0, g1, g2, g3, g4, -slot)"
_GINI = _gini_sql(_CONT)
_B = f"WITH b AS MATERIALIZED (SELECT * FROM {_BINNED})"


@query(f"{_B} SELECT slot, score FROM {_GINI}")
def gini_scores(spark, table):
    return trees.gini_scores(trees.contingency(_tree_rows(table))).select("slot", "score")


@query(f"{_B} SELECT arg_max(slot, {_KEY}) AS slot FROM {_GINI}")
def gini_best(spark, table):
    return trees.best_slots(trees.gini_scores(trees.contingency(_tree_rows(table)))).select("slot")


@query(f"""{_B}, s AS (SELECT arg_max(slot, {_KEY}) AS slot FROM {_GINI}),
leaf AS (SELECT (CASE s.slot WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END + 1)::BIGINT AS node, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM b, s GROUP BY 1)
SELECT 0::BIGINT AS node, 0 AS layer, slot::INTEGER AS slot, 0::BIGINT AS n0, 0::BIGINT AS n1 FROM s UNION ALL SELECT node, 1, NULL, n0, n1 FROM leaf""")
def tree_learn(spark, table):
    nodes = trees.induce(_tree_rows(table).drop("node"), trees.TreeConfig(bins=5, depth=2))
    return nodes.select("node", "layer", "slot", F.get("freqs", F.lit(0)).alias("n0"), F.get("freqs", F.lit(1)).alias("n1"))


DEEP = trees.TreeConfig(bins=2, depth=3, epsilon=0.2)
_GRADED = "(SELECT doc_id, quality AS label, (n_chars >= 1500)::BIGINT AS s0, (lang = 'en')::BIGINT AS s1, contains(text, '|')::BIGINT AS s2, toxic AS s3 FROM documents JOIN (SELECT doc_id, max(quality)::BIGINT AS quality, max(toxic)::BIGINT AS toxic FROM labels GROUP BY 1) USING (doc_id))"


def _graded(table) -> DataFrame:
    """Rows (tree, row, label, bins) of documents with a label: whether one is long, English, has a bar and is toxic."""
    labels = table("labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"), F.max("toxic").cast("int").alias("s3"))
    told = {"s0": F.col("n_chars") >= 1500, "s1": F.col("lang") == "en", "s2": F.contains("text", F.lit("|"))}
    own = table("documents").select("doc_id", *(c.cast("int").alias(k) for k, c in told.items()))  # so that no text is shuffled
    return own.join(labels, "doc_id").select(F.lit(0).alias("tree"), F.col("doc_id").alias("row"), "label", F.array("s0", "s1", "s2", "s3").alias("bins"))


def _levels_sql(n0: str, slots: int, config: trees.TreeConfig) -> str:
    """t0, t1 and so on: nodes of trees over n0 (tree, node, label, s0 and so on) layer by layer, with their best slot, from rows whose node no rule stopped."""
    cells = lambda k: "(" + " UNION ALL ".join(f"SELECT tree, node, {i} AS slot, s{i} AS bin, label, count(*) AS n FROM n{k} GROUP BY ALL" for i in range(slots)) + ")"
    out = f"n0 AS MATERIALIZED ({n0}), total AS (SELECT tree, count(*) AS total FROM n0 GROUP BY 1)"
    for k in range(config.depth):
        out += f", f{k} AS (SELECT tree, node, count(*) AS size, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM n{k} GROUP BY 1, 2)"
        out += f", t{k} AS MATERIALIZED (SELECT *, {k} = {config.depth - 1} OR {config.epsilon}::DOUBLE * total >= size OR greatest(c0, c1) = size AS stop FROM f{k} JOIN (SELECT tree, node, arg_max(slot, {_KEY}) AS slot FROM {_gini_sql(cells(k), 'tree, node')} GROUP BY 1, 2) USING (tree, node) JOIN total USING (tree))"
        out += f", n{k + 1} AS MATERIALIZED (SELECT n{k}.* REPLACE (node * {config.bins} + 1 + {_side(slots)} AS node) FROM n{k} JOIN t{k} USING (tree, node) WHERE NOT stop)"
    return out


def _side(slots: int) -> str:
    return f"[{', '.join(f's{i}' for i in range(slots))}][slot + 1]"


def _deep_sql() -> str:
    """A tree of three layers."""
    parts = []
    for k in range(DEEP.depth):
        slot = "NULL" if k == DEEP.depth - 1 else "slot"
        parts.append(f"SELECT node, {k} AS layer, {slot}::INTEGER AS slot, stop AS classifies, CASE WHEN stop THEN c0 ELSE 0 END AS n0, CASE WHEN stop THEN c1 ELSE 0 END AS n1 FROM t{k}")
    return f"WITH {_levels_sql(f'SELECT *, 0 AS tree, 0::BIGINT AS node FROM {_GRADED}', 4, DEEP)} " + " UNION ALL ".join(parts)


def _layers(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", "layer", "slot", "classifies", F.get("freqs", F.lit(0)).alias("n0"), F.get("freqs", F.lit(1)).alias("n1"))


@query(_deep_sql())
def tree_stops(spark, table):
    """Three layers, in which rules stop nodes before the last."""
    return _layers(trees.induce(_graded(table), DEEP))


@query(_SQL["tree_stops"])
def tree_learn_shared(spark, table):
    """The same tree on shares: each row is a member of every node of a layer, and what is where is opened at the end."""
    shares = oblivious.dealt(_graded(table), 4, DEEP, Dealer(("tree", "row")))
    return _layers(oblivious.reveal(oblivious.induce(shares, 4, DEEP, bits=None), DEEP))


def _customers(table) -> DataFrame:
    """Few orders or many, from a customer's balance, nation and name."""
    n = table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    rows = table("customer").join(n, "c_custkey", "left")
    nation = F.col("c_nationkey").cast("bigint") * 1024
    return rows.select("c_custkey", enc("c_acctbal").alias("balance"), nation.alias("nation"), rg.encode(F.coalesce("most", F.lit(0.0)) / 100.0, FB).alias("most"), (F.coalesce("n", F.lit(0)) >= 10).cast("int").alias("label"))


CUSTOMER = ["balance", "nation", "most"]


_C = "c AS MATERIALIZED (SELECT c_custkey, trunc(c_acctbal * 1024)::BIGINT AS balance, c_nationkey::BIGINT * 1024 AS nation, trunc(coalesce(most, 0.0) / 100.0 * 1024)::BIGINT AS most, (coalesce(n, 0) >= 10)::INTEGER AS label FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1) USING (c_custkey))"
_CB = "b AS MATERIALIZED (SELECT c_custkey, label, " + ", ".join("(" + " + ".join(f"({c} >= (SELECT min({c}) + (({r} * (max({c}) - min({c}))) >> 10) FROM c))::BIGINT" for r in (204, 409, 614, 819)) + f") AS s{i}" for i, c in enumerate(CUSTOMER)) + " FROM c)"
_CG = _gini_sql("(" + " UNION ALL ".join(f"SELECT {i} AS slot, s{i} AS bin, label, count(*) AS n FROM b GROUP BY 2, 3" for i in range(3)) + ")")


def _forest_sql(setup: str, slots: int, config: trees.TreeConfig, *, soft: bool = False, each: int = 0) -> str:
    """Votes of trees of three layers over own (tree, label, s0 and so on), for all rows of x (c_custkey, tree, s0 and so on); with each, by runs of so many trees."""
    walk = f"""w1 AS (SELECT x.*, 1 + {_side(slots)} AS node FROM x JOIN t0 USING (tree)),
w2 AS (SELECT w1.* REPLACE (node * {config.bins} + 1 + {_side(slots)} AS node), stop, c0, c1 FROM w1 JOIN t1 USING (tree, node)),
said AS (SELECT c_custkey, tree, CASE WHEN w2.stop THEN w2.c0 ELSE t2.c0 END AS a, CASE WHEN w2.stop THEN w2.c1 ELSE t2.c1 END AS b FROM w2 LEFT JOIN t2 USING (tree, node))"""
    vote = "b::DOUBLE / (a + b) AS yes, a::DOUBLE / (a + b) AS no" if soft else "(b > a)::DOUBLE AS yes, (b <= a)::DOUBLE AS no"
    run = f"tree // {each}" if each else "0"
    asked = f"(SELECT DISTINCT c_custkey, ({run})::INTEGER AS run FROM x)"
    best = f"(SELECT c_custkey, ({run})::INTEGER AS run, (round(sum(yes), 9) > round(sum(no), 9))::INTEGER AS class FROM (SELECT c_custkey, tree, {vote} FROM said WHERE a IS NOT NULL) GROUP BY ALL)"
    return f"WITH {setup}, {_levels_sql('SELECT *, 0::BIGINT AS node FROM own', slots, config)}, {walk} SELECT {'run, ' if each else ''}c_custkey, coalesce(class, 0) AS class FROM {asked} LEFT JOIN {best} USING (c_custkey, run)"


def _drawn_sql(count: int, slots: int, seed: int) -> str:
    """Attributes and cuts by hash, and on which side of each cut a row is."""
    v = f"[{', '.join(CUSTOMER)}]"
    ends = f"(SELECT [{', '.join(f'min({c})' for c in CUSTOMER)}] AS lo, [{', '.join(f'max({c})' for c in CUSTOMER)}] AS hi FROM c)"
    picks = f"(SELECT tree::INTEGER AS tree, slot, {_sql_hash('tree', 'slot', str(seed))} % {len(CUSTOMER)} + 1 AS attr, {_sql_hash('tree', 'slot', str(seed), repr('ratio'))} % 1024 AS ratio FROM range({count}) a(tree), range({slots}) b(slot))"
    cuts = f"p AS MATERIALIZED (SELECT tree, slot, attr, lo[attr] + (((hi[attr] - lo[attr]) * ratio) >> 10) AS cut FROM {picks}, {ends})"
    sides = ", ".join(f"max(CASE WHEN slot = {i} THEN ({v}[attr] >= cut)::BIGINT END) AS s{i}" for i in range(slots))
    return f"{_C}, {cuts}, x AS MATERIALIZED (SELECT c_custkey, label, tree, {sides} FROM c, p GROUP BY 1, 2, 3), own AS (SELECT * FROM x)"


def _resampled_sql(count: int, slots: int, seed: int) -> str:
    """Attributes without repetition by a shuffle, and rows with repetition by hash, half as many as there are."""
    picks = f"p AS MATERIALIZED (SELECT tree::INTEGER AS tree, attr + 1 AS attr, row_number() OVER (PARTITION BY tree ORDER BY {_sql_hash('tree', 'attr', str(seed))}, attr) - 1 AS slot FROM range({count}) a(tree), range({len(CUSTOMER)}) b(attr))"
    sides = ", ".join(f"max(CASE WHEN slot = {i} THEN [s0, s1, s2][attr] END) AS s{i}" for i in range(slots))
    own = f"(SELECT tree::INTEGER AS tree, {_sql_hash('tree', 'slot', str(seed))} % n AS i FROM range({count}) a(tree), (SELECT n, unnest(range(n // 2)) AS slot FROM (SELECT count(*) AS n FROM c)))"
    return f"{_C}, {_CB}, {picks}, x AS MATERIALIZED (SELECT c_custkey, label, tree, {sides} FROM b, p GROUP BY 1, 2, 3), own AS (SELECT x.* FROM {own} JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM c) USING (i) JOIN x USING (c_custkey, tree))"


FOREST, EXTRA = trees.TreeConfig(depth=3), trees.TreeConfig(bins=2, depth=3)


@query(_forest_sql(_resampled_sql(5, 2, 3), 2, FOREST))
def random_forest_votes(spark, table):
    rows = _customers(table).sort("c_custkey")  # draws are of places in this order
    forest = trees.train_random_forest(rows, CUSTOMER, "label", FOREST, f=FB, trees=5, features=2, instances=rows.count() // 2, seed=3)
    return trees.votes(rows, forest, "c_custkey")


def _extra(table, count: int):
    rows = _customers(table)
    return rows, trees.train_extra_trees(rows, CUSTOMER, "label", EXTRA, f=FB, trees=count, features=3, seed=3)


@query(_forest_sql(_drawn_sql(5, 3, 3), 3, EXTRA, soft=True))
def extra_trees_votes(spark, table):
    rows, forest = _extra(table, 5)
    return trees.votes(rows, forest, "c_custkey", soft=True)


@query(_forest_sql(_drawn_sql(5, 3, 3), 3, EXTRA))
def extra_trees_majority(spark, table):
    """The same trees' majority, which isn't their soft vote."""
    rows, forest = _extra(table, 5)
    return trees.votes(rows, forest, "c_custkey")


@query(_forest_sql(_drawn_sql(8, 3, 3), 3, EXTRA, each=2))
def extra_trees_bulk(spark, table):
    """Four runs of two trees each, trained as one job, and every run's own vote."""
    rows, forest = _extra(table, 8)
    return trees.bulk_votes(rows, forest, "c_custkey", 4)


_VOTE = f"""WITH {_C}, {_CB}, s AS (SELECT arg_max(slot, {_KEY}) AS slot FROM {_CG}),
p AS (SELECT c_custkey, label, CASE s.slot WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS bin FROM b, s),
v AS (SELECT bin, (count(*) FILTER (label = 1) > count(*) FILTER (label = 0))::INTEGER AS class FROM p GROUP BY 1)"""


def _one_tree(table):
    rows = _customers(table)
    return rows, trees.train_random_forest(rows, CUSTOMER, "label", trees.TreeConfig(depth=2, epsilon=0.0), f=FB, single_tree=True)


@query(f"{_VOTE} SELECT c_custkey, class FROM p JOIN v USING (bin)")
def classify_majority(spark, table):
    rows, forest = _one_tree(table)
    return trees.votes(rows, forest, "c_custkey")


@query(f"{_VOTE} SELECT c_custkey, class FROM p JOIN v USING (bin)")
def classify_soft(spark, table):
    rows, forest = _one_tree(table)
    return trees.votes(rows, forest, "c_custkey", soft=True)


@query(f"{_VOTE} SELECT count(*) FILTER (class = label) AS correct, count(*) AS rows, count(*) FILTER (class = label) / count(*) AS accuracy FROM p JOIN v USING (bin)")
def tree_accuracy(spark, table):
    rows, forest = _one_tree(table)
    return trees.accuracy(trees.votes(rows, forest, "c_custkey"), rows, "c_custkey", "label")


# Files, written and read back


def _written(spark, lines: DataFrame) -> str:
    path = f"{shared_dir(spark)}/torvane-files-{uuid.uuid4().hex}"
    files.write_lines(lines, path)
    return path


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey AS v FROM orders")
def file_column(spark, table):
    return files.read_column(spark, _written(spark, table("orders").sort("o_orderkey").select(F.col("o_orderkey").cast("string").alias("value"))))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, p_partkey % 2 AS hi, p_partkey * 1000003 AS lo FROM part")
def file_hex(spark, table):
    k = F.col("p_partkey")
    text = F.concat(F.lit("0x"), F.upper(bits.hex128(k % 2, k * 1000003)))
    return files.read_hex_column(spark, _written(spark, table("part").sort(k).select(text.alias("value"))))


_PART = "(SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, p_partkey, p_size::BIGINT AS p_size, p_retailprice FROM part)"


def _part_lines(spark, table, *columns: str) -> str:
    return _written(spark, table("part").sort("p_partkey").select(F.concat_ws(",", *columns).alias("value")))


@query(f"SELECT row, col, v FROM (SELECT row, 0 AS col, p_partkey AS v FROM {_PART} UNION ALL SELECT row, 1, p_size FROM {_PART})")
def file_matrix(spark, table):
    return files.read_matrix(spark, _part_lines(spark, table, "p_partkey", "p_size"))


@query(f"SELECT row, col, v FROM (SELECT row, 0 AS col, p_partkey::DOUBLE AS v FROM {_PART} UNION ALL SELECT row, 1, p_retailprice FROM {_PART})")
def file_float_matrix(spark, table):
    return files.read_float_matrix(spark, _part_lines(spark, table, "p_partkey", "p_retailprice"))


@query(f"SELECT row::INTEGER AS tree, col AS slot, v::INTEGER AS attr FROM (SELECT row, 0 AS col, p_partkey AS v FROM {_PART} UNION ALL SELECT row, 1, p_size FROM {_PART})")
def file_picks(spark, table):
    return files.read_picks(spark, _part_lines(spark, table, "p_partkey", "p_size"))


@query(f"SELECT row::INTEGER AS tree, col AS slot, trunc(v * 1024)::BIGINT AS cut FROM (SELECT row, 0 AS col, p_partkey::DOUBLE AS v FROM {_PART} UNION ALL SELECT row, 1, p_retailprice FROM {_PART})")
def file_splits(spark, table):
    return files.read_splits(spark, _part_lines(spark, table, "p_partkey", "p_retailprice"), FB)


@query(_SQL["tree_learn"])
def file_nodes(spark, table):
    nodes = trees.induce(_tree_rows(table).drop("node"), trees.TreeConfig(bins=5, depth=2)).withColumn("attr", F.col("slot"))
    path = f"{shared_dir(spark)}/torvane-files-{uuid.uuid4().hex}"
    files.write_nodes(nodes, path)
    return files.read_nodes(spark, path).select("node", "layer", "slot", F.get("freqs", F.lit(0)).alias("n0"), F.get("freqs", F.lit(1)).alias("n1"))


@query(_SQL["extra_trees_votes"])
def file_forest(spark, table):
    """Soft votes of trees that were written as one document each and read again."""
    rows, forest = _extra(table, 5)
    path = f"{shared_dir(spark)}/torvane-files-{uuid.uuid4().hex}"
    files.write_forest(forest, path)
    again = files.read_forest(spark, path)
    release(forest.nodes, forest.cuts)
    return trees.votes(rows, again, "c_custkey", soft=True)


@query("SELECT k AS party, sum(trunc(c_acctbal * 1024)::BIGINT)::BIGINT AS balance, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1024 ELSE 0 END)::BIGINT AS label, count(*) AS n FROM customer, (VALUES (0)) v(k) GROUP BY 1")
def cohort_shares(spark, table):
    """Two parties' cohorts, joined and shared, summed share by share and opened."""
    own = table("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    parts = [own.filter(F.col("c_custkey") % 2 == k) for k in (0, 1)]
    shared = files.prepare_shares(parts, drop=["c_custkey"], label="c_mktsegment", positive="BUILDING", f=FB, dealer=Dealer(("c_custkey",)))
    total = lambda c: (F.sum(f"{c}.s0") + F.sum(f"{c}.s1")).alias({"c_acctbal": "balance", "c_mktsegment": "label"}[c])
    return shared.agg(total("c_acctbal"), total("c_mktsegment"), F.count("*").alias("n")).select(F.lit(0).alias("party"), "balance", "label", "n")
