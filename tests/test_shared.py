"""Shared operators across rows, and exact orders of ratios, against plain Python."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from torvane.functions import gates, share
from torvane.functions.ring import ring
from torvane.functions.share import Dealer, Held
from torvane.operators import aggregates as ag
from torvane.operators import linalg, shared
from torvane.operators.models import logistic, trees
from torvane.plans import catalogue

NONE = Dealer(())


def signed(x):
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def dealt(spark, groups, keys=("k",)):
    """Rows (k, torvane_i, v) of shared values, group by group."""
    rows = [(k, i, v) for k, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"k string, {shared.I} long, v long")
    return df.withColumn("v", Dealer(("k", shared.I)).share(F.col("v"), "v").column)


def test_exact_truncation(spark):
    r = random.Random(1)
    values = [0, 1, -1, 1023, 1024, -1024, -1025, (1 << 63) - 1, -(1 << 63), *(signed(r.getrandbits(64)) for _ in range(300)), *(r.randrange(-5000, 5000) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    d = Dealer(("i",))
    with ring(spark):
        for f in (1, 10, 31, 63):
            at = Held(df)
            got = at.done(t=share.open_sum(d.truncate(at, d.share(F.col("v")), f))).collect()
            assert {x.i: x.t for x in got} == {i: v >> f for i, v in enumerate(values)}, f


def test_order_of_ratios(spark):
    r = random.Random(5)
    big = (1 << 63) - 1
    pairs = [(1, 3), (333333, 1000000), (2, 6), (0, 7), (0, 1), (-1, 3), (-7, 2), (big, big - 1), (big - 1, big - 2), (-big - 1, big), (big, 1), (1, big), (1, big - 1), *((r.randrange(-9, 9), r.randrange(1, 9)) for _ in range(60)), *((r.getrandbits(62), r.getrandbits(62) + 1) for _ in range(60))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, n long, d long")
    with ring(spark):
        keys = {x.i: tuple(x.key) for x in df.select("i", ag.ratio_key(F.col("n"), F.col("d")).alias("key")).collect()}
    for (i, a), (j, b) in itertools.product(enumerate(pairs), repeat=2):
        assert (keys[i] < keys[j]) == (Fraction(*a) < Fraction(*b)) and (keys[i] == keys[j]) == (Fraction(*a) == Fraction(*b)), (a, b)
    every = [Fraction(abs(n), d) for n, d in pairs]
    for a, b in itertools.product(every, repeat=2):
        assert (trees.ratio_key(a) < trees.ratio_key(b)) == (a < b) and (trees.ratio_key(a) == trees.ratio_key(b)) == (a == b)
    with ring(spark):
        close = spark.createDataFrame([("k", 0, 333333, 1000000), ("k", 1, 1, 3), ("k", 2, 2, 6)], "k string, i long, n long, d long")
        assert ag.first_argmax_ratio(close, ["k"], "n", "d", "i").first().i == 1


def test_splits_that_are_very_close(spark):
    """Scores 99/101 + 100/101 and so on that differ by less than 1/1024 are told apart, equal ones tie to the lower slot."""
    cells = {0: [(500, 501), (499, 500)], 1: [(501, 502), (498, 499)], 2: [(501, 502), (498, 499)]}
    rows = [(0, 0, slot, b, c, n) for slot, sides in cells.items() for b, (x, y) in enumerate(sides) for c, n in ((0, x), (1, y))]
    scores = {s: sum(Fraction(x * x + y * y, x + y + 1) for x, y in sides) for s, sides in cells.items()}
    best = min(s for s in scores if scores[s] == max(scores.values()))
    assert 0 < abs(scores[0] - scores[1]) < Fraction(1, 1024)
    with ring(spark):
        got = trees.gini_scores(spark.createDataFrame(rows, "tree int, node long, slot int, bin int, label int, n long"))
        assert {r.slot: r.score for r in got.collect()} == {s: int(x * 1024) for s, x in scores.items()}
        assert trees.best_slots(got).first().slot == best


@pytest.mark.parametrize("rounds", [3])
def test_trees_of_rows(spark, rounds, monkeypatch):
    monkeypatch.setattr(shared, "ROUNDS", rounds)
    r = random.Random(rounds)
    groups = {"one": [-7], "two": [5, -5], "odd": [3, 9, 3], "same": [4] * 5, "many": [r.randrange(-(10**9), 10**9) for _ in range(37)]}
    with ring(spark):
        rows = dealt(spark, groups)
        got = {x.k: (x.lo, x.hi) for x in shared.min_max(rows, ["k"], "v", NONE, 41).select("k", share.open_sum(F.col("lo")).alias("lo"), share.open_sum(F.col("hi")).alias("hi")).collect()}
        assert got == {k: (min(v), max(v)) for k, v in groups.items()}
        got = {x.k: x.v for x in shared.products(rows, ["k"], "v", NONE).select("k", share.open_sum(F.col("v")).alias("v")).collect()}
        want = {}
        for k, values in groups.items():
            want[k] = 1
            for v in values:
                want[k] = signed(want[k] * v)
        assert got == want
        assert shared.products(rows.limit(0), ["k"], "v", NONE).collect() == [] and shared.min_max(rows.limit(0), ["k"], "v", NONE, 41).collect() == []
        gaps = rows.withColumn(shared.I, F.col(shared.I) * 5 + 2)
        assert {x.k: x.v for x in shared.products(gaps, ["k"], "v", NONE).select("k", share.open_sum(F.col("v")).alias("v")).collect()} == want


def test_min_max_of_211_columns(spark):
    r = random.Random(0)
    table = {f"c{k:03}": [r.randrange(1, 500) for _ in range(211)] for k in range(211)}
    with ring(spark):
        got = shared.min_max(dealt(spark, table), ["k"], "v", NONE, 20).select("k", share.open_sum(F.col("lo")).alias("lo"), share.open_sum(F.col("hi")).alias("hi")).collect()
    assert {x.k: (x.lo, x.hi) for x in got} == {k: (min(v), max(v)) for k, v in table.items()}


def test_positions_count_groups(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 9), ("b", 1), ("c", 40)) for i in range(n)], "k string, o long").repartition(5)
    got = shared.positions(rows, ["k"], ["o"]).collect()
    assert sorted((r.k, r.o) for r in got) == sorted((r.k, r[shared.I]) for r in got) and all(r.o == r[shared.I] for r in got)
    assert sorted(r[shared.I] for r in shared.positions(rows, [], ["k", "o"]).collect()) == list(range(50))


def test_one_hot_of_the_largest_ratio(spark):
    r = random.Random(9)
    groups = {"one": [(1, 2)], "ties": [(1, 3), (2, 6), (1, 4), (3, 9)], "last": [(1, 9), (1, 8), (1, 7)], "close": [(333333, 1000000), (1, 3)], "many": [(r.randrange(900), r.randrange(1, 900)) for _ in range(37)]}
    rows = spark.createDataFrame([(k, i, *p) for k, v in groups.items() for i, p in enumerate(v)], "k string, slot long, n long, d long")
    d = Dealer(("k", "slot"))
    with ring(spark):
        own = rows.select("k", "slot", d.share(F.col("n"), "n").alias("n"), d.share(F.col("d"), "d").alias("d"))
        got = shared.argmax_ratio(own, ["k"], "slot", "n", "d", NONE, 41).select("k", "slot", share.open_sum(F.col("hot")).alias("hot")).collect()
        assert shared.argmax_ratio(own.limit(0), ["k"], "slot", "n", "d", NONE, 41).collect() == []
    best = {k: max(range(len(v)), key=lambda i: (Fraction(*v[i]), -i)) for k, v in groups.items()}
    assert sorted((x.k, x.slot, x.hot) for x in got) == sorted((k, i, int(i == best[k])) for k, v in groups.items() for i in range(len(v)))


def test_bins_on_shares(spark):
    r = random.Random(2)
    for lo, hi, n in ((-5000, 7001, 5), (3, 3, 2), (0, 1 << 30, 7)):
        values = [lo, hi, *(lo + (((j << 10) // n * (hi - lo)) >> 10) + e for j in range(1, n) for e in (-1, 0, 1)), *(r.randint(lo, hi) for _ in range(40))]
        df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
        d = Dealer(("i",))
        with ring(spark):
            at = Held(df)
            x, a, b = at.hold(d.share(F.col("v"), "v"), d.share(F.lit(lo).cast("long"), "lo"), d.share(F.lit(hi).cast("long"), "hi"))
            hot = shared.bins(at, x, a, b, n, 10, d, 55)
            got = at.done(hot=F.array(*(share.open_sum(h) for h in hot))).collect()
        edges = [lo + (((j << 10) // n * (hi - lo)) >> 10) for j in range(1, n)]
        assert all(g.hot == [int(k == sum(g.v >= e for e in edges)) for k in range(n)] for g in got)


SHAPES = [s for s in itertools.product((1, 10, 100), repeat=4) if s[0] * s[1] * s[2] * s[3] <= 10000]


def test_products_of_a_masked_matrix(spark):
    """k products m x n by n x r of all shapes of 1, 10 and 100 that have at most 10,000 terms, each matrix opened once and used twice."""
    r = random.Random(3)
    a, b, want = [], [], {}
    for s, (k, m, n, p) in enumerate(SHAPES):
        x = [[r.randrange(256) for _ in range(n)] for _ in range(m)]
        a += [((s << 20) + i, (s << 20) + j, x[i][j]) for i in range(m) for j in range(n)]
        for q in range(k):
            y = [[r.randrange(-256, 256) for _ in range(p)] for _ in range(n)]
            b += [((s << 20) + q, (s << 20) + i, j, y[i][j]) for i in range(n) for j in range(p)]
            want |= {((s << 20) + q, (s << 20) + i, j): sum(x[i][t] * y[t][j] for t in range(n)) for i in range(m) for j in range(p)}
    left, right = spark.createDataFrame(a, "row long, col long, v long"), spark.createDataFrame(b, "k long, row long, col long, v long")
    with ring(spark):
        once = shared.masked(left.select("row", "col", Dealer(("row", "col")).share(F.col("v"), "a").alias("v")), Dealer(("row", "m")))
        for name in ("first", "second"):
            other = right.select("k", "row", "col", Dealer(("k", "row", "col"), 2).share(F.col("v"), name).alias("v"))
            got = shared.matmul_masked(once, other, NONE, name, batch=True).select("k", "row", "col", share.open_sum(F.col("v")).alias("v")).collect()
            assert {(x.k, x.row, x.col): x.v for x in got} == want
        flat = right.filter(F.col("k") == (len(SHAPES) - 1 << 20)).drop("k")
        one = shared.matmul_masked(once, flat.select("row", "col", Dealer(("row", "col"), 2).share(F.col("v"), "f").alias("v")), NONE, "flat").select("row", "col", share.open_sum(F.col("v")).alias("v"))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, linalg.matmul(left, flat).collect()))


def test_regression_on_shares_is_the_plain_one(spark):
    r = random.Random(7)
    rows = [(i, 1024, r.randrange(-3000, 3000), r.randrange(0, 2048), 1024 * (i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "i long, one long, a long, b long, y long")
    d = Dealer(("i",))
    names = ["one", "a", "b"]
    with ring(spark):
        own = df.select("i", *(d.share(F.col(c), c).alias(c) for c in (*names, "y")))
    got = logistic.learn_shared(own, names, "y", d, f=10, rate=300, rounds=2, top=41)
    assert [signed(a + b) for a, b in got] == logistic.learn(df, names, "y", f=10, rate=300, rounds=2)


def opened_ends(found):
    return {x.k: (x.lo, x.hi) for x in found.select("k", share.open_sum(F.col("lo")).alias("lo"), share.open_sum(F.col("hi")).alias("hi")).collect()}


def test_ends_of_many_rows_are_found_in_few_jobs(spark):
    """150,000 rows, more than a task takes at once: no table is written between rounds of comparisons. Null isn't a value, and may be a key."""
    x = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) - (1 << 39)
    k = F.when(F.col("id") % 1000 < 900, "hot").when(F.col("id") % 7 > 0, F.lit("other")).otherwise(F.lit(None))
    rows = spark.range(0, 150_000, 1, 2).select(k.alias("k"), F.col("id").alias(shared.I), F.when(F.col("id") % 5 > 0, x).alias("v"))
    rows = rows.union(spark.sql(f"SELECT 'none', {2 * 10**5}L, CAST(null AS long)"))
    want = {r.k: (r.lo, r.hi) for r in rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    with ring(spark):
        own = rows.withColumn("v", Dealer((shared.I,)).share(F.col("v"), "v").column)
        spark.sparkContext.setJobGroup("ends", "ends")
        try:
            got = opened_ends(shared.min_max(own, ["k"], "v", NONE, 41))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and got["none"] == (None, None) and None in got
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ends")) <= 3


@pytest.mark.parametrize("bits", [64, 256])
def test_gates_open_to_plain_results(bits):
    """Comparisons at the ends of their range, products, choices, and 64-bit counts in a wider ring and back."""
    r, p = random.Random(bits), bits - 2
    x = [0, -1, (1 << p - 1) - 1, -(1 << p - 1), 5, 5, *(r.randrange(-(1 << p - 1), 1 << p - 1) for _ in range(300))]
    y = [0, 0, -(1 << p - 1), (1 << p - 1) - 1, 5, 6, *(r.choice((v, v - 1, r.randrange(-(1 << p - 1), 1 << p - 1))) for v in x[6:])]
    at, kind = gates.Gates(1, bits, bits=bits), np.uint64 if bits == 64 else object

    def dealt_out(values, to=bits):
        own = [r.getrandbits(to) for _ in values]
        return tuple(np.array([v % (1 << to) for v in part], np.uint64 if to == 64 else object) for part in (own, [v - o for v, o in zip(values, own, strict=True)]))

    value = lambda s: [int(v) for v in at.kept(s[0] + s[1], s[0])[0]]
    a, b = dealt_out(x), dealt_out(y)
    more = at.geq(a, b, p)
    assert value(more) == [int(u >= v) for u, v in zip(x, y, strict=True)]
    assert value(at.mux(more, a, b)) == [max(u, v) % (1 << bits) for u, v in zip(x, y, strict=True)]
    assert value(at.multiply(a, b)) == [u * v % (1 << bits) for u, v in zip(x, y, strict=True)]
    counts = [0, 1, (1 << 62) + 1, *(r.getrandbits(40) for _ in range(100))]
    wide = at.widened(dealt_out(counts, 64))
    assert value(wide) == counts and wide[0].dtype == kind
    assert [int(v) for v in np.add(*at.narrowed(wide))] == counts
    empty = np.zeros(0, kind)
    assert len(at.geq((empty, empty), (empty, empty), p)[0]) == 0


def test_nulls_are_in_the_first_bin(spark, tmp_path):
    """On shares as in the plain query: a column with nulls and one without values, over more rows than a task takes at once; and a table without rows."""
    rows = spark.range(0, 70_000, 1, 1).selectExpr("double(id % 50) l_quantity", "if(id % 3 = 0, null, double(id % 977)) l_extendedprice", "double(null) l_discount", "id % 9 / 100.0D l_tax", "'R' l_returnflag")
    for name, own in (("some", rows), ("none", rows.limit(0))):
        own.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got, want = (sorted(map(tuple, catalogue.queries()[q](spark, f"{tmp_path}/{name}").select("slot", *(f"b{k}" for k in range(5))).collect())) for q in ("one_hot_sums_shared", "one_hot_sums"))
        assert got == want and len(got) == (4 if name == "some" else 0)
    assert got == []
