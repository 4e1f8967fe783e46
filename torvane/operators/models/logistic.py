"""Logistic regression by full-batch gradient descent in fixed point, with a clipped ramp for the sigmoid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.functions.ring import big, clipped_relu, ring, truncate
from torvane.functions.share import Dealer, Held, Pair, open_sum, pair, scale, subtract
from torvane.operators.lineage import cut, release


def response(features: list[str], weights: list[int], f: int) -> Column:
    """The weighted sum, cut once, through the ramp."""
    z = big(0)
    for x, w in zip(features, weights, strict=True):
        z = z + F.col(x) * big(w)
    return clipped_relu(truncate(z, f), f)


def learn(rows: DataFrame, features: list[str], label: str, *, f: int, rate: int, rounds: int) -> list[int]:
    """Weights after some rounds from zero. features and label are fixed point, rate its raw value. Each round is one
    aggregate over the rows, and only its sums, one for each feature, reach the driver, so no lineage grows."""
    weights = [0] * len(features)
    with ring(rows.sparkSession):
        # rows alike are one, with a count: sums in the ring are the same in any order
        rows = rows.groupBy(*features, label).agg(F.count("*").alias("torvane_n")).persist()
        try:
            own = rows.coalesce(max(1, rows.count() >> 20))  # a task for a million of them, so that a small table needs no shuffle in a round
            for _ in range(rounds):
                d = F.col("torvane_n") * (F.col(label) - response(features, weights, f))
                g = own.select(*features, d.alias("d")).agg(*(truncate(F.sum(F.col(x) * F.col("d")), f).alias(x) for x in features)).first()
                weights = [w + ((rate * (g[x] or 0)) >> f) for w, x in zip(weights, features, strict=True)]
        finally:
            rows.unpersist()
    return weights


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def learn_shared(rows: DataFrame, features: list[str], label: str, dealer: Dealer, *, f: int, rate: int, rounds: int, top: int) -> list[tuple[int, int]]:
    """Shares of the weights that learn() gives, from rows (dealer's keys, features, label) whose features and label are shares.

    Features are opened once, under a mask that every round uses; weights and differences get masks of their own each round. Products are cut exactly, so the
    weights open to learn()'s. A round is one job, of which only shares of the steps reach the driver. Weighted sums must be below 2 ** top in size once cut.
    """
    spark, weights = rows.sparkSession, [(0, 0)] * len(features)
    with ring(spark):
        u = {x: dealer.share(dealer.random("mask", x), "mask", x) for x in features}
        table = cut(rows.select(*dealer.keys, *(open_sum(subtract(F.col(x), u[x])).alias(f"e_{x}") for x in features), *(u[x].alias(f"u_{x}") for x in features), F.col(label).alias("y")))
        own = table.coalesce(max(1, spark.sparkContext.defaultParallelism))
        named = [f"{kind}_{x}" for x in features for kind in ("f", "v0", "v1")]
        for k in range(rounds):
            name = f"round{k}"
            # each weight less its mask is public; the mask stays as two shares
            seeds = spark.range(1).select(*(F.xxhash64(F.lit(dealer.seed), F.lit(name), F.lit(i)).alias(f"c{i}") for i in range(2 * len(features)))).first()
            row = []
            for i, (w0, w1) in enumerate(weights):
                v0, v1 = seeds[2 * i], seeds[2 * i + 1]
                row += [_wrapped(w0 + w1 - v0 - v1), v0, v1]
            public = spark.createDataFrame([tuple(row)], ", ".join(f"{c} long" for c in named))
            at = Held(own.crossJoin(F.broadcast(public)))
            of = lambda x: (F.col(f"e_{x}"), F.col(f"u_{x}"), F.col(f"f_{x}"), Pair(F.col(f"v0_{x}"), F.col(f"v1_{x}")))
            z0, z1, dealt = big(0), big(0), big(0)
            for x in features:
                e, mask, open_w, v = of(x)
                z0 = z0 + e * v.s0 + mask.s0 * open_w
                z1 = z1 + e * v.s1 + mask.s1 * open_w + e * open_w
                dealt = dealt + open_sum(mask) * open_sum(v)
            r = dealer.random("scores", name)
            (z,) = at.hold(dealer.truncate(at, pair(z0 + r, z1 + dealt - r), f, name, "scores"))
            (d,) = at.hold(subtract(F.col("y"), dealer.clipped_relu(at, z, f, top, name)))
            t = dealer.share(dealer.random("difference", name), "difference", name)
            (t,) = at.hold(t)
            rows_of = at.done(d=open_sum(subtract(d, t)), t=t.column)
            step = []
            for i, x in enumerate(features):
                e, mask, _, _ = of(x)
                sums = F.sum(e * F.col("t.s0") + mask.s0 * F.col("d")), F.sum(e * F.col("t.s1") + mask.s1 * F.col("d") + e * F.col("d")), F.sum(open_sum(mask) * (F.col("t.s0") + F.col("t.s1")))
                step.append(F.struct(F.lit(i).alias("feature"), *(v.alias(n) for v, n in zip(sums, ("s0", "s1", "w"), strict=True))))
            # a row for each feature, whose sum is cut, and cut again times the rate
            at, own_random = Held(rows_of.agg(F.array(*step).alias("all")).select(F.inline("all"))), Dealer(("feature",), dealer.seed)
            r = own_random.random("step", name)
            g = own_random.truncate(at, pair(F.col("s0") + r, F.col("s1") + F.col("w") - r), f, name, "gradient")
            move = own_random.truncate(at, scale(g, rate), f, name, "step")
            for got in at.done(move=move.column).filter("s0 is not null").collect():  # no rows leave weights as they are
                w0, w1 = weights[got.feature]
                weights[got.feature] = _wrapped(w0 + got.move.s0), _wrapped(w1 + got.move.s1)
        release(table)
    return weights


def predict(rows: DataFrame, features: list[str], weights: list[int], f: int) -> DataFrame:
    """rows with a column predicted: 1 where the response reaches a half."""
    with ring(rows.sparkSession):
        return rows.withColumn("predicted", (response(features, weights, f) >= big(1 << (f - 1))).cast("int"))
