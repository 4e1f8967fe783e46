import json
import random

import pytest
from pyspark.sql import functions as F

from torvane.functions.ring import ring
from torvane.functions.share import Dealer, open_sum
from torvane.operators import aggregates as ag
from torvane.operators import discretize as dz
from torvane.operators import linalg, packing, sets
from torvane.operators.lineage import shared_dir, with_index
from torvane.operators.models import logistic, naive_bayes, trees
from torvane.plans import catalogue
from torvane.plans.dispatch import model
from torvane.sources import files
from torvane.streaming.shares import shared_window_sums


@pytest.mark.parametrize("width,n,pad", [(1, 1, None), (1, 130, None), (3, 50, 1), (7, 19, 0), (11, 64, 1), (33, 8, None), (63, 5, 1), (64, 3, None)])
def test_pack_and_unpack(spark, width, n, pad):
    r = random.Random(width)
    values = [r.getrandbits(width) for _ in range(n)]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    with ring(spark):
        rows = spark.createDataFrame(list(enumerate(signed)), "i long, v long")
        words = packing.pack(rows, width, pad=pad)
        got = {x.word: (x.hi % (1 << 64)) << 64 | x.lo % (1 << 64) for x in words.collect()}
        back = [x.v for x in packing.unpack(words, width, n, padded=pad is not None).sort("i").collect()]
    assert back == signed
    wide = width + 1 if pad is not None and width % 2 else width
    want: dict[int, int] = {}
    for i, v in enumerate(values):
        v = v << 1 | pad if wide != width else v
        want[i // (128 // wide)] = want.get(i // (128 // wide), 0) | v << (128 - wide * (i % (128 // wide) + 1))
    assert got == want


def test_pack_rejects_widths(spark):
    rows = spark.createDataFrame([(0, 1)], "i long, v long")
    for bad in (0, 65):
        with pytest.raises(ValueError):
            packing.pack(rows, bad)


def test_min_max_product_and_ties(spark):
    r = random.Random(1)
    columns = [f"c{i}" for i in range(20)]
    data = [[r.randrange(1, 500) for _ in columns] for _ in range(211)]
    rows = spark.createDataFrame(data, columns)
    got = {x.col: (x.lo, x.hi) for x in ag.min_max(rows, columns).collect()}
    assert got == {c: (min(d[i] for d in data), max(d[i] for d in data)) for i, c in enumerate(columns)}
    assert ag.min_max(rows.limit(1), ["c0"]).first().lo == rows.first().c0
    with ring(spark):
        df = spark.createDataFrame([("a", v) for v in range(1, 40)] + [("b", 7)], "k string, v long")
        want = 1
        for v in range(1, 40):
            want = want * v % (1 << 64)
        for f in (df.groupBy("k").agg(ag.product(F.col("v")).alias("product")), ag.long_product(df, ["k"], "v")):
            out = {x.k: x["product"] for x in f.collect()}
            assert out["b"] == 7 and out["a"] % (1 << 64) == want
        best = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "i long, s long").agg(ag.first_argmax(F.col("s"), F.col("i"))).first()[0]
        ratio = ag.first_argmax_ratio(spark.createDataFrame([("k", 0, 1, 3), ("k", 1, 2, 6), ("k", 2, 1, 4)], "k string, i long, n long, d long"), ["k"], "n", "d", "i").first()
    assert best == 2 and ratio.i == 0


def test_matmul_shapes(spark):
    r = random.Random(2)
    for m, n, p in ((1, 1, 1), (1, 10, 3), (7, 5, 2)):
        a = [[r.randrange(256) for _ in range(n)] for _ in range(m)]
        b = [[r.randrange(-256, 256) for _ in range(p)] for _ in range(n)]
        cells = lambda x: spark.createDataFrame([(i, j, v) for i, row in enumerate(x) for j, v in enumerate(row)], "row long, col long, v long")
        want = {(i, j): sum(a[i][k] * b[k][j] for k in range(n)) for i in range(m) for j in range(p)}
        with ring(spark):
            plain = {(x.row, x.col): x.v for x in linalg.matmul(cells(a), cells(b)).collect()}
            share = lambda x, s: cells(x).select("row", "col", Dealer(("row", "col"), s).share(F.col("v")).alias("v"))
            shared = linalg.shared_matmul(share(a, 1), share(b, 2), Dealer(("row", "m", "col"))).select("row", "col", open_sum(F.col("v")).alias("v"))
            assert plain == want == {(x.row, x.col): x.v for x in shared.collect()}
    lists = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "i int, v array<long>")
    assert {x["col"]: x["values"] for x in linalg.transpose_arrays(lists, "i", "v").collect()} == {0: [1, 3], 1: [2, 4]}


def test_bins(spark):
    with ring(spark):
        rows = spark.createDataFrame([(i, 5) for i in range(11)], "x long, same long")
        out = dz.binned(rows, ["x", "same"], 5, 10).collect()
    assert [r.bins[0] for r in out] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4] or max(r.bins[0] for r in out) == 4
    assert all(r.bins[1] == 4 for r in out)
    with pytest.raises(ValueError):
        dz.edges(rows, ["x"], 1, 10)


def test_choices_by_hash(spark):
    with ring(spark):
        a = dz.pick_without_replacement(spark, 4, 3, 6, 1).collect()
        assert all(len({r.attr for r in a if r.tree == t}) == 3 for t in range(4))
        b = dz.pick_with_replacement(spark, 50, 10, 6, 1).collect()
        assert {r.attr for r in b} == set(range(6)) and len(b) == 500
        assert [r.attr for r in dz.pick_all(spark, 4).sort("slot").collect()] == [0, 1, 2, 3]
        rows = with_index(spark.range(100).repartition(7))
        assert sorted(r.i for r in rows.collect()) == list(range(100))
        drawn = dz.bootstrap(rows, 3, 40, 100, 1).groupBy("tree").count().collect()
        assert {r.tree: r["count"] for r in drawn} == {0: 40, 1: 40, 2: 40}
        assert dz.bootstrap(rows, 2, 0, 100, 1).count() == 200
        values = rows.select((F.col("i") * 10).alias("v"))
        for r in dz.random_cuts(values, ["v"], dz.pick_with_replacement(spark, 5, 5, 1, 1), 10, 1).collect():
            assert 0 <= r["cut"] < 990


def test_set_matching_keeps_multiplicity(spark):
    d = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    e = spark.createDataFrame([("a",), ("a",), ("c",), ("z",)], "word string")
    assert {r.word: r.m for r in sets.match_counts(d, e).collect()} == {"a": 2, "b": 0, "c": 1}
    assert {r.word for r in sets.members(d, e).collect()} == {"a", "c"}


def test_naive_bayes_prefers_the_first_on_ties(spark):
    with ring(spark):
        words = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "unknown")], "id long, word string")
        logp = spark.createDataFrame([("x", 0, -5), ("x", 1, -9), ("y", 0, -9), ("y", 1, -5)], "word string, class int, logp long")
        prior = spark.createDataFrame([(0, -1), (1, -1)], "class int, prior long")
        assert {r.id: r["class"] for r in naive_bayes.predict(naive_bayes.counted(words), logp, prior).collect()} == {1: 0, 2: 1, 3: 0}


def test_logistic_regression_separates(spark):
    rows = [(1024, (i % 20 - 10) * 100, 1024 if i % 20 > 10 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "one long, x long, y long")
    w = logistic.learn(df, ["one", "x"], "y", f=10, rate=4, rounds=25)
    out = logistic.predict(df, ["one", "x"], w, 10).collect()
    assert sum((r.y > 0) == (r.predicted == 1) for r in out) > 180


def brute_tree(rows, bins, depth, classes=2, epsilon=0.05):
    out, total, at = {}, len(rows), {0: rows}
    for layer in range(depth):
        after = {}
        for node, own in at.items():
            freqs = [sum(label == c for label, _ in own) for c in range(classes)]
            stop = layer == depth - 1 or epsilon * total >= len(own) or max(freqs) == len(own)
            best = None
            if layer < depth - 1:
                scores = []
                for s in range(len(own[0][1])):
                    parts = []
                    for b in {x[s] for _, x in own}:
                        n = [sum(label == c and x[s] == b for label, x in own) for c in range(classes)]
                        parts.append(int(sum(v * v for v in n) * 1024 / (sum(n) + 1)))
                    scores.append(sum(parts))
                best = scores.index(max(scores))
            out[node] = (layer, best, freqs if stop else [0] * classes)
            if not stop:
                for label, x in own:
                    after.setdefault(bins * node + x[best] + 1, []).append((label, x))
        at = after
    return out


def test_tree_is_the_brute_force_one(spark):
    r = random.Random(5)
    rows = [(int(r.random() < 0.2 + 0.5 * (a > 1)), [a, b, r.randrange(3)]) for a, b in ((r.randrange(3), r.randrange(3)) for _ in range(300))]
    df = spark.createDataFrame([(0, label, x) for label, x in rows], "tree int, label int, bins array<int>")
    with ring(spark):
        got = trees.induce(df, trees.TreeConfig(bins=3, depth=3)).collect()
    assert {x.node: (x.layer, x.slot, x.freqs) for x in got} == brute_tree(rows, 3, 3)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(7)
    data = [(i, r.randrange(-2000, 2000), r.randrange(1000), r.randrange(1000)) for i in range(400)]
    return spark.createDataFrame([(i, a, b, c, int(a > 300)) for i, a, b, c in data], "id long, a long, b long, c long, label int").cache()


def test_forests_learn_and_survive_json(spark, labelled, tmp_path):
    columns = ["a", "b", "c"]
    forest = trees.train_random_forest(labelled, columns, "label", trees.TreeConfig(depth=3, epsilon=0.0), f=10, trees=5, features=2, instances=300, seed=2)
    for soft in (False, True):
        assert trees.accuracy(trees.votes(labelled, forest, "id", soft=soft), labelled, "id", "label").first().accuracy > 0.8
    files.write_nodes(forest.nodes, f"{tmp_path}/nodes")
    forest.nodes = files.read_nodes(spark, f"{tmp_path}/nodes")
    assert trees.votes(labelled, forest, "id").count() == 400
    extra = trees.train_extra_trees(labelled, columns, "label", trees.TreeConfig(depth=4, epsilon=0.0), f=10, trees=30, features=3, seed=2)
    assert trees.accuracy(trees.votes(labelled, extra, "id", soft=True), labelled, "id", "label").first().accuracy > 0.8


def test_files(spark, tmp_path):
    (tmp_path / "u.csv").write_text("0\n18446744073709551615\n5\n")
    (tmp_path / "m.csv").write_text("1,2,3\n4,5,6\n")
    (tmp_path / "f.csv").write_text("0.5,-1.25\n3,4e2\n")
    (tmp_path / "h.csv").write_text("0xff\n0xFFFFFFFFFFFFFFFF0000000000000001\n")
    with ring(spark):
        assert [r.v for r in files.read_column(spark, f"{tmp_path}/u.csv").sort("row").collect()] == [0, -1, 5]
        m = files.read_matrix(spark, f"{tmp_path}/m.csv")
        assert sorted((r.row, r.col, r.v) for r in m.collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6)]
        assert sorted(r.v for r in files.read_float_matrix(spark, f"{tmp_path}/f.csv").collect()) == [-1.25, 0.5, 3, 400]
        assert [(r.hi, r.lo) for r in files.read_hex_column(spark, f"{tmp_path}/h.csv").sort("row").collect()] == [(0, 255), (-1, 1)]
        assert [(r.tree, r.slot, r.attr) for r in files.read_picks(spark, f"{tmp_path}/m.csv").sort("tree", "slot").collect()][3] == (1, 0, 4)
        assert files.read_splits(spark, f"{tmp_path}/f.csv", 10).sort("tree", "slot").first()["cut"] == 512
        files.write_matrix(m, f"{tmp_path}/out")
        assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["1,2,3", "4,5,6"]
        files.write_lines(spark.createDataFrame([("x",)], "value string"), f"{tmp_path}/lines")
        parts = [spark.createDataFrame([(1, "Wild Type", 0.5)], "pid long, kind string, g double"), spark.createDataFrame([(2, "Other", -2.0)], "pid long, kind string, g double")]
        shared = files.prepare_shares(parts, drop=["pid"], label="kind", positive="Other", f=10, dealer=Dealer(("pid",)))
        assert sorted(shared.select(open_sum(F.col("g")), open_sum(F.col("kind"))).collect()) == [(-2048, 1024), (512, 0)]


def test_stream_of_shares(spark, tmp_path):
    rows = [{"id": i, "ts": f"2024-01-01T00:{i // 2:02d}:00", "kind": "ab"[i % 2], "v": i * 0.5} for i in range(20)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    events = spark.readStream.schema("id long, ts timestamp, kind string, v double").json(f"{tmp_path}/in")
    out = shared_window_sums(events, ts="ts", key="kind", value="v", ids=("id",), window="5 minutes", late="1 hour", f=10)
    q = out.writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.start.minute, r.kind): r.total for r in spark.table("sums").collect()}
    want: dict = {}
    for i, r in enumerate(rows):
        k = (i // 2 // 5 * 5, r["kind"])
        want[k] = want.get(k, 0) + int(r["v"] * 1024)
    assert got == want


def test_dispatch():
    assert model("naivebayes", "learning") is naive_bayes.learn
    with pytest.raises(ValueError):
        model("time_test", "learning")


def test_products_take_every_row(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, 2 * r.randrange(50)) for k, n in ((1, 1), (2, 4), (3, 13), (4, 3000)) for _ in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    want: dict[int, int] = {}
    for k, v in rows:
        want[k] = want.get(k, 1) * (v + 1) % (1 << 64)
    got = {x.o_orderkey: x["product"] % (1 << 64) for x in catalogue.queries()["products"](spark, str(tmp_path)).collect()}
    assert got == want


def test_readers_keep_the_order_of_lines_over_many_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [str(i * 7 + 10**9) for i in range(30000)]
    (tmp_path / "in/a.csv").write_text("\n".join(lines[:100]) + "\n")
    (tmp_path / "in/b.csv").write_text("\n\n".join(lines[100:]) + "\n \n")
    size, cost = (spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        with ring(spark):
            got = files.read_column(spark, f"{tmp_path}/in").collect()
            index = with_index(spark.range(1000, numPartitions=7).withColumn("v", F.col("id"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert [r.v for r in sorted(got, key=lambda r: r.row)] == [int(x) for x in lines] and [r.row for r in sorted(got)] == list(range(30000))
    assert all(r.i == r.v for r in index) and len(index) == 1000


def test_bulk_training_is_runs_side_by_side(spark, labelled):
    forest = trees.train_extra_trees(labelled, ["a", "b", "c"], "label", trees.TreeConfig(depth=3, epsilon=0.0), f=10, trees=6, features=3, seed=2)
    out = trees.bulk_votes(labelled, forest, "id", 2)
    assert out.groupBy("run").count().collect() == [(0, 400), (1, 400)] or {r.run: r["count"] for r in out.groupBy("run").count().collect()} == {0: 400, 1: 400}
    one = trees.Forest(forest.nodes.filter("tree >= 3"), forest.cuts.filter("tree >= 3"), forest.columns, forest.config)
    assert sorted(out.filter("run = 1").drop("run").collect()) == sorted(trees.votes(labelled, one, "id").collect())
    with pytest.raises(ValueError):
        trees.bulk_votes(labelled, forest, "id", 4)


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getCheckpointDir = "yarn", staticmethod(lambda: None)  # noqa: N815

    class Session:
        conf, sparkContext = Conf, Context  # noqa: N815

    with pytest.raises(ValueError):
        shared_dir(Session)
