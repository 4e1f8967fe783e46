"""Models on shares against the plain ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from torvane.functions.ring import ring
from torvane.functions.share import Dealer, open_sum
from torvane.operators import lineage
from torvane.operators.models import naive_bayes, oblivious, trees
from torvane.sources import files


@pytest.mark.parametrize("bins, classes, epsilon", [(2, 2, 0.3), (3, 3, 0.0)])
def test_induction_opens_to_the_plain_one(spark, bins, classes, epsilon):
    """Two trees of other rows each: one has a stop rule that bites and a bin without rows, the other a single class below one of its bins."""
    r = random.Random(bins)
    rows = []
    for i in range(60):
        x = [r.randrange(bins), r.randrange(bins), min(r.randrange(bins + 1), bins - 1)]
        rows.append((0, i, (x[0] + (x[1] > 0) * r.randrange(2)) % classes, x))
        x = [r.randrange(bins), 0, r.randrange(bins)]
        rows.append((1, i, 0 if x[0] == 0 else r.randrange(classes), x))
    config = trees.TreeConfig(bins, 3, classes, epsilon)
    df = spark.createDataFrame(rows, "tree int, row long, label int, bins array<int>")
    with ring(spark):
        shares = oblivious.dealt(df, 3, config, Dealer(("tree", "row")))
        got = oblivious.reveal(oblivious.induce(shares, 3, config), config).collect()
        want = trees.induce(df, config).collect()
    line = lambda x: (x.tree, x.node, x.layer, x.slot, tuple(x.freqs), x.classifies)
    assert sorted(map(line, got), key=str) == sorted(map(line, want), key=str)
    assert any(x.classifies and x.layer == 1 for x in want)


def test_induction_of_too_many_rows_is_an_error(spark):
    config = trees.TreeConfig(5, 2, 2, 0.0)
    df = spark.range(200).selectExpr("0 tree", "id row", "0 label", "array(0) bins")
    with ring(spark):
        shares = oblivious.dealt(df, 1, config, Dealer(("tree", "row")))
        with pytest.raises(ValueError):
            oblivious.induce(shares, 1, config)


@pytest.mark.parametrize("bins", [2, 3])
def test_induction_of_more_rows_than_64_bits_compare(spark, bins):
    """9,000 rows: scores in a wider ring. Slots 1 and 2 are the same, so the first of them is taken; an odd number of slots."""
    config = trees.TreeConfig(bins, 3, 2, 0.01)
    x = [f"int(pmod(xxhash64(id, {k}), {bins}))" for k in range(4)]
    df = spark.range(9000).selectExpr("0 tree", "id row", f"int(if(pmod(xxhash64(id), 10) < 7, {x[1]} = 0, {x[3]} = 0)) label", f"array({x[0]}, {x[1]}, {x[1]}, {x[3]}, 0) bins")
    with ring(spark):
        shares = oblivious.dealt(df, 5, config, Dealer(("tree", "row")))
        got = oblivious.reveal(oblivious.induce(shares, 5, config, bits=None), config).collect()
        want = trees.induce(df, config).collect()
    line = lambda x: (x.tree, x.node, x.layer, x.slot, tuple(x.freqs), x.classifies)
    assert sorted(map(line, got), key=str) == sorted(map(line, want), key=str)
    assert next(x.slot for x in got if x.node == 0) == 1


def test_bayes_on_shares_is_the_plain_one(spark):
    """Three classes, words that the vocabulary lacks, an example of such words only, and ties, which go to the first class."""
    r = random.Random(4)
    logp = [(h, c, -r.randrange(1, 9000)) for h in range(1000, 1040) for c in range(3)] + [(7, c, -500) for c in range(3)]
    prior = [(0, -300), (1, -100), (2, -100)]
    counts = [(i, h, r.randrange(1, 5)) for i in range(40) for h in r.sample(range(990, 1050), 6)] + [(98, 7, 3), (99, 5, 2)]
    counts, logp, prior = (spark.createDataFrame(x, t) for x, t in ((counts, "id long, word long, m long"), (logp, "word long, class int, logp long"), (prior, "class int, prior long")))
    with ring(spark):
        own = counts.select("id", F.col("word").alias("h"), Dealer(("id", "word")).share(F.col("m"), "m").alias("m"))
        said = logp.select(F.col("word").alias("h"), "class", Dealer(("word", "class")).share(F.col("logp"), "p").alias("p"))
        first = prior.select("class", Dealer(("class",)).share(F.col("prior"), "prior").alias("p"))
        scores = oblivious.bayes_scores(own, said, first, 60)
        assert {(x.id, x["class"]): x.score for x in scores.select("id", "class", open_sum(F.col("score")).alias("score")).collect()} == {(x.id, x["class"]): x.score for x in naive_bayes.scores(counts, logp, prior).collect()}
        got = {x.id: x["class"] for x in oblivious.bayes_predict(own, said, first, 60, 41).select("id", open_sum(F.col("class")).alias("class")).collect()}
        one = oblivious.bayes_predict(own, said.filter("class = 0"), first.filter("class = 0"), 60, 41)
        assert {open_class for (open_class,) in one.select(open_sum(F.col("class"))).collect()} == {0} and one.count() == len({x.id for x in counts.collect()})
        assert oblivious.bayes_predict(own.limit(0), said, first, 60, 41).collect() == []
    assert got == {x.id: x["class"] for x in naive_bayes.predict(counts, logp, prior).collect()} and got[98] == got[99] == 1


def test_join_by_frequency_splits_a_hot_key(spark):
    """A table too large to broadcast: the hot key's rows and all others meet their rows once."""
    rows = spark.range(60000).selectExpr("id i", "if(id % 3 = 0, 5, id * 2) k")
    table = spark.range(140000).selectExpr("id k", "id * 10 v")
    want = sorted((i, k, k * 10) for i, k in ((i, 5 if i % 3 == 0 else i * 2) for i in range(60000)) if k < 140000)
    assert sorted((x.i, x.k, x.v) for x in lineage.join_by_frequency(rows, table, "k").select("i", "k", "v").collect()) == want


def test_forest_in_documents(spark, tmp_path):
    """A tree for each line, all nodes padded; what is read is what was written, and no document is an error."""
    r = random.Random(8)
    rows = [(i, r.randrange(1000), r.randrange(1000), r.randrange(1000)) for i in range(200)]
    df = spark.createDataFrame([(i, a, b, c, int(a + b // 2 > 700)) for i, a, b, c in rows], "id long, a long, b long, c long, label int")
    config = trees.TreeConfig(3, 3, 2, 0.2)
    forest = trees.train_random_forest(df, ["a", "b", "c"], "label", config, f=10, trees=3, features=2, instances=100)
    path = f"{tmp_path}/forest"
    files.write_forest(forest, path)
    documents = [json.loads(x.value) for x in spark.read.text(path).collect()]
    assert sorted(x["tree"] for x in documents) == [0, 1, 2]
    assert all(len(x["nodes"]) == 13 and all(sum(n["attribute"]) <= 1 and len(n["attribute"]) == 3 and len(n["splits"]) == 2 and len(n["frequencies"]) == 2 for n in x["nodes"]) for x in documents)
    again = files.read_forest(spark, path)
    assert again.config == config and again.columns == forest.columns
    line = lambda x: (x.tree, x.node, x.layer, x.slot, tuple(x.freqs), x.classifies, x.attr)
    assert sorted(map(line, again.nodes.collect()), key=str) == sorted(map(line, forest.nodes.collect()), key=str)
    for soft in (False, True):
        assert sorted(trees.votes(df, again, "id", soft=soft).collect()) == sorted(trees.votes(df, forest, "id", soft=soft).collect())
    files.write_forest(trees.Forest(forest.nodes.limit(0), forest.cuts.limit(0), forest.columns, config), f"{tmp_path}/none")
    with pytest.raises(ValueError):
        files.read_forest(spark, f"{tmp_path}/none")
