import collections
import random
import re

import pytest

from torvane.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2.0) for i, t, s in rows], "doc_id long, text string, source string, chunk string, key long, p double")


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("chunk", [4096, 4])
def test_mix_meets_its_targets(spark, chunk, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 200])), r.choice(["a", "a", "a", "b", "Ä", "z", None])) for i in range(400)] + [(900, None, "a"), (None, "x y", "b"), (901, "x y z", "b"), (901, "x y z", "b")]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"\S+", t or ""))
    want = brute_targets(sizes)
    out = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    taken, part = collections.Counter(), collections.Counter()
    for x in out:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
        part[x.source] += x.size > 0 and x.taken % x.size > 0
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 and part[s] <= 1


def test_expected_copies_stay():
    r = random.Random(1)
    n, sums = 20000, [0.0, 0.0]
    for _ in range(n):
        x, y = mixing.transfer(0.3 * 7, 7, 0.6 * 2, 2, r.random())
        assert x + y == pytest.approx(0.3 * 7 + 0.6 * 2) and (x in (0, 7) or y in (0, 2))
        sums[0] += x / n
        sums[1] += y / n
    assert sums[0] == pytest.approx(2.1, rel=0.03) and sums[1] == pytest.approx(1.2, rel=0.03)


def test_nothing_to_mix(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    (x,) = mixing.mix(frame(spark, [(1, None, "a")])).collect()
    assert (x.size, x.source_size, x.target, x.taken) == (0, 0, 0.0, 0)
