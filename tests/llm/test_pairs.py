"""Suffix dedup, Jaccard join and decontamination against brute force, on hard small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from torvane.llm import jaccard, suffixes, winnow

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, key string, node long, `row` long, h long, n long, n_chars long"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 6)))
    base = [[word() for _ in range(r.choice([3, 8, 60, 120, 200]))] for _ in range(14)]
    texts = [" ".join(b) for b in base]
    passage = " ".join(word() for _ in range(70))
    for i in range(12):  # one passage in many surroundings
        texts.append(f"{' '.join(word() for _ in range(30))} {passage} {' '.join(word() for _ in range(30))}")
    for b in base:  # near copies of one another
        for k in (1, 3, 9):
            c = list(b)
            for _ in range(k):
                c[r.randrange(len(c))] = word()
            texts.append("\n".join(c).upper())
    texts += [texts[0], texts[0], "", None, " \t\n", "one", "one", "und " * 300, "x" * 5000, " ".join(word() for _ in range(3000))]
    out = list(enumerate(texts))
    r.shuffle(out)
    return out


def shingles(text, k=5):
    w = spaced(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("chunk", [2048, 3])
def test_components_are_the_brute_force_ones(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    sets, head = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert len({c for _, c in got.values()}) < len(rows) - 5


def edited(r, words, cut, more):
    """The words without some, and with new ones among them."""
    words = list(words)
    for _ in range(cut):
        del words[r.randrange(len(words))]
    for _ in range(more):
        words.insert(r.randrange(len(words)), f"n{r.random()}")
    return words


@pytest.mark.parametrize("size", [64, 128, 256, 512])
def test_signatures_of_two_widths_drop_no_link(size):
    r = np.random.default_rng(size)
    sets = []
    for _ in range(300):  # pairs just above the threshold, on either side of the width's edge
        n = int(r.integers(size * 9 // 10, size + 1))
        s = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        more = r.integers(0, 1 << 63, size * 5 // 4, dtype=np.uint64)
        sets += [np.unique(s), np.unique(np.append(s, more[: n // 4]))]
    n, sig = np.array([len(s) for s in sets]), [jaccard.signature(s) for s in sets]
    pairs = [(i, i + 1) for i in range(0, len(sets), 2) if 100 * n[i] >= 80 * n[i + 1] and len(sig[i]) != len(sig[i + 1])]
    assert len(pairs) > 50
    a, b = np.array(pairs).T
    block = {"node": np.arange(len(sets)), "n": n, "rest": n, "sig": np.array([*sig, None], object)[:-1], "width": np.array([len(s) for s in sig])}
    both = np.stack([a, b], 1).ravel()
    few = {k: v[both] for k, v in block.items()} | {"comp": both, "side": 0 * both + 1}
    assert {*jaccard._few(few, np.arange(0, len(both), 2), np.full(len(pairs), 2), 80, 100)} == set(pairs)
    for side in (np.ones(len(sets), np.int64), np.arange(len(sets)) % 2):
        label, _ = jaccard.joined_in_block(block | {"comp": block["node"], "side": side}, 80, 100)
        assert (label[a] == label[b]).all()
        label, _ = jaccard.linked_in_cluster(sets, block["node"], side, 80, 100)
        same = {(i, i + 1) for i in range(0, len(sets), 2) if 100 * n[i] >= 80 * n[i + 1]}
        assert {(i, j) for j, i in enumerate(label.tolist()) if i != j} == same


@pytest.mark.parametrize("widest", [8192, 256])
def test_links_in_a_cluster_are_the_brute_force_ones(widest, monkeypatch):
    monkeypatch.setattr(jaccard, "WIDEST", widest)
    r = random.Random(widest)
    base = [r.getrandbits(64) for _ in range(90)]
    sets = []
    for _ in range(300):
        own = [*r.sample(base, 90 - r.randrange(14)), *(r.getrandbits(64) for _ in range(r.randrange(14)))]
        sets.append(np.unique(np.array(own, np.uint64)))
    head = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and head[a] != head[b]:
                x, y = sorted((head[a], head[b]))
                head = [x if h == y else h for h in head]
    label, first = jaccard.linked_in_cluster(sets, np.arange(len(sets)), np.ones(len(sets), np.int64), 80, 100)
    assert label.tolist() == head and first.tolist() == list(range(len(sets)))


def test_components_at_the_edges_of_widths(spark):
    r, texts = random.Random(11), []
    for size in (64, 128, 256, 512):
        for _ in range(12):
            words = [f"w{r.random()}" for _ in range(size + 4 + r.randrange(-2, 3))]
            few = size // 60
            texts += [words, edited(r, words, r.randrange(few + 1), few), edited(r, words, few, r.randrange(few + 1)), edited(r, words, 0, 2 * few)]
            tail = [f"t{r.random()}" for _ in range(size // 4 - 1)]
            texts.append(words + tail)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets, head = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(sets)):
        for b in range(a // 5 * 5, a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and head[a] != head[b]:
                x, y = sorted((head[a], head[b]))
                head = [x if h == y else h for h in head]
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(frame(spark, rows)).collect()}
    assert got == dict(enumerate(head))


@pytest.mark.parametrize("chunk, held", [(2048, 1 << 15), (16, 1 << 15), (16, 8)])
def test_components_of_one_large_group(spark, chunk, held, monkeypatch):
    """Copies with up to four changed words each: some are linked, most pairs lie just below the threshold."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "HELD", held)
    r = random.Random(4)
    base = [f"w{r.random()}" for _ in range(150)]
    texts = []
    for _ in range(260):
        words = list(base)
        for _ in range(r.choice([1, 2, 3, 3, 4])):
            words[r.randrange(len(words))] = f"n{r.random()}"
        texts.append(" ".join(words))
    sets, head = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(sets)):
        for a in range(b):
            if head[a] != head[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((head[a], head[b]))
                head = [x if h == y else h for h in head]
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(head)) and 5 < len(set(head)) < 200


def test_components_of_nulls_repeats_and_nothing(spark):
    same = "a b c d e f g h"
    got = jaccard.similar_components(frame(spark, [(5, same), (5, same), (None, same), (9, same), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 4, 5), (5, 4, 5), (5, 4, 5), (9, 4, 5)]
    assert jaccard.similar_components(frame(spark, [])).collect() == []


@pytest.mark.parametrize("size", [1 << 17, 5])
def test_repeated_spans_are_the_brute_force_ones(spark, rows, size, monkeypatch):
    monkeypatch.setattr(suffixes, "ROWS", size)
    seen, want = set(), collections.defaultdict(set)
    for i, t in sorted(rows):
        w = spaced(t)
        for s in range(len(w) - 49):
            if tuple(w[s : s + 50]) in seen:
                want[i] |= set(range(s, s + 50))
            seen.add(tuple(w[s : s + 50]))
    assert covered(suffixes.repeated_spans(frame(spark, rows))) == want and len(want) > 10


def covered(spans):
    got = collections.defaultdict(set)
    for r in spans.collect():
        assert r.first_doc_id <= r.doc_id and not got[r.doc_id] & set(range(r.start_word, r.end_word))
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    return got


@pytest.mark.parametrize("size", [1 << 17, 60])
def test_repeats_on_both_sides_at_once(spark, size, monkeypatch):
    """40 words in very many texts, with ten words of two kinds on either side."""
    monkeypatch.setattr(suffixes, "ROWS", size)
    r = random.Random(7)
    shared = [f"w{r.random()}" for _ in range(40)]
    rows = [(i, " ".join([*r.choices("ab", k=10), *shared, *r.choices("cd", k=10), f"end{i}"])) for i in range(400)]
    rows += [(500 + i, " ".join([f"x{r.random()}" for _ in range(10)] + shared + [f"{i}"] + [f"y{r.random()}" for _ in range(15)])) for i in range(600)]
    seen, want = set(), collections.defaultdict(set)
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - 49):
            if tuple(w[s : s + 50]) in seen:
                want[i] |= set(range(s, s + 50))
        seen |= {tuple(w[s : s + 50]) for s in range(len(w) - 49)}
    assert covered(suffixes.repeated_spans(frame(spark, rows))) == want and 200 < len(want) < 400


def test_texts_without_repeats(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, f"{long}\nend one"), (2, f"begin two {long} end two"), (3, long), (4, None), (5, ""), (None, f"{long} null"), (7, "short"), (7, "short")]
    df = frame(spark, rows)
    out = suffixes.without_repeats(df)
    assert out.dtypes == df.dtypes
    got = sorted((r.doc_id or -1, r.text, r.n_chars) for r in out.collect() if r.text is not None)
    # "end" follows the passage in the first text as well
    assert got == [(-1, "null", 4), (1, f"{long}\nend one", len(long) + 8), (2, "begin two two", 13), (5, "", 0), (7, "short", 5), (7, "short", 5)]
    assert out.filter("doc_id = 4").count() == 1 and out.filter("doc_id = 3").count() == 0
    assert suffixes.without_repeats(frame(spark, [])).collect() == []


def judged(rows, items, span=10):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = alnum(t)
        n = min(len(w), span)
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(item)
    out = []
    for i, t in rows:
        w, hit, named = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    named |= {str(y) for y in windows[x] if y is not None}
        out.append((i or -1, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination_is_the_brute_force_one(spark, rows):
    texts = dict(rows)
    items = [(1, " ".join(alnum(texts[20])[3:18])), (12, " ".join(alnum(texts[20])[10:25])), (3, "one"), (4, None), (5, "!?"), (None, " ".join(alnum(texts[30])[:11])), (6, " ".join(alnum(texts[5])[2:11])), (6, "One")]
    docs = [*rows, (None, texts[20]), (20, texts[20])]
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in winnow.contamination(frame(spark, docs), b).collect())
    assert got == judged(docs, items) and sum(x[-1] for x in got) > 5
    kept = winnow.decontaminated(frame(spark, docs), b)
    assert kept.columns == frame(spark, docs).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(x[0] for x in got if not x[-1])
    assert not winnow.contamination(frame(spark, docs), b.limit(0)).filter("contaminated").count()
    assert winnow.contamination(frame(spark, []), b).collect() == []


def test_links_through_rows_without_an_id(spark):
    """Two documents that only a row without an id links are one component, and so are those of two such rows."""
    w = [f"w{i}" for i in range(100)]
    few = [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(w[:88])), (2, " ".join(w[12:])), (None, " ".join(w)), (7, " ".join(few[:88])), (None, " ".join(few)), (None, " ".join(few[12:])), (None, "alone in the table here")]
    got = jaccard.similar_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 1, -1), (-1, 84, 7), (-1, 96, 1), (-1, 96, 7), (1, 84, 1), (2, 84, 1), (7, 84, 7)]


@pytest.mark.parametrize("num", [30, 40, 80])
def test_low_thresholds_compare_all_widths(spark, num):
    """Sets within others of up to three times their size: bitmaps that differ by more than a factor of two are compared in large blocks as well."""
    r = random.Random(num)
    texts = []
    for _ in range(6):
        words = [f"w{r.random()}" for _ in range(420)]
        texts += [" ".join(words[: 4 + int(416 * r.uniform(0.2, 1))]) for _ in range(14)]
    sets, head = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(sets)):
        for a in range(b):
            if head[a] != head[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((head[a], head[b]))
                head = [x if h == y else h for h in head]
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(frame(spark, list(enumerate(texts))), num=num).collect()}
    assert got == dict(enumerate(head))


def test_blocks_of_nested_sets_at_a_low_threshold():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(150):
        s = np.unique(r.integers(0, 1 << 62, 150, dtype=np.uint64))
        sets += [s[:64], s]
    n, sig = np.array([len(s) for s in sets]), [jaccard.signature(s) for s in sets]
    assert {len(b) // len(a) for a, b in zip(sig[::2], sig[1::2], strict=True)} == {4}
    block = {"node": np.arange(len(sets)), "n": n, "rest": n, "sig": np.array([*sig, None], object)[:-1], "width": np.array([len(s) for s in sig]), "comp": np.arange(len(sets)), "side": np.ones(len(sets), np.int64)}
    label, _ = jaccard.joined_in_block(block, 40, 100)
    assert (label[::2] == label[1::2]).all()
