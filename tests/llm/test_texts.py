"""Operators on single texts: chats, license scans, quality rules, languages, language models and resampling."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from torvane.llm import chat, langid, license, lm, queries, resample, rules

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENS = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 20000), (5, "Ünï çødé 漢字 !!"), (6, "a b c d e " * 4000), (7, "same text here"), (7, "same text here"), (None, "no id"), (9, "1 2 3"), (10, "\n\n*|<>\nA b\nA b\n")]
EXTRA = "doc_id long, text string, lang string, source string, key long, n long, kept string, label string, w string, score string"


def frame(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, "x", "y", "z", "q") for i, t in rows], EXTRA)


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_escapes_are_reversible():
    for t in ("<|im_end|>", r"<\|im_end|>", r"<\\|", "<|<|", "\\", "a\\nb\n<|x", "<", "|"):
        assert "<|" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t
        assert "\n" not in chat.escape_role(t) and chat.unescape_role(chat.escape_role(t)) == t


def test_chats_read_back(spark):
    rows = [(1, 1, "assistant", "hi <|im_end|>"), (1, 0, "user", "<|im_start|>user\nok"), (1, 2, "assistant", None), (2, 0, None, ""), (2, 0, "odd\nrole<|", "é漢"), (None, None, "assistant", "lost"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (4, 0, "user", "x" * 30000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, start long")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(df, **TOKENS), **TOKENS).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        learnt = "".join(x for _, r, x in own if r == "assistant")
        assert out[conv].n_turns == len(own)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert out[conv].formatted_chars == sum(12 + len(chat.escape_role(r)) + 1 + len(chat.escape(x)) + 11 for _, r, x in own)
    assert chat.read_back(chat.format_chats(df.limit(0), **TOKENS), **TOKENS).collect() == []


def test_starts_are_prefix_sums(spark):
    rows = chat.format_chats(read(spark, "conversations"), **TOKENS).collect()
    at = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn_no)):
        assert r.start == at[r.conv_id] and len(r.ids) == len(r["mask"])
        at[r.conv_id] += len(r.ids)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def test_license_scan_is_the_brute_force_one(spark):
    texts = [(21, "The MIT License, mit-license mit license"), (22, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"), (23, "licensed under the\nApache License"), (24, "GNU General Public\nLicense version 3"), (25, "A\nLicensed under CC BY-NC 4.0.\nB"), (26, "mitlicense licence MIT  LICENSE"), (27, "MIT License" * 3), (28, "this program is free software you can\nredistribute it and or modify it under the terms\nof the gnu general public license")]
    rows = ODD + texts
    for r in license.scan(frame(spark, rows)).collect():
        for t in {t for i, t in rows if i == r.doc_id}:
            w, places, base = words_of(t), [], set()
            for p, label in license.PHRASES.items():
                p = p.split()
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        places.append(s)
                        base.add(label)
            held, share = set(), 0.0
            for block in [*(t or "").split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", t or "")]:
                for label, notice in license.NOTICES:
                    own = set(words_of(notice))
                    got = len(own & set(words_of(block))) / len(own)
                    if got >= 0.8:
                        held.add(label)
                        share = max(share, got)
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None)), t
            assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | held))
            assert r.score == pytest.approx(1.0 if base else share)
    assert license.scan(frame(spark, [])).collect() == []


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(windows)
    repeat = {p for i, x in enumerate(windows) if n[x] > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


def test_quality_measures_are_the_brute_force_ones(spark):
    rows = [*ODD, *((100 + r.doc_id, r.text) for r in read(spark, "documents").collect())]
    got = rules.judge(frame(spark, rows))
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        (t,) = texts[r.doc_id]
        m = brute_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and not (r.kept and r.base_failed)
    assert rules.judge(frame(spark, [])).collect() == []


def test_em_finds_faults_that_no_two_rules_share():
    r = np.random.default_rng(1)
    votes, bad = collections.Counter(), collections.Counter()
    for _ in range(6000):
        kind = int(r.choice(4, p=[0.85, 0.06, 0.06, 0.03]))  # good, or the fault of one of three rules
        v = tuple(int(r.choice([-1, 0, 1], p=[0.95, 0.05, 0] if kind == k + 1 else [0.01, 0.2, 0.79])) for k in range(3))
        votes[v] += 1
        bad[v] += kind > 0
    shares, table = rules.fit(sorted(votes.items()), 3)
    assert shares[0] == pytest.approx(0.85, abs=0.04)
    assert all(table[0][j] < 0.04 and table[j + 1][j] > 0.85 for j in range(3))
    for v, n in votes.items():
        if n > 100:
            assert (rules.posterior(shares, table, v) < 0.5) == (bad[v] > n / 2)


def test_rules_keep_good_labelled_rows(spark):
    judged = rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).drop("quality").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    share = {r.quality: r.s for r in judged.filter("n_words >= 10").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.97 and share[0] < 0.6  # some faults are too rare here to tell


def test_languages(spark):
    out = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = out.filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.collect())
    assert sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held)
    odd = {r.doc_id: r for r in langid.identify(frame(spark, ODD)).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and odd[1].score == 0 and 0 < odd[5].score <= 1
    assert {r.lang_pred for r in langid.identify(frame(spark, ODD, None)).collect()} == {"und"}
    assert langid.identify(frame(spark, [])).collect() == []


@pytest.mark.parametrize("heavy", [1 << 18, 1100])
def test_base_scores_are_exact(spark, heavy, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", heavy)
    rows = [*ODD, *((100 + r.doc_id, r.text) for r in read(spark, "documents").collect())]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)), None]
    c = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    total, kinds = sum(c.values()), len(c)
    texts = dict(rows)
    out = lm.score(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), rel=1e-9)
        assert -math.inf < r.score < 0
    assert lm.score(frame(spark, [])).collect() == []


def test_network_sums_to_one_and_gradients_are_right():
    r = np.random.default_rng(2)
    net = lm.Network.start(r.integers(1, 100, lm.VOCABULARY), 1)
    h = r.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = net.log_probability(np.repeat(h, lm.VOCABULARY, 0), np.arange(lm.VOCABULARY))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)
    x, y = r.integers(0, 60, (3, 5)), r.integers(0, 60, (3, 5))
    start = np.zeros((3, lm.HIDDEN), np.float32)
    g, _, loss = net.gradient(x, y, start)
    for at in np.argsort(-np.abs(g))[[0, 5, 40, 200]]:
        both = []
        for e in (1e-2, -1e-2):
            moved = lm.Network(net.flat.copy())
            moved.flat[at] += e
            both.append(moved.gradient(x, y, start)[2] / y.size)
        assert (both[0] - both[1]) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-3)


def test_training_learns_and_state_is_carried():
    symbols = np.array([2, 3, 4, 5, 6, 7, 1] * 3000, np.int32)
    counts = np.bincount(symbols, minlength=lm.VOCABULARY)
    net = lm.Network.start(counts, 1)
    adam = lm._Adam(net.SIZE)
    first = lm.train_on(net, symbols, adam)
    assert lm.train_on(net, symbols, adam) < 0.5 * first
    bounds = np.array([0, 7, 49, 50])
    ids = np.concatenate([symbols[:49], [1]]).astype(np.int32)
    whole = lm.document_scores(net, ids, bounds)
    for i in range(3):
        h, x, total = np.zeros((1, lm.HIDDEN), np.float32), np.array([lm.END]), 0.0
        for y in ids[bounds[i] : bounds[i + 1]]:
            h = net.step(x, h)[0]
            total += net.log_probability(h, np.array([y]))[0]
            x = np.array([y])
        assert whole[i] == pytest.approx(total, rel=1e-3)


def test_table_finds_its_keys():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1))
    table = lm.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()


def test_resampling(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = resample.resample(docs, labels).cache()
    both = out.join(labels.filter("toxic = 0"), "doc_id")
    share = {r.quality: r.s for r in both.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.97 and share[0] < 0.2
    assert sorted(r.doc_id for r in resample.drawn(docs, labels).select("doc_id").collect()) == sorted(r.doc_id for r in out.filter("kept").collect())
    half = resample.resample(docs, labels, share=0.5).collect()
    top = sorted((r.key for r in half), reverse=True)[:500]
    assert {r.key for r in half if r.kept} == set(top)
    odd = resample.resample(frame(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and len({r.key for r in odd if r.doc_id == 7}) == 1
    assert all(r.kept for r in resample.resample(frame(spark, ODD), labels.limit(0)).collect())
    assert resample.drawn(frame(spark, []), labels).collect() == [] == resample.resample(frame(spark, []), labels).collect()


def test_kth_largest(spark):
    values = [5, -3, 7, 7, 0, -(1 << 62), 1 << 62, 12345678901]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        assert resample.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_largest(df, "v", 0) is None and resample.kth_largest(df, "v", 9) is None


@pytest.mark.parametrize("heavy", [1 << 18, 1100])
def test_scores_are_those_of_the_network(spark, heavy, monkeypatch):
    """The whole of score() once more, by plain loops: ranks, rounds, shards, means, and each text symbol by symbol."""
    monkeypatch.setattr(lm, "HEAVY", heavy)
    monkeypatch.setattr(lm, "SHARD", 4000)
    rows = [*ODD, *((100 + r.doc_id, r.text) for r in read(spark, "documents").limit(60).collect())]
    df = frame(spark, rows)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)), None]
    learnt = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(x for _, t in learnt for x in tokens(t))
    place = {lm.ENDING: lm.END}
    hashed = {x: int(h) for x in c if x is not None for _, hs, _ in lm._tokens(pa.array([x])) for h in hs[:1]}
    ranked = sorted(hashed, key=lambda x: (-c[x], hashed[x]))
    place = {None: lm.END} | {x: 2 + k for k, x in enumerate(ranked[: lm.VOCABULARY - 2])}
    counts = np.zeros(lm.VOCABULARY)
    for x, k in place.items():
        counts[k] = c[x]
    total, rest = sum(c.values()), [x for x in c if x not in place]
    left = counts[lm.OTHER] = sum(c[x] for x in rest)
    net = lm.Network.start(counts, 5)
    keys = {(r.doc_id, r.text): r.key for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(5)).alias("key")).collect()}
    shards = -(-total // (4000 * lm.ROUNDS))
    assert shards > 2
    for k in range(lm.ROUNDS):
        ends = []
        for shard in range(shards):
            own = sorted((keys[i, t], [place.get(x, lm.OTHER) for x in tokens(t)]) for i, t in learnt if keys[i, t] % lm.ROUNDS == k and (keys[i, t] >> 8) % shards == shard)
            if own:
                one = lm.Network(net.flat.copy())
                lm.train_on(one, np.concatenate([x for _, x in own]).astype(np.int32), lm._Adam(lm.Network.SIZE))
                ends.append(one.flat.astype(np.float64))
        net = lm.Network(np.mean(ends, 0))
    texts = dict(rows)
    got = lm.score(df).collect()
    for r in got:
        h, x, want = np.zeros((1, lm.HIDDEN), np.float32), np.array([lm.END]), 0.0
        for w in tokens(texts[r.doc_id])[:3000]:
            y = place.get(w, lm.OTHER)
            h = net.step(x, h)[0]
            want += net.log_probability(h, np.array([y]))[0] / math.log(10)
            if y == lm.OTHER:
                want += math.log10((c[w] + 0.1) / (left + 0.1 * (len(rest) + 1)))
            x = np.array([y])
        if r.n_tokens <= 3000:
            assert r.score == pytest.approx(want, rel=1e-3)
    again = {(r.doc_id, r.score) for r in lm.score(df.repartition(7)).collect()}
    assert all(any(i == r.doc_id and x == pytest.approx(r.score, rel=1e-5) for i, x in again) for r in got)


def test_every_symbol_is_learnt_from(monkeypatch):
    seen, gradient = [], lm.Network.gradient
    monkeypatch.setattr(lm.Network, "gradient", lambda self, x, y, h: seen.append(y.size) or gradient(self, x, y, h))
    for n in (1, 40, 1000, 5003):
        seen.clear()
        net = lm.Network.start(np.ones(lm.VOCABULARY), 1)
        lm.train_on(net, np.arange(n) % 9, lm._Adam(net.SIZE))
        assert sum(seen) == n


def test_gradient_is_that_of_the_loss_and_takes_classes_together(monkeypatch):
    rng = np.random.default_rng(3)
    net = lm.Network.start(np.ones(lm.VOCABULARY), 2)
    x, y = (rng.integers(0, lm.VOCABULARY, (9, 5)) for _ in range(2))
    x[2, 3] = x[4, 0] = lm.END
    h = rng.normal(0, 0.5, (9, lm.HIDDEN)).astype(np.float32)
    calls, exp = [], np.exp
    with monkeypatch.context() as m:
        m.setattr(np, "exp", lambda *a, **b: calls.append(1) or exp(*a, **b))
        g, _, loss = net.gradient(x, y, h)
    assert len(calls) == 2  # one softmax of classes, one of words, however many classes occur
    grad = lm.Network(g)

    def total(other):
        state, out = h, 0.0
        for t in range(x.shape[1]):
            state = other.step(x[:, t], state * (x[:, t] != lm.END)[:, None])[0]
            out -= float(other.log_probability(state, y[:, t]).astype(np.float64).sum())
        return out

    assert loss == pytest.approx(total(net), rel=1e-4)
    places = {"E": (int(x[0, 1]), 5), "U": (3, 40), "C": (2, 7), "c": (4,), "W": (int(y[0, 1]), 6), "w": (int(y[1, 2]),)}
    for name, at in [*places.items(), ("E", (int(x[5, 4]), 20)), ("E", (int(x[1, 2]), 44)), ("U", (9, 2)), ("U", (1, 20))]:
        ends = []
        for d in (0.02, -0.02):
            other = lm.Network(net.flat.copy())
            getattr(other, name)[at] += d
            ends.append(total(other))
        assert getattr(grad, name)[at] * x.size == pytest.approx((ends[0] - ends[1]) / 0.04, rel=0.02, abs=5e-3), (name, at)
