"""Classifiers and rules against plain loops that take nothing from them but their parameters."""

import collections
import math
import re
import struct
import zlib

import pytest

from torvane.llm import langid, resample, rules

SF = "/root/testdata/sf0.001"
WORD = (1 << 64) - 1
EXTRA = "doc_id long, text string, lang string, source string, key long, n long, kept string, label string, good string, score string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 20000), (5, "Ünï çødé 漢字 !!"), (6, "a b c d e " * 4000), (7, "same text here"), (7, "same text here"), (None, "no id"), (8, "1 2 3"), (9, "\n\n*|<>\nA b\nA b\n")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, "x", "y", "z", "q") for i, t, lang in rows], EXTRA)


def documents(spark):
    return [(1000 + r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def mixed(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & WORD
    return x ^ (x >> 32)


def word_hash(data: bytes) -> int:
    return mixed(sum((mixed((c + 1) * 0x9E3779B97F4A7C15 & WORD) | 1) * pow(0x9E3779B185EBCA87, i, 1 << 64) for i, c in enumerate(data)) & WORD)


def ordered(x: float) -> int:
    (bits,) = struct.unpack("<q", struct.pack("<d", x + 0.0))
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def bucketed(text, known: dict) -> collections.Counter:
    """Hashed runs of letters and digits, and of marks, one by one and in pairs."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())
    for x in set(tokens) - set(known):
        known[x] = word_hash(x)
    h = [known[x] for x in tokens]
    pairs = [mixed((x + y * 0xC2B2AE3D27D4EB4F + 2) & WORD) for x, y in zip(h, h[1:])]
    return collections.Counter(x >> 48 for x in [*h, *pairs])


@pytest.mark.parametrize("share", [None, 0.3])
def test_importance_weights_by_brute_force(spark, share):
    own = documents(spark)
    rows = [(i, t, "en") for i, t in ODD] + own
    marks = {r.doc_id + 1000: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    labels = [(i, *v) for i, v in marks.items()] + [(own[0][0], 0, 0), (own[0][0], 1, 0), (None, 1, 0), (6, None, 0), (7, 0, 0)]
    got = resample.resample(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality long, toxic long"), share=share).collect()
    told = collections.defaultdict(list)
    for i, quality, toxic in labels:
        if i is not None and quality is not None:
            told[i].append(quality == 1 and not toxic)
    good = {i: all(v) for i, v in told.items()}
    known, counts, raw, target = {}, [], collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        counts.append(bucketed(t, known))
        raw.update(counts[-1])
        if good.get(i):
            target.update(counts[-1])
    cells = 1 << resample.BITS
    shift = math.log(sum(raw.values()) + 0.5 * cells) - math.log(sum(target.values()) + 0.5 * cells)
    sums = {b: math.log(target[b] + 0.5) - math.log(raw[b] + 0.5) + shift for b in raw}
    weight = [sum(n * sums[b] for b, n in c.items()) for c in counts]
    noise = lambda i: -math.log(-math.log(((mixed((-1 if i is None else i) & WORD ^ (7 * 0x9E3779B97F4A7C15 & WORD)) >> 11) + 0.5) / 2.0**53))
    want = collections.Counter((i, sum(c.values()), round(w, 5), round(w + noise(i), 5)) for (i, _, _), c, w in zip(rows, counts, weight))
    assert collections.Counter((r.doc_id, r.n_features, round(r.log_weight, 5), round(r.key, 5)) for r in got).keys() == want.keys() and len(got) == len(rows)
    if share is None:  # the middle of the first gap between cells of labelled weights that tells most labels right
        held = sorted((ordered(r.log_weight) >> 46, good[r.doc_id]) for r in got if r.doc_id in good)
        at = sorted({c for c, _ in held})
        best, found = resample.GOOD_COUNTS * sum(g for _, g in held), at[:1]
        for low, high in zip(at, at[1:]):
            right = sum(resample.GOOD_COUNTS if g else 0 for c, g in held if c > low) + sum(not g for c, g in held if c <= low)
            if right > best:
                best, found = right, [low, high]
        k = sum(ordered(r.log_weight) >= (sum(found) // len(found)) << 46 for r in got)
        assert 0 < k < len(rows)
    else:
        k = round(share * len(rows))
    last = sorted((r.key for r in got), reverse=True)[k - 1]
    assert all(r.kept == (r.key >= last) for r in got)


def test_rows_tied_with_the_last_drawn_stay(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long")
    got = resample.resample(frame(spark, [(1, "a b", "x")] * 5), labels, share=0.4).collect()
    assert len(got) == 5 and all(r.kept for r in got)


def grams(text):
    out, c = [], "".join(x if x.isalpha() else " " for x in text.lower())
    c = re.sub(" +", " ", c)
    for n in (1, 2, 3):
        for s in range(len(c) - n + 1):
            code = 0
            for x in c[s : s + n]:
                code = code << 21 | ord(x)
            out.append(mixed((code + n * 0x9E3779B97F4A7C15) & WORD) >> 48)
    return out


def test_language_posteriors_by_brute_force(spark):
    rows = [(i, t, lang) for (i, t), lang in zip(ODD, [None, "en", "de", "de", "zh", "en", "en", None, "fr", "fr", "fr"])] + [(i, (t or "")[:400], lang) for i, t, lang in documents(spark)[:150]]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t, lang in rows:
        if lang is not None and not held(i):
            counts[lang].update(grams(t or ""))
            docs[lang] += 1
    total = {k: sum(counts[k].values()) for k in docs}
    got, at = langid.identify(frame(spark, rows)).collect(), {}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        g = grams(t or "")
        logs = {k: math.log(docs[k] / sum(docs.values())) + sum(math.log((counts[k][b] + 0.5) / (total[k] + 0.5 * (1 << langid.BITS))) for b in g) for k in sorted(docs)}
        at[i] = (t, logs)
    for r in got:
        t, logs = at[r.doc_id]
        assert r.held_out == held(r.doc_id)
        if not any(x.isalpha() for x in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(logs, key=logs.get)
        share = 1 / sum(math.exp(min(x - logs[best], 0)) for x in logs.values())
        assert r.lang_pred == best, (r.doc_id, logs)
        assert r.score == pytest.approx(share, abs=2e-3)


def test_tied_languages_go_to_the_first_by_code_point(spark):
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    rows = [(i, "one and the same", lang) for i, lang in zip(ids, ["é", "b", "Z", "é", "b", "Z"])]
    for r in langid.identify(frame(spark, rows)).collect():
        assert r.lang_pred == "Z" and r.score == pytest.approx(1 / 3)


def votes(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = collections.Counter(windows)
    n, chars, dup = len(w), sum(map(len, w)), len(lines) - len(set(lines))
    symbols, marks, upper = len(re.findall(r"[#*$%&|<>]", text)), len(re.findall(r"[!?]", text)), sum(c.isupper() for c in text)
    repeat = len({p for i, x in enumerate(windows) if times[x] > 1 for p in range(i, i + 5)})
    each = [
        (n < 10, n >= 20), (chars < 2 * n or chars > 14 * n, 3 * n <= chars <= 10 * n), (10 * symbols > n, 50 * symbols <= n), (10 * upper > 3 * chars, 100 * upper <= 15 * chars),
        (5 * marks > n, 25 * marks <= n), (2 * dup > len(lines), 20 * dup <= len(lines)), (100 * repeat > 20 * n, 100 * repeat <= 5 * n),
    ]
    return tuple(-1 if bad else int(good) for bad, good in each), n < 10 or 100 * repeat > 20 * n


def test_quality_is_the_posterior_of_its_votes(spark):
    """EM once more over the votes of all rows one by one: expectations and maximisations as sums over documents."""
    rows = [*((i, t, "en") for i, t in ODD), *documents(spark)]
    cast = {t: votes(t) for _, t, _ in rows}
    rules_n = 7
    start = [[0.03] * rules_n] + [[0.95 if j == k else 0.03 for j in range(rules_n)] for k in range(rules_n)]
    first = [0.8] + [0.2 / rules_n] * rules_n
    shares, table = list(first), [list(x) for x in start]

    def posterior(v):
        p = [s * math.prod(b if x == -1 else 1 - b for b, x in zip(own, v) if x) for s, own in zip(shares, table)]
        return [x / sum(p) for x in p]

    kinds = collections.Counter(cast[t][0] for _, t, _ in rows)
    for _ in range(40):
        ps = [(v, n, posterior(v)) for v, n in kinds.items()]
        shares = [(sum(n * p[k] for _, n, p in ps) + 20 * first[k]) / (len(rows) + 20) for k in range(8)]
        table = [[(sum(n * p[k] for v, n, p in ps if v[j] == -1) + 20 * start[k][j]) / (sum(n * p[k] for v, n, p in ps if v[j]) + 20) for j in range(rules_n)] for k in range(8)]
    texts = {i: t for i, t, _ in rows}
    got = rules.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows) and len({r.kept for r in got}) == 2
    for r in got:
        v, failed = cast[texts[r.doc_id]]
        good = posterior(v)[0]
        assert r.quality == pytest.approx(good, rel=1e-6, abs=1e-12)
        assert r.base_failed == failed and (abs(good - 0.5) < 1e-9 or r.kept == (good >= 0.5 and not failed))
