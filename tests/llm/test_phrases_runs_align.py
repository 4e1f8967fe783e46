"""Substring dedup by automata, periodic runs and alignment of tokenizers, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from torvane.llm import align, phrases, queries, runs

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, key long, h long, start long, words string, kept string, runs string, a string, cuts string, pairs string, row long"
LONG = " ".join(f"w{i}" for i in range(20000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
HARD = [
    (None, f"no id {PASSAGE} end"), (1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, f"{LONG} end"), (6, f"one {PASSAGE} two"), (7, f"three {PASSAGE} four"), (7, f"three {PASSAGE} four"),
    (8, f"{PASSAGE} {PASSAGE}"), (9, "a b " * 3000), (10, "same " * 12), (11, "x" * 20000), (12, "Ünï çødé\x1c 漢字▁ !!"), (13, "漢字かな交じり文🙂🙂 <|endoftext|> <s> <0x41>"), (14, PASSAGE.upper()), (15, "tabs\tand\r\nlines;\r\n  blanks  "),
]


def hard(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", "y", "z", "q", "c", "p", 5) for i, t in HARD], EXTRA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def copies(rows, span):
    """(doc_id, n_words, n_removed, kept), by looking at every window."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        w = words(t)
        for s in range(len(w) - span + 1):
            first.setdefault(tuple(w[s : s + span]), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for s in range(len(w) - span + 1):
            if order(first[tuple(w[s : s + span])]) < order(i):
                gone |= set(range(s, s + span))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [1 << 15, 3, 1])
def test_copies_on_hard_rows(spark, rows):
    """With few rows a shard, all phrases with copies are among those that are dealt by document."""
    got = phrases.without_copies(hard(spark), span=50, rows=rows).collect()
    assert sorted(map(tuple, got), key=repr) == copies(HARD, 50)
    gone = collections.Counter()
    for r in phrases.located(hard(spark), span=50, rows=rows).collect():
        gone[r.doc_id] += r.end_word - r.start_word
    assert gone == collections.Counter({i: n for i, _, n, _ in copies(list(dict.fromkeys(HARD)), 50) if n})
    assert phrases.without_copies(hard(spark).limit(0)).collect() == [] and phrases.located(hard(spark).limit(0)).collect() == []


def test_copies_of_short_spans(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(f"v{x}" for x in rng.integers(0, 3, rng.integers(0, 60)))) for i in range(60)]
    got = phrases.without_copies(spark.createDataFrame(rows, "doc_id long, text string"), span=8, k=3).collect()
    assert sorted(map(tuple, got), key=repr) == copies(rows, 8)


def test_copies_of_documents(spark):
    want = [(i, n, gone, sha(kept)) for i, n, gone, kept in copies(documents(spark), 50)]
    assert sorted(map(tuple, queries.op12_substring_dedup(spark, SF).collect())) == sorted(want)


def test_automata_find_words_only():
    text = np.array([1, 256, 1, 256, 1, 7], "<u4").tobytes()
    find = phrases.automaton([np.array([256, 1], "<u4").tobytes(), np.array([1, 256], "<u4").tobytes()], [4, 5])
    at, value = phrases._occurrences(find, text, 2)
    assert sorted(zip(at.tolist(), value.tolist(), strict=True)) == [(0, 5), (1, 4), (2, 5), (3, 4)]


def brute_runs(w, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(w[i : i + length - d] == w[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = np.random.default_rng(2)
    for _ in range(150):
        docs = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 60))
            w = rng.integers(0, rng.integers(1, 5), n).tolist()
            if rng.random() < 0.5 and n > 4:
                p, a = int(rng.integers(1, n // 2 + 1)), int(rng.integers(0, n))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        x, y = [0], [0, 1]
        for _ in range(6):
            x, y = y, y + x
        docs.append(y)  # a Fibonacci word: squares of many lengths
        least = int(rng.integers(2, 13))
        doc, symbol = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.array(sum(docs, []), np.uint64)
        first = np.r_[0, np.cumsum([len(d) for d in docs])]
        want = [(int(first[i]) + s, n, q) for i, d in enumerate(docs) for s, n, q in brute_runs(d, least)]
        assert list(zip(*(v.tolist() for v in runs.runs(doc, symbol, least)), strict=True)) == want


def test_runs_of_documents(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    planted = 0
    for i, t in documents(spark):
        w = words(t)
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        if len(w) > 3000:
            continue
        found = brute_runs(w, 12)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        r = got[i]
        top = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    assert planted > 5


def test_runs_on_hard_rows(spark):
    got = collections.defaultdict(list)
    for r in runs.periodic_runs(hard(spark)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(HARD) and len(got[7]) == 2
    assert [tuple(x) for x in got[9][0].runs] == [(0, 6000, 2)] and got[9][0].collapsed == "a b"
    assert [tuple(x) for x in got[10][0].runs] == [(0, 12, 1)] and got[8][0].n_runs == 1 and got[8][0].collapsed == PASSAGE
    assert all(got[i][0].n_runs == 0 and got[i][0].collapsed == "" for i in (1, 2, 3)) and got[4][0].collapsed == LONG
    assert runs.digest(runs.periodic_runs(hard(spark).limit(0))).collect() == []


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


PATHS = {"path_a": public_tokenizers.path("byte_bpe_50k.json"), "pattern": public_tokenizers.PATTERN, "path_b": public_tokenizers.path("piece_bpe_32k.model")}


def alignment(rows, tokenizers):
    """doc_id and the columns of aligned(), token by token."""
    one, two = tokenizers
    letter = align.byte_decoder()
    name_a = {i: bytes(letter[c] for c in t) for t, i in one.get_vocab().items() if t != "<|endoftext|>"}
    name_b = {i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in range(two.get_piece_size())}
    made = []
    for i, t in rows:
        a = b = []
        if t:
            a, b = one.encode(f" {t}", add_special_tokens=False).ids, two.encode(t)
            if not b"".join(name_a[x] for x in a) == b"".join(name_b[x] for x in b) == f" {t}".encode():
                a = b = []
        ends_a, ends_b = (np.cumsum([len(name[x]) for x in ids], dtype=int).tolist() for name, ids in ((name_a, a), (name_b, b)))
        links, groups, x, y, left = [], [], 0, 0, ([], [])
        while x < len(a) and y < len(b):
            links.append((a[x], b[y]))
            p, q = ends_a[x], ends_b[y]
            if p <= q:
                left[0].append(str(a[x]))
                x += 1
            if q <= p:
                left[1].append(str(b[y]))
                y += 1
            if p == q:
                groups.append("|".join(map(",".join, left)))
                left = ([], [])
        made.append((i, a, b, links, groups))
    count = collections.Counter(p for m in made for p in set(m[3]))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(i, len(a), len(b), len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k), sha(";".join(g)) if g else "") for i, a, b, k, g in made]


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_alignment_on_hard_rows(spark, tokenizers, frequent):
    """Counts of pairs are joined in either way, whatever part of them is broadcast."""
    got = align.aligned(hard(spark), **PATHS, frequent=frequent).collect()
    want = alignment(HARD, tokenizers)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    zero = {i for i, *counts, _ in want if not any(counts)}
    assert {1, 2, 12} <= zero and zero < {i for i, _ in HARD}
    assert align.aligned(hard(spark).limit(0), **PATHS).collect() == []


def test_alignment_of_documents(spark, tokenizers):
    assert sorted(map(tuple, queries.op11_cross_tokenizer(spark, SF).collect())) == sorted(alignment(documents(spark), tokenizers))


def test_byte_level_ids_are_those_of_the_file(tokenizers):
    """Over all kinds of characters the merges by rank give what the tokenizers file does."""
    encode, _ = align.byte_level(PATHS["path_a"], PATHS["pattern"])
    texts = [" a{0}a1{0}1 {0}!{0} {0}\n{0}".format(chr(c)) for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert [encode(t) for t in texts] == [e.ids for e in tokenizers[0].encode_batch(texts, add_special_tokens=False)]


def test_links_and_digests_where_both_sides_go_on(spark):
    """In the first group each side has a token that ends inside of one of the other. Links take one function with a lambda over all tokens, the others see only tokens that end alone."""
    sides = {"a": ([1, 2, 3], [3, 6, 8], 10), "b": ([4, 5, 6, 7], [2, 4, 6, 8], 1)}
    row = [1]
    for ids, ends, times in sides.values():
        sizes = np.diff([0, *ends]).tolist()
        row += [ids, ends, [i for i, n in enumerate(sizes) for _ in range(n)], [(i << 7) + x * times for i, x in enumerate(ids)]]
    arrays = [T.StructField(c, T.ArrayType(T.LongType() if c.endswith("keys") else T.IntegerType(), False), False) for c in align.COLUMNS]
    tokens = spark.createDataFrame([row, [2] + [[]] * 8, row], T.StructType([T.StructField("doc_id", T.LongType()), *arrays]))
    made = align.links(tokens, 10, 10)
    got = made.select("doc_id", "open_a", "open_b", "pairs").collect()
    full = (1, [0], [0, 1], [14, 15, 25, 26, 37])
    assert [tuple(r) for r in got] == [full, (2, [], [], []), full]
    digests = align.digests(made.select("doc_id", "a", "b", "open_a", "open_b"), 10, 10).collect()
    assert [tuple(r) for r in digests] == [(1, sha("1,2|4,5,6;3|7")), (2, ""), (1, sha("1,2|4,5,6;3|7"))]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1 and plan.count("transform(") == plan.count("transform(only_") > 0
