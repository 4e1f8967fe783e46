"""The operators' queries and the pipeline over a whole small table, and against SQL where there is some."""

import collections
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from torvane.llm import jaccard, queries, winnow

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_is_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.dtypes == columns and 0 < docs.count() <= before, name
        before = docs.count()
        if name == "n-gram Jaccard join":
            assert jaccard.similar_components(docs).filter("doc_id <> component_id").count() == 0
    assert not winnow.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == before


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, token long, h long, start long, kept boolean, component_id long, taken string"


def test_each_stage_on_hard_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, against what each docstring says."""
    long = " ".join(f"w{i}" for i in range(20000))
    passage = " ".join(f"p{i}" for i in range(60))
    near = " ".join(f"n{i}" for i in range(200))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text is not null").first().text
    rows = [
        (None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, "s", None), (3, " \n\t", "en", None, 3),
        (4, long, "en", "s", len(long)), (5, long + " end", "en", "t", len(long) + 4), (6, f"one {passage} two", "en", "s", 9), (7, f"three {passage} four", "en", "s", 9),
        (8, near, "en", "s", 9), (9, near + " x", "de", "t", 9), (9, near + " x", "de", "t", 9), (10, f"before {item} after", "en", "s", 9), (None, "no id at all", "en", "s", 12), (11, "short", "en", "s", 5),
    ]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, True, 6, "x") for r in rows], EXTRA)
    stages = dict(corpus_pipeline.STAGES)
    out = {}
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), SF).collect() == []
        df = stage(spark, docs, SF)
        out[name] = df.collect()
        assert name == "mixing sources" or df.dtypes == docs.dtypes
    ids = lambda name: sorted((r.doc_id is None, r.doc_id or 0) for r in out[name])
    every = sorted((r[0] is None, r[0] or 0) for r in rows)
    kept = ids("quality classifier")
    assert set(kept) <= set(every) and all(kept.count(x) in (0, every.count(x)) for x in set(every) if not x[0])
    gone = {(False, 5), (False, 7), (False, 9)}
    assert ids("n-gram Jaccard join") == sorted([x for x in every if x not in gone and x != (False, 1)] + [(False, 1)])
    texts = collections.defaultdict(set)
    for r in out["suffix-array dedup"]:
        texts[r.doc_id].add(r.text)
    # " end" is what is left of 5, whose text began as that of 4 does; repeated rows of 9 lose the same
    assert texts[4] == {long} and texts[5] == {"end"} and texts[6] == {f"one {passage} two"} and texts[7] == {"three four"} and texts[9] == {"x"} and texts[1] == {""} and texts[2] == {None} and texts[None] == {None, "no id at all"}
    assert all(r.n_chars == len(r.text) for r in out["suffix-array dedup"] if r.doc_id in (5, 7, 9)) and len(out["suffix-array dedup"]) == len(rows)
    assert ids("benchmark decontamination") == [x for x in every if x != (False, 10)]
    size = {(r[0], r[1]): len((r[1] or "").split()) for r in rows}
    assert len(out["mixing sources"]) == len(rows) and sum(r.size for r in out["mixing sources"]) == sum(size[r[0], r[1]] for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in out["mixing sources"])


def test_pipeline_is_its_stages_by_brute_force(spark):
    """run() against loops over the rows that the classifier, a random draw, keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
    sets, head = {}, {i: i for i in rows}
    for i, r in rows.items():
        w = words(r.text)
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for b in sorted(sets):
        for a in sorted(sets):
            if a < b and head[a] != head[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((head[a], head[b]))
                head = {k: x if h == y else h for k, h in head.items()}
    seen, left = set(), {}
    for i in sorted(i for i in rows if head[i] == i):
        w, cut = words(rows[i].text), set()
        for s in range(len(w) - 49):
            if tuple(w[s : s + 50]) in seen:
                cut |= set(range(s, s + 50))
            seen.add(tuple(w[s : s + 50]))
        if not cut or len(cut) < len(w):
            left[i] = [x for k, x in enumerate(w) if k not in cut]
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    sizes = {}
    for i, w in left.items():
        p = plain(" ".join(w))
        if not any(tuple(p[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(p) - n + 1)):
            sizes[i] = len(w)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.size for r in got} == sizes and len(got) == len(sizes)
    by = collections.Counter()
    for r in got:
        by[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(by[r.source] - r.target) <= 1 for r in got)
