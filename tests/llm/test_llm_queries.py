"""Registered queries with SQL against that SQL, and the pipeline against its parts, on the smallest tables."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontaminate, ngram_join, quality, secret_scan, sentencepiece_codec
from graphloom.llm.common import load
from graphloom.llm.queries import MODEL, ORACLE_SQL, QUERIES

DATA = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda pdf: sorted(map(tuple, pdf[sorted(pdf.columns)].astype(object).values.tolist()), key=repr)
    assert rows(got) == rows(want)


def test_names():
    assert {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(n) for n in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "sentencepiece"]


def test_pipeline(spark):
    """Each stage's decision, made anew by plain code from the operators' row results."""
    docs = load(spark, DATA, "documents")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    scored = quality.score(docs, quality.fit(docs, load(spark, DATA, "labels"))).filter("__keep").toPandas()
    texts = dict(zip(scored.doc_id, scored.text, strict=True))

    def shingles(t):
        w = (t or "").lower().split()
        k = min(5, len(w))
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    cutter = decontaminate.Cutter()
    items = [w for r in load(spark, DATA, "benchmark").collect() if len(w := cutter.words(r["text"] or ""))]

    def leaks(text):
        doc = cutter.words(text)
        return any(sum(n for _, _, n in decontaminate.tiling(w, doc, min(decontaminate.MATCH, len(w)))) >= decontaminate.COVERAGE * len(w) for w in items)

    kept = [i for i in ids if root[i] == i and not leaks(texts[i] or "")]
    assert sorted(got) == kept
    table = sentencepiece_codec.ChunkTable(MODEL)
    for i in kept:
        t, out, at = texts[i] or "", "", 0
        spans = [(m.start(), m.end()) for m in re.finditer(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[1]) >= 6]
        spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t)]
        for s, e in sorted(spans):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        assert got[i]["n_tokens"] == table.encode_decode(out + t[at:])[0]


def test_stages_keep_columns(spark):
    docs = load(spark, DATA, "documents")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, DATA)
        assert out.dtypes == docs.dtypes and out.count() == 0, name
    assert ngram_join.NO_ID < 0 and secret_scan.RULES


def test_near_duplicates_of_repeated_rows(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (5, "x y", "en", "s", 1), (5, "u v", "en", "s", 1), (6, "u v", "en", "s", 1), (2, text.upper(), "en", "s", 1), (3, None, None, None, None), (None, text, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({c: F.lit(c) for c in ("id", "version", "__id", "__version")})
    out = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect())
    assert got == [(-1, text), (1, text), (3, ""), (5, "u v"), (5, "x y")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name
