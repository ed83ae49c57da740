"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, katz, mixing, page_text, passages, pieces, simhash, toxicity, url_filter, va_file

LONG = "word " * 30_000
DOCS = [(1, "a b c d", "s1"), (1, "a b c d", "s1"), (2, None, "s2"), (3, "", None), (None, "x y", "s1"), (4, LONG, "s3"), (5, " \t\n ", "s3"), (6, "A  B c d", None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    clash = ["size", "target", "taken", "n_tokens", "ids", "severity", "grade", "component_id", "fingerprint", "row", "key", "fp", "spans", "left_text",
             "place", "range", "n", "own_id", "score", "seed", "pos", "list", "whole_row"]
    for c in clash:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (6, 1, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(DOCS)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty).collect() == []
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r["size"] for r in out.collect()} == {"clash"}
    assert mixing.mixed(empty).collect() == []


def test_toxicity(docs, empty, labels):
    rows = toxicity.graded(docs, docs, labels).collect()
    assert len(rows) == len(DOCS) and not any(r.rejected for r in rows)
    assert toxicity.graded(empty, empty, labels).collect() == []
    assert len(toxicity.graded(docs, docs, labels.filter("false")).collect()) == len(DOCS)


def test_simhash(docs, empty):
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    by_id = {r[0]: r for r in rows}
    assert by_id[2][1] == by_id[3][1] == by_id[5][1] == "0" * 16 and by_id[5][2] == 2
    assert by_id[6][1:] == by_id[1][1:]
    assert None in by_id
    assert len(simhash.near_duplicates(docs).collect()) == len(DOCS)
    assert simhash.near_duplicates(empty).collect() == []


def test_katz(docs, empty):
    assert len(katz.score(docs).collect()) == len(DOCS)
    assert katz.score(empty).collect() == []


def test_passages(docs, empty):
    assert passages.repeated_passages(docs).collect() == []
    same = sorted(passages.without_passages(docs).select("doc_id", "text", "source").collect(), key=str)
    assert same == sorted(docs.select("doc_id", "text", "source").collect(), key=str)
    assert passages.without_passages(empty).collect() == []
    assert passages.repeated_passages(empty).collect() == []


def test_pieces(docs, empty):
    model = pieces.read_model(pieces.model_path())
    rows = pieces.encode_documents(docs, model).collect()
    assert len(rows) == len(DOCS) and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert pieces.encode_documents(empty, model).collect() == []
    kept = pieces.encode_documents(docs.select("doc_id", "text", "n_tokens", "ids"), model, ids=True)
    assert kept.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(d, t) for d, t, _ in DOCS}


def test_pages(spark):
    page = "<html><body><nav>menu</nav><p>text</p></body></html>"
    rows = [(1, "http://a.example/x", page), (1, "http://a.example/x", page), (2, None, page), (None, "", None), (3, "http://a.example/y", ""),
            (4, "nonsense", "<p>" + "long " * 50_000), (5, "http://b.example/x", "<" * 50_000), (6, "http://b.example/y", '<a "' * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("row", F.lit(1))
    out = page_text.main_text(pages).collect()
    assert len(out) == len(rows)
    assert {r.text for r in out if r.page_id in (1, 2)} == {"text"}
    assert all(r.n_chars == len(r.text) for r in out)
    assert page_text.main_text(pages.filter("false")).collect() == []


def test_url_filter(spark):
    import datetime as dt

    day = dt.date(2024, 3, 5)
    rows = [(None, day), ("", day), ("http://a.example/", None), ("http://a.example/", day), ("http://a.example/", day), ("http://x/" + "s/" * 3000, day)]
    captures = spark.createDataFrame(rows, "url string, fetched date").withColumn("verdict", F.lit("clash")).withColumn("kind", F.lit("k"))
    entries = spark.createDataFrame([("block", "domain", "a.example", day, "add"), (None, "domain", "x", day, "add"), ("block", "prefix", "x/s/s", day, "add")],
                                    "list string, kind string, value string, on date, action string")
    out = url_filter.judge(captures, entries).collect()
    assert sorted(r.verdict for r in out) == ["blocked"] * 3 + ["clean"] * 3
    assert url_filter.judge(captures.filter("false"), entries).collect() == []
    assert {r.verdict for r in url_filter.judge(captures, entries.filter("false")).collect()} == {"clean"}


VECTORS = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 0.0]), (50, [0.5, 0.5]), (100, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
           (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [0.5, 0.25]), (None, [1.0, 1.0]), (10, [-1.0, 0.0])]


def test_searches(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("ids", F.lit(1))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in va_file.top_k(df).collect()}
    assert [got[0, i] for i in range(1, 6)] == [(9, 32768), (50, 32768), (100, 32768), (20, 0), (10, -65536)]
    assert {q for q, _ in got} == {0, 50, 100}
    near = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df).collect()}
    assert [near[0, i] for i in range(1, 5)] == [(9, 0.5), (50, 0.5), (100, 0.5), (10, -1.0)]
    assert (0, 5) not in near and all(q in (0, 100) for q, _ in near)
    for one in (df.filter("false"), df.filter("vec_id = 50"), df.filter("vec_id = 3")):
        assert va_file.top_k(one).collect() == [] and ann.nearest(one).collect() == []
