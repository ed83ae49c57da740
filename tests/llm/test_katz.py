import math

import pytest

from brute import Katz
from tidemark.llm import katz

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "The cat ran", "", None, "a dog and a cat and the mat", "the the the the the the the the",
         "on the mat the cat sat", "unknown words here", "the cat sat on the mat", "x", "the dog ran on and on and on"] * 3


@pytest.mark.parametrize("order,chunk,bucket", [(2, 40, 10), (3, 25, 7), (2, 10**6, 10**6), (1, 50, 20)])
def test_scores_as_brute_force(spark, order, chunk, bucket):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "the cat", "y"), (3, "a dog", "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, score string").repartition(3)
    model = Katz([(i, t) for i, t, _ in rows], order)
    got = katz.score(docs, order, chunk, bucket).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").split()) + 1, model.known(t), round(model.base(t), 9), round(model.score(t), 9)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in got) == want
    assert {r.train_tokens for r in got} == {model.total}
    assert {(r.doc_id, r.held_out) for r in got} == {(i, katz.held_out(i)) for i, _, _ in rows}


def test_probabilities_sum_to_one():
    docs = list(enumerate(TEXTS))
    for order in (2, 3):
        model = Katz(docs, order)
        every = {g[0] for g in model.c[1]}
        for h in [h for n, h in model.follow if n == order] + [(b"never",) * (order - 1)]:
            assert math.isclose(sum(model.p(order, h, w) for w in every) + model.p(order, h, b"no such word"), 1, rel_tol=1e-9)


def test_backoff_table_is_the_model(spark):
    rows = list(enumerate(TEXTS))
    model = Katz(rows, 2)
    got = sorted(round(r.alpha, 10) for r in katz.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string"), 2, 40, 10)["backoff"].collect())
    assert got == sorted(round(model.alpha(2, h), 10) for n, h in model.follow if n == 2)


def test_query_uses_trigrams(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model = Katz(rows, 3)
    got = {r.doc_id: round(r.score, 9) for r in QUERIES["op4_katz_scores"](spark, str(tmp_path)).collect()}
    assert got == {i: round(model.score(t), 9) for i, t in rows}
    assert got != {i: round(Katz(rows, 2).score(t), 9) for i, t in rows}


def test_empty_table(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing():
    import numpy as np

    for a in (np.array([], np.int64), np.array([0, 5, 2**62], np.int64), np.arange(1000, dtype=np.int32)):
        assert (katz.unpack(katz.pack(a)) == a).all()
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    assert (katz.unpack_keys(katz.pack_keys(keys)) == keys).all()
    assert (np.diff(katz.bucket_of(keys, 7).astype(int)) >= 0).all()


def zipf_texts(n, length, words, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, int(rng.integers(0, length))), words)) for _ in range(n)]


@pytest.mark.parametrize("order,chunk,bucket", [(3, 300, 400), (3, 10**6, 10**6), (4, 500, 3000), (2, 200, 100)])
def test_words_that_occur_once(spark, order, chunk, bucket):
    """Contexts that occur once, in training or held-out documents only, whole and split ones, as by brute force."""
    rows = list(enumerate(zipf_texts(80, 60, 10**6, 5)))
    model = Katz(rows, order)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_known, round(r.score, 8)) for r in katz.score(docs, order, chunk, bucket).collect()}
    assert got == {i: (model.known(t), round(model.score(t), 8)) for i, t in rows}
    whole = katz.fit_and_score(docs, order, chunk, bucket)
    assert {r.doc_id: (r.n_known, round(r.score, 8)) for r in whole["scores"].collect()} == got
    for n in range(2, order + 1):
        alphas = sorted(round(r.alpha, 8) for r in whole["backoff"].filter(f"n = {n}").collect())
        assert alphas == sorted(round(model.alpha(n, h), 8) for m, h in model.follow if m == n)


def test_tables_are_packed(spark):
    """The tables written for trigrams take a few bytes a token: contexts and events are no rows of their own."""
    import os

    from tidemark.session import shared_dir

    def used():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_dir(spark).removeprefix("file:")) for f in files)

    texts = zipf_texts(400, 1000, 10**6, 6)
    tokens = sum(len(t.split()) + 1 for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    before = used()
    assert len(katz.score(docs, 3, 60_000, 60_000).collect()) == len(texts)
    assert used() - before < 10 * tokens
