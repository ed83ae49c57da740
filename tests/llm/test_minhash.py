import random

import corpus_pipeline
from tidemark.llm import minhash


def plain_sets(texts):
    out = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        out[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def similarity(a, b):
    return len(a & b) / max(1, len(a | b))


def edited(rng, words, share):
    return [f"{w}x{rng.randrange(1000)}" if rng.random() < share else w for w in words]


def test_edited_copies_go(spark):
    """Copies with replaced words at 0.8 or more go; copies below stay, as do other documents."""
    rng = random.Random(3)
    texts = {}
    for i in range(60):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(120, 400))]
        texts[i] = " ".join(w)
        texts[1000 + i] = " ".join(edited(rng, w, (0.005, 0.01, 0.02, 0.05)[i % 4]))
    texts |= {2000: None, 2001: "", 2002: "one two", 2003: "One  two", 2004: "one three"}
    sets = plain_sets(texts)
    near = {i: similarity(sets[i], sets[1000 + i]) for i in range(60)}
    assert sum(0.8 <= s < 0.96 for s in near.values()) >= 15 and sum(s < 0.8 for s in near.values()) >= 15
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(texts) - {1000 + i for i, s in near.items() if s >= 0.8} - {2001, 2003}


def test_large_group_of_near_copies(spark):
    """More near copies than are compared in pairs: still one group."""
    rng = random.Random(4)
    w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(edited(rng, w, 0.005))) for i in range(150)] + [(500, " ".join(w[::-1])), (None, "a b c")]
    got = minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 0) for i in range(150)} | {(500, 500), (None, None)}


def test_empty_table(spark):
    assert minhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
