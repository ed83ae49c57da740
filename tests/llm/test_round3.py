"""Conversation repair, shard files and the manifest against plain versions, and on odd input."""

import random
import zlib

import brute_new as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as C
from tidemark.llm import manifest as M
from tidemark.llm import queries as Q
from tidemark.llm import wavelet as W

SMALL = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"
DIGESTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ODD = [
    (None, None, None, None), (None, 1, "user", "hi."), (90, None, "user", "a"), (90, None, "user", "a"), (90, 3, "assistant", "b."),
    (91, 0, None, None), (92, 7, "", "x."), (93, 5, "tool", ""), (94, 5, "user", "z " * 50_000), (95, 1, "user", "q."), (95, 1, "user", "q."),
    (95, 1, "assistant", "r."), (95, 9, "user", "q."), (96, 0, "system", "only"), (96, 0, "System", "x!")]


# ---------------------------------------------------------------- conversations

def test_runs_give_the_cheapest_and_least_audit():
    rng = random.Random(3)
    for _ in range(800):
        rows, faults = [], []
        for _ in range(rng.randrange(0, 5)):
            role, fault = rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "", "truncated", "blank"])
            for _ in range(rng.choice([1, 1, 2, 3])):
                rows.append((1, len(rows), role, "x"))
                faults.append(fault)
        runs = []
        for r, f in zip(rows, faults):
            symbol = C.GONE if f == "blank" else 2 * C.ROLES.get(r[2][0], 3) + (f == "truncated")
            if runs and runs[-1][0] == symbol:
                runs[-1] = (symbol, runs[-1][1] + 1)
            else:
                runs.append((symbol, 1))
        audit, state = C.unrolled(runs, 0, C.END)
        assert (C.cost_before(runs, C.END)[0], audit + C.CLOSING[state]) == B.cheapest(rows, faults)
        # the matrix of a piece gives the same costs as its rows
        assert C._before(C.matrix_of(runs), C.END) == C.cost_before(runs, C.END)


def test_long_run_by_powers():
    assert C.cost_before([(0, 1), (2, 10**12)], C.END)[0] == 10**12  # every second one gets the other role


def _digests(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", *DIGESTS).collect()}


def test_conversations_against_search(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rng = random.Random(5)
    # one conversation holds most rows, so it lies over several tasks
    hot = [(99, i, rng.choice(["user", "assistant", "user", "system", "tool"]), rng.choice(["a.", "b", f"{i}?", f"d {i}"])) for i in range(3000)]
    rows = [tuple(r) for r in table.collect()] + ODD + hot
    assert _digests(C.repair(spark.createDataFrame(rows, CONV).withColumn("audit", F.lit(1)).withColumn("kind", F.lit(1)), damage=True)) == B.repair(rows)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD]
    assert _digests(C.repair(spark.createDataFrame(ODD, CONV))) == B.repair(ODD, filled)


def test_repaired_turns_alternate(spark):
    rows = C.repaired(spark.createDataFrame(ODD, CONV)).collect()
    by_conv = {}
    for r in sorted(rows, key=lambda r: r.place):
        by_conv.setdefault(r.conv_id, []).append(r.role[0])
    for roles in by_conv.values():
        said = "".join(roles).removeprefix("s")
        assert said == "ua" * (len(said) // 2)


def test_conversations_empty(spark):
    assert C.repair(spark.createDataFrame([], CONV)).collect() == []


# ---------------------------------------------------------------- shard files

@pytest.mark.parametrize("n, kinds", [(0, 5), (1, 1), (9, 1), (20_000, 3), (30_001, 900)])
def test_shard_answers(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds * 7 + 2).astype("<u4")
    s = W.Shard(W.pack_shard(ids, np.array([n // 2, 0, n - n // 2]), np.array([1, 2, 3]), np.array([False, True, False])))
    assert (s.all_ids() == ids).all() and s.lengths.tolist() == [n // 2, 0, n - n // 2]
    assert all(s.access(int(i)) == ids[i] for i in rng.integers(0, max(n, 1), 20 if n else 0))
    for token in (2, 9, 16, 5, 700):
        places = np.flatnonzero(ids == token)
        assert s.count(token) == len(places) and s.rank(token, n // 3) == (ids[:n // 3] == token).sum()
        assert all(s.select(token, k) == places[k] for k in range(0, len(places), max(1, len(places) // 7)))
    with pytest.raises(IndexError):
        s.access(n)


def test_chunks_equal_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(W.vocabulary_path())
    texts = ["a\x0bb", "a\x1cb c\x85d\xa0e", "é é ́x", "ΑΣ ΑΣΑ, a.b.", "<|endoftext|>x <|ENDOFTEXT|>. a", "it's IT'S. 'S '", " x　y",
             "İstanbul ǅ ß ﬁ.", "12.5, 3;", "no.!? ...", "oḱ. K.", None, "", " \t"]
    encoder = W.ChunkEncoder(W.vocabulary_path(), remembered=4)
    for _ in range(2):
        ids, lengths = encoder.encode(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(lengths))[:-1]]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def _stored_plainly(rows):
    from tokenizers import Tokenizer

    whole, start, out = Tokenizer.from_file(W.vocabulary_path()), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_stored_ids_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = Q.QUERIES["op12_token_files"](spark, SMALL).orderBy("start").collect()
    assert [tuple(r) for r in got] == _stored_plainly([tuple(r) for r in docs.collect()])


def test_stored_ids_of_odd_rows(spark, tmp_path):
    rows = [(None, "a b"), (None, None), (1, None), (1, ""), (1, "b"), (1, "b"), (2, "word " * 30_000), (3, "x" * 100_000), (4, "a " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("start", F.lit(0))
    files = W.write_shards(docs, W.vocabulary_path(), str(tmp_path / "f"), shard=100)
    assert files.count() >= 3
    got = W.read_shards(files, str(tmp_path / "f"), ids=True).orderBy("start").collect()
    assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, _stored_plainly(rows)))
    token = got[-1].ids[0]
    places = W.lookup(str(tmp_path / "f"), spark, token).count()
    assert places == sum(r.ids.count(token) for r in got)
    assert W.stored(docs.filter("false")).collect() == []


# ---------------------------------------------------------------- manifest

PROVEN = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
EDGES = [(None, None, None, None, None), (None, "a", "", 1, "t"), (5, "a", None, 3, ""), (5, "a", None, 3, ""), (5, "b", "zz", None, "x"), (7, "é", "zz", 9, "é" * 50_000)]


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_manifest_against_whole_trees(spark, bits):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*M.FIELDS)
    rows = [tuple(r) for r in docs.collect()] + EDGES
    table = spark.createDataFrame(rows, docs.schema).withColumn("rank", F.lit("clash")).withColumn("grp", F.lit("clash"))
    got = [tuple(r) for r in M.audited(table, bits).select(*PROVEN).collect()]
    assert sorted(map(str, got)) == sorted(map(str, B.manifest(rows)))


def test_log_is_postorder(spark):
    rows = [(i, "s", "en", 1, str(i)) for i in range(37)]
    m = M.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), M.FIELDS, "lang", "doc_id", 2)
    leaves = [r.digest for r in m.leaves.orderBy("rank").collect()]
    whole = M.appended(leaves, 6)
    assert len(whole) == M.DIGEST * (M.position(6, 0, 37) + 1)
    for r in m.log().where("tree = 'rows' and tier = 0").collect():
        at = M.DIGEST * r.first_position
        assert whole[at:at + len(r.nodes)] == bytes(r.nodes)
    assert m.lower.roots.first().digest == whole[-M.DIGEST:]


def test_manifest_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert M.audited(docs.filter("false")).collect() == []


def test_registered(spark):
    assert Q.QUERIES["op11_turn_repair"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()
    rows = Q.QUERIES["op13_merkle_manifest"](spark, SMALL).collect()
    assert 0 < sum(not r.verified for r in rows) < len(rows) and len({r.root for r in rows}) == 1
