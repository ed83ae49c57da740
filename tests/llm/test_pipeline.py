"""The pipeline on a small corpus with planted cases, each stage against a plain version of it."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidemark.llm import mixing, simhash
from tidemark.llm.common import cut

INSULTS = ["idiot", "moron", "scum", "trash", "loser"]


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(3000)]
    passage = [rng.choice(words) for _ in range(64)]
    docs, toxic = [], set()
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randrange(40, 200))]
        if i % 6 == 1:
            toxic.add(i)
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        if i in (20, 80, 140):
            w[10:10] = passage
        docs.append([i, " ".join(w), "en", f"src{i % 4}" if i % 9 else None])
    for i, of in ((50, 10), (51, 10), (200, 45)):
        docs[i][1] = docs[of][1].upper() if i == 51 else docs[of][1]
    docs[100][1], docs[102][1] = None, ""
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in docs], toxic


def plain_near_dedup(rows):
    fps = defaultdict(list)
    for r in rows:
        fps[simhash.fingerprint(r[1])].append(r[0])
    keys = list(fps)
    group = {k: k for k in keys}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                group[find(a)] = find(b)
    first = defaultdict(list)
    for k, ids in fps.items():
        first[find(k)] += ids
    keep = {min(ids) for ids in first.values()}
    return [r for r in rows if r[0] in keep]


def plain_passages(rows, least=50):
    """Cuts runs of at least ``least`` words that an earlier document has; good for exact repeats."""
    first, out = {}, []
    for r in sorted(rows):
        w = (r[1] or "").split()
        low = [x.lower() for x in w]
        gone = set()
        for i in range(len(w) - least + 1):
            if first.setdefault(tuple(low[i:i + least]), r[0]) != r[0]:
                gone |= set(range(i, i + least))
        out.append(r if not gone else (r[0], " ".join(x for i, x in enumerate(w) if i not in gone), *r[2:]))
    return out


def plain_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(sizes.values())
    open_sources = set(order)
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if 2 * sizes[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_sources}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_sources -= full
    taken, copies = {}, {}
    for s in order:
        budget, before = int(target[s] + 1e-9), 0
        whole = budget // sizes[s] if sizes[s] else 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"mix{r[0]}".encode()).hexdigest(), r[0])):
            n = len((r[1] or "").split())
            rest = budget - whole * sizes[s] - before
            last = max(0, min(n, rest))
            taken[r[0]] = whole * n + last
            copies[r[0]] = whole + (rest > 0 and 2 * last >= n)
            before += n
    return target, taken, copies


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, toxic = corpus()
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = cut(stage(spark, docs, str(sf)))
    return seen, toxic, str(sf)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_toxic_documents_go(stages):
    seen, toxic, _ = stages
    assert seen["toxicity"].columns == seen["documents"].columns
    marked = {r.doc_id for r in seen["documents"].collect() if set((r.text or "").lower().split()) & set(INSULTS)}
    assert marked <= toxic and len(marked) > 30
    assert {r.doc_id for r in seen["documents"].collect()} - {r.doc_id for r in seen["toxicity"].collect()} == marked


def test_one_of_each_group_stays(stages):
    seen, _, _ = stages
    assert table(seen["near_dedup"]) == sorted(plain_near_dedup(table(seen["toxicity"])), key=str)
    assert seen["near_dedup"].count() < seen["toxicity"].count()


def test_passages_are_cut(stages):
    seen, _, _ = stages
    got, want = ({r[0]: (r[1] or "").split() for r in rows} for rows in (table(seen["passages"]), plain_passages(table(seen["near_dedup"]))))
    assert got == {d: w for d, w in want.items()}
    before = {r.doc_id: r for r in seen["near_dedup"].collect()}
    changed = [r for r in seen["passages"].collect() if r.text != before[r.doc_id].text]
    assert {r.doc_id for r in changed} == {80, 140} and all(r.n_chars == len(r.text) for r in changed)


def test_sources_meet_their_targets(stages):
    seen, _, _ = stages
    rows = table(seen["passages"])
    target, taken, copies = plain_mix(rows)
    got = {r.doc_id: r for r in mixing.mix(seen["passages"]).collect()}
    assert {d: r.taken for d, r in got.items()} == taken
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in got.values())
    assert Counter(r.doc_id for r in seen["mix"].collect()) == Counter({d: int(n) for d, n in copies.items() if n})
    by_id = {r[0]: r for r in rows}
    assert all(tuple(r) == by_id[r.doc_id] for r in seen["mix"].collect())


def test_ids_are_the_librarys(stages):
    import sentencepiece

    from tidemark.llm import pieces

    seen, _, sf = stages
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = {r.doc_id: r.text for r in seen["mix"].collect()}
    rows = seen["encode"].collect()
    assert len(rows) == seen["mix"].count()
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    seen, _, sf = stages
    assert table(corpus_pipeline.run(spark, sf)) == table(seen["encode"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "passages", "mix", "encode"]
