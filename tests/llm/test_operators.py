"""Operators against plain versions, round trips and held-out rows."""

import random
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, page_text, passages, pieces, simhash, toxicity, va_file
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


# --- SimHash ---------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_as_plain(spark):
    texts = ["a b c", "a", "", None, "A B c d e f g", "The quick\tbrown\nfox \x0b jumps over the lazy dog " * 20, "É b é", "x\x1cy z w"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("crowded", [128, 3])
def test_links_lose_nothing(spark, crowded):
    """Random fingerprints around a few centres, also with every key refined."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5])):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowded=crowded).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and (((a ^ b) & (2**64 - 1)).bit_count() <= 3)}
    assert got == want and len(want) > 300


def test_groups_as_plain(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["un", "deux", "trois", "quatre"]) + str(rng.randrange(50)) for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = base[i % 6].split()
        for _ in range(i // 12):
            w[rng.randrange(len(w))] = "edit"
        rows.append((1000 - i, " ".join(w)))
    fp = {d: plain_fingerprint(t) for d, t in rows}
    group = {d: d for d in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: ("%016x" % fp[d], group[d]) for d in fp}
    assert len(set(group.values())) < len(rows)


# --- searches --------------------------------------------------------------------------------------------

def vectors(n, seed=0, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, d))
    x = centres[rng.integers(0, 10, n)] + 0.7 * rng.standard_normal((n, d))
    x[n // 2:n // 2 + n // 5] = x[n // 2]  # a crowd of equal vectors
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.5, 1.5, (n, 1)).round(1)


def exact(x, q, k):
    s = (x * x[q]).sum(axis=1)
    order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
    return [(int(i), s[i]) for i in order]


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(va_file, "BLOCK_ROWS", 150)
    monkeypatch.setattr(va_file, "PACK_ROWS", 7)
    x = vectors(900)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in va_file.top_k(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    z = np.floor(256 * x).astype(np.int64)
    for q in range(0, 900, 50):
        assert sorted(got[q]) == [(i + 1, v, int(s)) for i, (v, s) in enumerate(exact(z, q, 5))]


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [3e12, 1.0]), (1, [2e12, 5.0]), (2, [1e300, 0.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in va_file.top_k(df).collect()}
    assert got[50, 0] == 256 * (int(256 * 3e12) + 256) and got[50, 1] == 256 * (int(256 * 2e12) + 5 * 256)
    assert got[0, 2] == 2**63 - 1


def test_scan_abandons_candidates():
    """Over 20,000 vectors in groups: with the floor of the nearest ones, under half of the dimensions are read and
    the true neighbours stay."""
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((40, 64))
    x = middle[rng.integers(0, 40, 24_000)] + 0.4 * rng.standard_normal((24_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, turn = x[:60], ann.rotation(64)
    score = q @ x.T
    top = np.argsort(-score, axis=1)[:, :21]
    floor = np.sort(score[:, ::8], axis=1)[:, -21]
    own, at, read = ann.scan(x, x @ turn, (x * x).sum(axis=1), q, q @ turn, floor)
    found = set(zip(own.tolist(), at.tolist()))
    wanted = [(i, int(j)) for i in range(60) for j in top[i]]
    assert read < 0.5 * score.size * 64
    assert sum(w in found for w in wanted) >= 0.95 * len(wanted)
    every, _, _ = ann.scan(x[:500], x[:500] @ turn, (x[:500] ** 2).sum(axis=1), q, q @ turn, np.full(60, -np.inf))
    assert len(every) == 60 * 500


def test_approximate_neighbours(spark):
    x = vectors(4000, seed=3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 4000, 20):
        best = exact(x, q, 20)
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(s - (x[q] * x[v]).sum()) < 1e-12 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hits += len({v for v, _ in best} & {v for _, v, _ in mine})
        total += 20
    assert hits / total > 0.95


# --- SentencePiece ---------------------------------------------------------------------------------------

def test_codec_as_the_library(spark):
    import sentencepiece

    model = pieces.read_model(pieces.model_path())
    codec, lib = pieces.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    memo = pieces.Memo(codec, 1000)
    rng = random.Random(1)
    texts = [r.text for r in Q.table(spark, SF, "documents").select("text").collect()]
    signs = "abcdehinorst eeat   ▁\n\t\0é́ñ漢字🙂<0x41></s>19.,"
    texts += ["".join(rng.choice(signs) for _ in range(n)) for n in [0, 1, 2, 3, 10, 100] * 60] + ["ab" * 20_000 + " " * 777 + "z" * 999]
    for t in texts:
        ids = lib.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == lib.decode(ids)
        parts = memo.text(t)
        assert list(array('i', b''.join([p[0] for p in parts]))) == ids and memo.decoded(parts) == lib.decode(ids)
    for ids in ([3, 4, 200], [259], [260, 259], [], [1, 5, 259, 300], [0, 7], [7, 0]):
        assert codec.decode(ids) == lib.decode(ids)


# --- toxicity --------------------------------------------------------------------------------------------

def test_severity_of_held_out_documents(spark):
    """Fitted on the labels of two thirds of the documents, judged on the rest."""
    docs, labels = Q.table(spark, "/root/testdata/sf0.01", "documents"), Q.table(spark, "/root/testdata/sf0.01", "labels")
    fit_on = labels.filter("doc_id % 3 <> 0")
    out = toxicity.graded(docs.select("doc_id", "text"), docs, fit_on)
    judged = out.join(labels.filter("doc_id % 3 = 0"), "doc_id").select("severity", "rejected", "toxic", "text").collect()
    insults = {"idiot", "moron", "stupid", "clown", "loser", "scum", "trash", "pathetic", "disgusting", "worthless"}
    plain = [bool(insults & set(toxicity.tokens(r.text))) for r in judged]
    assert sum(plain) > 5
    assert sum(r.rejected != p for r, p in zip(judged, plain)) <= 1


def test_ordinal_fit_recovers_weights():
    rng = np.random.default_rng(4)
    n, w, cuts = 6000, np.array([1.5, -1.0, 0.0]), np.array([-1.0, 0.5, 2.0])
    x = rng.standard_normal((n, 3))
    y = (x @ w + rng.logistic(size=n))[:, None] > cuts[None, :]
    rows = [(np.arange(3), v) for v in x]
    model = toxicity.fit_ordinal(rows, y.sum(axis=1), 3, l2=1e-6)
    assert np.abs(model.weights - w).max() < 0.12 and np.abs(model.cuts - cuts).max() < 0.15
    p = model.at_least(np.linspace(-5, 5, 20))
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(p, axis=0) >= 0).all()


def test_ordinal_gradient_and_empty_grades():
    x = [(np.array([0]), np.array([1.0]))] * 5 + [(np.zeros(0, int), np.zeros(0))] * 20
    model = toxicity.fit_ordinal(x, np.array([3] * 5 + [0] * 20), 1)
    assert model.at_least(np.array([model.weights[0], 0.0]))[:, 1].tolist()[0] > 0.8
    assert np.isfinite(model.cuts).all() and (np.diff(model.cuts) > 0).all()


# --- passages --------------------------------------------------------------------------------------------

def test_planted_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    passage, fuzzy, short = text(70), text(120), text(40)
    rows, want = [], {}
    for i in range(40):
        w = text(rng.randrange(30, 300))
        if i in (4, 9, 10, 33):
            at = rng.randrange(len(w))
            w[at:at] = passage
            if i != 4:
                want[i] = (at, at + 70)
        elif i in (6, 20):
            f = list(fuzzy)
            if i == 20:
                f[20] = "changed"
                del f[50]
                f[80:80] = ["put", "in"]
                want[i] = (5, 5 + len(f))
            w[5:5] = f
        elif i % 7 == 0:
            w[3:3] = short
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.other_id): (r.passage_start, r.passage_end) for r in passages.repeated_passages(docs).collect()}
    assert {d for d, _ in got} == set(want)
    assert {o for d, o in got if d != 20} == {4} and {o for d, o in got if d == 20} == {6}
    for (d, _), (a, b) in got.items():
        assert abs(a - want[d][0]) <= 3 and abs(b - want[d][1]) <= 3
    left = {r.doc_id: r.text for r in passages.without_passages(docs).collect()}
    assert all(left[d] == t for d, t in rows if d not in want)
    assert all(len(left[d].split()) <= len(t.split()) - 65 for d, t in rows if d in want)


def test_passages_with_other_words_between(spark):
    """Two exact passages of a document and its owner, with words of their own (on both sides or one) between them."""
    rng = random.Random(19)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, want = [], {}
    for i, (size, gap, other) in enumerate([(55, 30, 30), (55, 45, 45), (60, 45, 45), (60, 60, 60), (80, 50, 50), (55, 45, 0), (55, 0, 45), (60, 62, 30)]):
        one, two = text(size), text(size)
        rows.append((i, " ".join(text(20) + one + text(other) + two + text(20))))
        rows.append((100 + i, " ".join(text(30) + one + text(gap) + two + text(30))))
        want[100 + i] = set(range(30, 30 + size)) | set(range(30 + size + gap, 30 + 2 * size + gap))
    phrase, one = text(7), text(52)  # short shared phrases beside one passage
    rows.append((50, " ".join(phrase + text(18) + one + text(18) + phrase[::-1] + text(20))))
    rows.append((150, " ".join(text(5) + phrase + text(19) + one + text(19) + phrase[::-1])))
    want[150] = set(range(31, 83))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {d: set() for d in want}
    for r in found:
        assert r.other_id == r.doc_id - 100 and r.share >= passages.MIN_SHARE
        got[r.doc_id] |= set(range(r.start, r.end))
    for d in want:
        assert want[d] <= got[d], (d, len(want[d] - got[d]))
        assert len(got[d] - want[d]) <= 14, (d, len(got[d] - want[d]))


def test_passages_whose_seeds_have_many_owners(spark):
    """Each five words of the passage also stand in an earlier document of their own, so no owner has two of its seeds."""
    rng = random.Random(29)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, want = [], {}
    for i, size in enumerate((50, 50, 55, 90)):
        one = text(size)
        order = rng.sample(range(0, size - 4), size - 4)  # one five-word sequence in each earlier document
        rows += [(1000 * i + j, " ".join(text(12) + one[at:at + 5] + text(12))) for j, at in enumerate(order)]
        rows += [(1000 * i + 500 + j, " ".join(text(at) + one + text(20))) for j, at in enumerate((17, 31, 8))]
        want |= {1000 * i + 501: (31, 31 + size), 1000 * i + 502: (8, 8 + size)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.start, r.end, r.other_id, r.other_start, r.share) for r in passages.repeated_passages(docs).collect()}
    assert got == {d: (lo, hi, d // 1000 * 1000 + 500, 17, 1.0) for d, (lo, hi) in want.items()}


def test_seeds_of_many_texts_at_once():
    """Minimisers taken over all texts together are those of each text alone, repeated words and odd texts included."""
    rng = random.Random(41)
    texts = [None, "", " \t", "one", "A b\x0bC\x0cd\x1de  f ", "\u00c4 b c d e f g h i j k l m n", "x " * 40]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in [*range(1, 30), 200]] + [None, ""]
    h, begins = passages.Hashes().of_all(pa.array(texts, pa.string()))
    found = passages.seeds(h, begins)
    assert len(begins) == len(texts) + 1
    for i, t in enumerate(texts):
        own = passages.Hashes().of(t)
        assert own.tolist() == h[begins[i]:begins[i + 1]].tolist()
        g = [int(passages.windows(own[j:j + passages.K], passages.K)[0].view(np.uint64)) for j in range(len(own) - passages.K + 1)]
        width = min(passages.WINDOW, len(g))
        want = sorted({min(range(j, j + width), key=lambda j: (g[j], j)) for j in range(len(g) - width + 1)}) if g else []
        mine = found[0] == i
        assert found[1][mine].tolist() == want and found[2][mine].tolist() == [g[j] for j in want]


def test_words_of_chains_do_not_meet_in_one_row(spark):
    """The words of a chain reach the task that aligns it as rows of one block, not as one row of all blocks: whole
    copies of long documents made batches of rows of many blocks that outgrew an executor."""
    rng = random.Random(43)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3_000))
    docs = spark.createDataFrame([(i, text) for i in range(12)], "doc long, text string").repartition(3)
    chains = spark.createDataFrame([(i, 0, 0, 2_900, 0, 2_900, None) for i in range(1, 12)],
                                   "doc long, owner long, x0 int, x1 int, y0 int, y1 int, anchors binary")
    found = passages._aligned(docs, chains)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(i, 0, 0, 3_000, 0, 3_000, 1.0) for i in range(1, 12)]


def plain_chain_score(x, y, k, cost, limit):
    order = sorted(range(len(x)), key=lambda i: x[i])
    best = {}
    for i in order:
        best[i] = k
        for j in order:
            if j in best and x[j] < x[i] and y[j] < y[i]:
                best[i] = max(best[i], best[j] + k - cost * (x[i] - x[j] + y[i] - y[j]))
    return max(best.values())


def test_chain_finds_the_long_one():
    x = np.array([0, 10, 20, 30, 12, 40, 50])
    y = np.array([100, 110, 121, 131, 5, 142, 60])
    chains = passages.chain(x, y)
    assert (0, 40, 100, 142) in chains
    assert all(a <= b and c <= d for a, b, c, d in chains)
    assert plain_chain_score(x.tolist(), y.tolist(), passages.K, passages.GAP_COST, 64) > passages.K


def test_alignment_helpers():
    a, b = np.arange(20), np.arange(20).copy()
    assert passages.extend(a, b) == 20 and passages.extend(a, b + 1) == 0 and passages.extend(a[:0], b) == 0
    b[10] = 99
    assert passages.extend(a, b) == 20 and passages.agreeing(a, b) == 19
    assert passages.agreeing(a, np.delete(a, 5)) == 19 and passages.agreeing(a, a[:0]) == 0
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert passages.agreeing(np.array(a, int), np.array(b, int)) == table[-1][-1]
        for most in (10**9, 8):  # whole, and by halves
            found: set = set()
            page_text._middle(a, 0, len(a), b, found, most)
            assert len(found) == table[-1][-1] and len(page_text.common(a, b)) == table[-1][-1]
            rest = iter(b)
            assert all(a[i] in rest for i in sorted(found))


def test_words_are_cut_where_they_stand():
    assert passages.cut_words("a b  c\nd e", [(1, 3)]) == "a d e"
    assert passages.cut_words("a b c", [(0, 3)]) == "" and passages.cut_words("a b c", [(2, 9)]) == "a b "


# --- pages -----------------------------------------------------------------------------------------------

def text_of(page):
    lines = page_text.lines_of(page)
    return [x for x, z, _ in lines if z == page_text.MAIN], [x for x, z, _ in lines if z == page_text.PLAIN]


def test_zones():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy > now
    <article class="post comments-open"><header><h1>Title &amp; more</h1></header><p><b>One<br>two <i>th</i>ree&nbsp;four<p>Next</p>
    <aside>See also</aside><form>Search</form><div class="share-buttons">Share</div><p data-x="a>b">Last<p></article>
    <section id="comments"><article class="comment"><p>Nice</p></article></section><footer>&copy; me</footer></body></html>"""
    assert text_of(page) == (["Title & more", "One two three four", "Next", "Last"], [])
    assert text_of("<p>a<p>b<div>c</div>d") == ([], ["a", "b", "c", "d"])
    assert text_of('<main>x<script>1</script></main><div class="cookie-notice">c</div>') == (["x"], [])
    assert text_of('<div id="content"><p>x</p><div class="sidebar">y</div></div><p>z') == (["x"], ["z"])
    assert text_of('<div class="site-header">s</div><article><div class="entry-header"><h1>T</h1></div><p class="byline">by</p>x</article>') == (["T", "x"], [])
    assert text_of("a < b and <3 <p>c") == ([], ["a < b and <3", "c"])
    assert text_of("") == ([], []) and text_of("<p") == ([], []) and text_of("<script>x") == ([], [])


def test_neighbours_are_differenced(spark):
    """Pages without a main element: what the neighbour by URL has too is deleted; a copy deletes nothing."""
    def page(*lines):
        return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"

    body = {i: [f"story {i} line {j} with words of its own" for j in range(6)] for i in range(4)}
    rows = [(1, "http://h.example/news/1", page("Welcome to h", *body[0], "Contact us")),
            (2, "http://h.example/news/2", page("Welcome to h", *body[1], "Contact us")),
            (3, "http://h.example/shop/1", page("Welcome to shop", *body[2], "Checkout")),
            (4, "http://h.example/shop/2", page("Welcome to shop", *body[3], "Checkout")),
            (5, "http://alone.example/", page("Welcome", *body[0])),
            (6, "http://copy.example/1", page("Welcome", *body[0])), (7, "http://copy.example/2", page("Welcome", *body[0]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text.split("\n") for r in page_text.main_text(df).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [body[0], body[1], body[2], body[3]]
    assert got[5] == got[6] == got[7] == ["Welcome", *body[0]]


def plain_main_text(pages):
    """{page_id: text, deleted, restored, dropped} of pages (page_id, host, path, [(line, zone)]) by sorting and a table
    of common subsequences; lines of a page are distinct and shared ones stand in the same order."""
    def alike(a, b):
        x, y = a.split("/"), b.split("/")
        n = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
        return n, -abs(len(a) - len(b))

    out = {}
    order = sorted(pages, key=lambda p: (p[1], p[2], p[0]))
    for i, (page_id, host, path, lines) in enumerate(order):
        near = [p for p in order[max(0, i - 1):i] + order[i + 1:i + 2] if p[1] == host]
        partner = max(near, key=lambda p: (alike(path, p[2]), p in order[:i]))[3] if near else []
        texts, theirs = [t for t, _ in lines], [t for t, _ in partner]
        shared = {j for j, t in enumerate(texts) if t in theirs}
        open_size = sum(len(t) for t, z in lines if z != "nav")
        if open_size and sum(len(lines[j][0]) for j in shared if lines[j][1] != "nav") > 0.7 * open_size:
            shared = set()
        kept = [t for j, (t, z) in enumerate(lines) if z == "article" or z == "div" and j not in shared]
        restored = sum(lines[j][1] == "article" for j in shared)
        out[page_id] = ("\n".join(kept), len(shared) - restored, restored, sum(z == "nav" and j not in shared for j, (_, z) in enumerate(lines)))
    return out


def test_every_page_is_differenced(spark):
    """Pages with and without an article element against a plain version; marks overrule the differencing."""
    rng = np.random.default_rng(11)
    pages = []
    for i in range(300):
        host, path = f"h{rng.integers(3)}.example", f"/{'abc'[rng.integers(3)]}/{'xy'[rng.integers(2)]}/p{i}" + "0" * int(rng.integers(4))
        lines = []
        for j in range(int(rng.integers(2, 14))):
            zone = ["div", "div", "nav", "article"][rng.integers(4 if i % 2 else 3)]
            common = rng.random() < 0.4
            lines.append((f"{j:02d} line of the site {host}" if common else f"{j:02d} own line {i} {rng.integers(1000)}", zone))
        pages.append((i, host, path, lines))
    rows = [(i, f"http://{host}{path}", "<body>" + "".join(f"<{z}><p>{t}</p></{z}>" for t, z in lines) + "</body>") for i, host, path, lines in pages]
    out = page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    want = plain_main_text(pages)
    assert {r.page_id: (r.text, r.lines_deleted, r.lines_restored, r.lines_dropped) for r in out} == want
    assert min(sum(w[k] for w in want.values()) for k in (1, 2, 3)) > 10


def test_unmarked_menus_go_and_single_links_stay():
    linked = "".join(f'<li><a href="/{i}">entry {i}</a></li>' for i in range(3))
    lines = page_text.marked_lines(f'<ul>{linked}</ul><p>text</p><p><a href="/x">one link of the text</a></p>')
    assert [t for t, z in lines if z == page_text.PLAIN] == ["text", "one link of the text"] and len(lines) == 5


def test_neighbours_over_range_borders(spark):
    rows = [(i, f"r{i:03d}", "h" if i < 40 else "g", f"/d{i // 8}/p{i:03d}") for i in range(60)]
    keys = spark.createDataFrame(rows, "page_id long, row string, host string, path string")
    got = {r.row: r.partner for r in page_text.neighbours(keys.repartition(5)).collect()}
    for i, row, host, path in rows:
        near = [(r, p) for j, r, h, p in rows if h == host and abs(j - i) == 1]
        same = [r for r, p in near if p.split("/")[1] == path.split("/")[1]]
        assert got[row] in [r for r, _ in near] and (not same or got[row] in same)
    assert len(got) == 60


def test_pages_of_the_table(spark):
    """On the given pages the article element is the text."""
    import html
    import re

    for r in Q.QUERIES["op10_page_text"](spark, SF).join(Q.table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
