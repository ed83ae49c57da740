"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff weights.

    P(w | h) = d(c) c(h w) / c(h)         if the n-gram occurs in training
             = alpha(h) P(w | h')         else, with h' the context without its oldest word
    alpha(h) = (1 - sum of the first line over seen w) / (1 - sum of P(w | h') over seen w)

d follows Katz for counts up to ``K``; larger counts give ``DELTA`` of one count, so that every context has
mass to hand on.  Words that training does not have share the unigrams' free mass as one type.

Documents are tokenised once into chunks of bounded size.  One order after the other, a chunk asks buckets for the
counts of its distinct n-grams: one entry each, in packed, sorted arrays, never one row for each token, and a
frequent n-gram is one entry a chunk however often it occurs.  A bucket adds up what all chunks have counted, numbers
the n-grams it has seen, and answers each chunk in the order it asked; the next order names its contexts and
words by these numbers, which take a fraction of the bits of a digest.  The n-grams of a context meet in one bucket,
which knows what its backoff weight needs and answers it to the chunks that have an unseen word after this context.
Only a context with more than a quarter of a bucket's n-grams is dealt to several buckets; the documents that need its
weight join the sum of their parts.  An n-gram whose context occurs once in training and in no held-out document is not asked
for: it occurs once as well, and nobody needs the weight of its context.

Words are told apart by 64-bit digests; among n of them n^2 / 2^65 pairs agree by chance (less than one in 5 billion
words).  Longer n-grams are told apart exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, words
from tidemark.session import released

#: Tokens of a chunk about, and n-grams of a bucket about.
CHUNK = 2_000_000
BUCKET = 1_500_000
#: Counts that Good-Turing discounts, and what larger counts give.
K = 5
DELTA = 0.1
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Numbers of no n-gram: the context before a document's first word, and every word that training does not have.
BEGIN, UNKNOWN = 0, 1


class _Vocabulary(dict):
    def __missing__(self, word):
        self[word] = i = len(self)
        return i


def pack(a: np.ndarray) -> bytes:
    """An integer array as compressed bytes, equal bytes of all numbers side by side."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return a.dtype.char.encode() + len(a).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    dtype, n = np.dtype(data[:1].decode()), int.from_bytes(data[1:9], "little")
    planes = pa.decompress(data[9:], n * dtype.itemsize, "zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def pack_runs(ctx: np.ndarray, word: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Pairs in rising order: the contexts, the number of words of each, the words as differences within a context."""
    heads = np.flatnonzero(np.diff(ctx, prepend=-1))
    steps = np.diff(word, prepend=0)
    steps[heads] = word[heads]
    return pack(narrow(np.diff(ctx[heads], prepend=0))), pack(narrow(np.diff(heads, append=len(ctx)))), pack(narrow(steps))


def unpack_runs(ctx: bytes, runs: bytes, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts, their numbers of words, and the words of all of them."""
    sizes, steps = unpack(runs).astype(np.int64), unpack(word).astype(np.int64)
    sums, heads = np.cumsum(steps), np.cumsum(sizes) - sizes
    return np.cumsum(unpack(ctx), dtype=np.int64), sizes, sums - np.repeat(sums[heads] - steps[heads], sizes)


def spread(a: np.ndarray) -> np.ndarray:
    """32 bits that look random for each number."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * _ODD
        return (((x ^ (x >> np.uint64(29))) * _ODD) >> np.uint64(32)).astype(np.int64)


def held_out(doc_id) -> bool:
    """Whether a document is kept out of training; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


#: White space never occurs in words, so this stands for no word.
END = b"\n</s>"


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Tokenised documents, some ``size`` tokens a row: chunk, doc_ids, lens, toks (numbers of words, the frequent ones
    first), places (of these numbers in vocab), vocab (sorted digests), tokens, types."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = ["chunk", "doc_ids", "lens", "toks", "places", "vocab", "tokens", "types"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 24, 0
        ids: list = []
        lens: list[int] = []
        toks: list[np.ndarray] = []
        vocab, total = _Vocabulary({END: 0}), 0

        def out():
            nonlocal made
            known, places = np.unique(np.fromiter((_hash(w) for w in vocab), np.uint64, len(vocab)), return_inverse=True)
            said = np.concatenate(toks)
            common = np.argsort(-np.bincount(said, minlength=len(places)), kind="stable")
            number = np.empty(len(common), np.int64)
            number[common] = np.arange(len(common))
            row = [base + made, ids, pack(narrow(np.array(lens))), pack(narrow(number)[said]), pack(narrow(places[common])), pack_keys(known), total, len(known)]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=names)

        for batch in it:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                t = np.array(list(map(vocab.__getitem__, words(text.as_py()))) + [0], np.int32)
                ids.append(doc_id.as_py())
                lens.append(len(t))
                toks.append(t)
                total += len(t)
                if total >= size:
                    yield out()
                    ids, lens, toks, vocab, total = [], [], [], _Vocabulary({END: 0}), 0
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "chunk long, doc_ids array<long>, lens binary, toks binary, places binary, vocab binary, tokens long, types long")


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so sorted keys come in bucket order."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def discounts(stats: list[int]) -> tuple[np.ndarray, float]:
    """Discount ratios for counts 0 .. K (0 is unused), and the total mass, in counts, that they free.

    ``stats``: numbers of types with count 1 .. K + 1, of all types, of all tokens.  Where the counts of
    counts allow no Good-Turing estimate (small or odd tables), one absolute discount serves instead.
    """
    n = np.array(stats[:K + 1], float)
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        last = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - last) / (1 - last)
    if not (np.all(np.isfinite(d)) and np.all(d > 0) and np.all(d < 1)):
        gap = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = (r - gap) / r
    large_types = stats[K + 1] - n[:K].sum()
    freed = float(((1 - d) * r * n[:K]).sum() + DELTA * large_types)
    return np.concatenate([[0.0], d]), freed


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts > K, counts - DELTA, d[np.minimum(counts, K)] * counts)


def _stats(totals: np.ndarray) -> list[int]:
    """Numbers of types with count 1 .. ``K`` + 1, of all types, of all tokens."""
    return [int(np.sum(totals == r)) for r in range(1, K + 2)] + [int(np.sum(totals > 0)), int(totals.sum())]


def _with_alone(stats: list[int], n: int) -> list[int]:
    """``_stats`` with ``n`` more types that occur once."""
    return [stats[0] + n, *stats[1:K + 1], stats[K + 1] + n, stats[K + 2] + n]


#: What a bucket answers: for a chunk the counts in the order it asked, whether held-out documents have the n-gram (bits), the
#: numbers of those that can be asked for as contexts, and for the contexts with an unseen word (as far as they are whole) how
#: many words have counts 1 .. K and more, and P one order lower of all seen ones.  Chunk -1 has the bucket's statistics, the parts of split contexts, and the model's tables if asked for.
_PART = pa.struct([("ctx", pa.int64()), ("n", pa.list_(pa.int64())), ("low", pa.float64())])
_ANSWER = pa.schema([("n", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()), ("wanted", pa.binary()), ("numbers", pa.binary()),
                     ("after", pa.binary()), ("low", pa.binary()), ("stats", pa.list_(pa.int64())), ("parts", pa.list_(_PART)),
                     ("ctx", pa.binary()), ("runs", pa.binary()), ("words", pa.binary())])
_ANSWER_DDL = ("n int, bucket int, chunk long, counts binary, wanted binary, numbers binary, after binary, low binary, stats array<long>, "
               "parts array<struct<ctx: long, n: array<long>, low: double>>, ctx binary, runs binary, words binary")


def word_requests(store: DataFrame, n_buckets: int) -> DataFrame:
    """What chunks ask for about words: (bucket, chunk, keys, own, held); own counts are of training documents, held (bits)
    tells the words of held-out ones."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                c = Chunk(r["doc_ids"], r["lens"], r["toks"], r["places"])
                keys = unpack_keys(r["vocab"])
                own, held = (np.bincount(c.words, x, len(keys)).astype(np.int64) for x in (c.train, ~c.train))
                edges = np.searchsorted(bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
                rows = [(b, r["chunk"], pack_keys(keys[lo:hi]), pack(narrow(own[lo:hi])), bits(held[lo:hi])) for b, (lo, hi) in enumerate(zip(edges, edges[1:])) if lo < hi]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])],
                                                 names=["bucket", "chunk", "keys", "own", "held"])

    return store.select("chunk", "doc_ids", "lens", "toks", "places", "vocab").mapInArrow(run, "bucket int, chunk long, keys binary, own binary, held binary")


def word_answers(asked: DataFrame, n_buckets: int, keep: bool) -> DataFrame:
    """Counts and numbers of the words of a bucket, the frequent ones first."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows = sorted(table.select(["chunk", "keys", "own", "held"]).to_pylist(), key=lambda r: r["chunk"])
        keys = [unpack_keys(r["keys"]) for r in rows]
        edges = np.cumsum([0] + [len(k) for k in keys])
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([unpack(r["own"]) for r in rows]), len(every)).astype(np.int64)
        wanted = keep | (np.bincount(inverse, np.concatenate([unbits(r["held"], len(k)) for r, k in zip(rows, keys)]), len(every)) > 0)
        rank = np.empty(len(every), np.int64)
        rank[np.argsort(-totals, kind="stable")] = np.arange(len(every))
        seen = totals > 0
        out = [{"n": 1, "bucket": bucket, "chunk": -1, "stats": _stats(totals)}]
        if keep:
            out[0] |= {"words": pack_keys(every[seen]), "counts": pack(narrow(totals[seen])), "numbers": pack(narrow(number(rank[seen], bucket, n_buckets)))}
        for r, lo, hi in zip(rows, edges, edges[1:]):
            t = totals[inverse[lo:hi]]
            out.append({"n": 1, "bucket": bucket, "chunk": r["chunk"], "counts": pack(narrow(t)), "wanted": bits(wanted[inverse[lo:hi]]),
                        "numbers": pack(narrow(rank[inverse[lo:hi]][t > 0]))})
        return pa.Table.from_pylist(out, _ANSWER)

    return asked.groupBy("bucket").applyInArrow(run, _ANSWER_DDL)


def bits(a: np.ndarray) -> bytes:
    return pack(np.packbits(a > 0))


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(data), count=n).astype(bool)


def number(rank: np.ndarray, bucket: int, n_buckets: int) -> np.ndarray:
    """Number among all buckets of a bucket's n-gram with this rank."""
    return rank * n_buckets + bucket + UNKNOWN + 1


class Chunk:
    """The tokens of a chunk."""

    def __init__(self, doc_ids, lens: bytes, toks: bytes, places: bytes):
        self.doc_ids, self.lens = list(doc_ids), unpack(lens).astype(np.int64)
        self.words = unpack(places).astype(np.int64)[unpack(toks)]
        begins = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.first = np.zeros(len(self.words), bool)
        self.first[begins] = True
        self.held = np.array([held_out(i) for i in self.doc_ids], bool)
        self.train = ~self.held[self.doc]


class Words:
    """Counts and numbers of a chunk's words: what ``Grams`` continue."""

    def __init__(self, c: Chunk, got: list[dict], n_buckets: int, n_train: int):
        counts = np.concatenate([unpack(r["counts"]).astype(np.int64) for r in got])
        numbers, wanted = np.full(len(counts), UNKNOWN, np.int64), np.zeros(len(counts), bool)
        at = 0
        for r in got:
            n = len(unpack(r["counts"]))
            numbers[at:at + n][counts[at:at + n] > 0] = number(unpack(r["numbers"]).astype(np.int64), r["bucket"], n_buckets)
            wanted[at:at + n] = unbits(r["wanted"], n)
            at += n
        self.numbers, place = np.unique(numbers, return_inverse=True)
        self.rank, self.count, self.wanted = place[c.words], counts[c.words], wanted[c.words]
        self.before = np.full(len(c.words), n_train, np.int64)


class Grams:
    """The distinct n-grams of a chunk whose contexts occur in training, dealt to buckets.

    ``lower`` are those one word shorter; by bucket, entries rise by the numbers of their contexts and words.
    """

    def __init__(self, c: Chunk, words: Words, lower: Words | Grams, train_docs: int, n_buckets: int, share: int):
        self.n_buckets = n_buckets
        # how often the context of a token occurs, whether held-out documents have it, and its place among the chunk's contexts
        self.before = np.where(c.first, train_docs, np.roll(lower.count, 1))
        self.ctx = np.where(c.first, 0, np.roll(lower.rank, 1) + 1)
        wanted = c.first | np.roll(lower.wanted, 1)
        self.contexts = np.concatenate([[BEGIN], lower.numbers])
        self.alone = (self.before == 1) & ~wanted
        self.at = np.flatnonzero((self.before > 0) & ~self.alone)
        at, width = self.at, len(words.numbers)
        keys, self.inverse = np.unique(self.ctx[at] * width + words.rank[at], return_inverse=True)
        size = len(keys)
        self.entry_ctx, self.word = keys // width, words.numbers[keys % width]
        self.own, self.held = (np.bincount(self.inverse, x[at], size).astype(np.int64) for x in (c.train, ~c.train))

        def value(x):
            out = np.empty(size, np.int64)
            out[self.inverse] = x[at]
            return out

        # only weights need the lower order
        self.low, self.lower_before, before = value(lower.count * wanted), value(lower.before * wanted), value(self.before)
        pieces = before // share + 1
        self.split = pieces > 1
        self.entry_before = before
        number_of = self.contexts[self.entry_ctx]
        self.bucket = (spread(number_of) + spread(self.word) % pieces) % n_buckets
        self.by = np.argsort(narrow(self.bucket), kind="stable")
        self.edges = np.searchsorted(self.bucket[self.by], np.arange(n_buckets + 1))

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, entries) of all buckets that have entries."""
        for b in np.flatnonzero(np.diff(self.edges)):
            yield int(b), self.by[self.edges[b]:self.edges[b + 1]]

    def requests(self, chunk: int) -> list[tuple]:
        """A row for each bucket, and one without entries that tells how many n-grams are not asked for."""
        none = pack(np.zeros(0, np.uint8))
        rows = [(0, chunk, *[none] * 8, int(self.alone.sum()))]
        for b, e in self.parts():
            ctx = self.contexts[self.entry_ctx[e]]
            heads = e[np.flatnonzero(np.diff(ctx, prepend=-1))]
            rows.append((b, chunk, *pack_runs(ctx, self.word[e]), pack(narrow(self.own[e])), bits(self.held[e]), pack(narrow(self.low[e])),
                         pack(narrow(self.lower_before[heads])), pack(narrow(np.where(self.split, self.entry_before, 0)[heads])), 0))
        return rows

    def answered(self, got: list[dict], d: np.ndarray) -> Grams:
        """Adds counts, numbers and log10 of the backoff weights of whole contexts that have an unseen word."""
        totals, numbers, wanted = np.zeros(len(self.word), np.int64), np.zeros(len(self.word), np.int64), np.zeros(len(self.word), bool)
        self.weight = np.zeros(len(self.contexts))
        answers = {r["bucket"]: r for r in got}
        for b, e in self.parts():
            r = answers[b]
            t = unpack(r["counts"]).astype(np.int64)
            totals[e], wanted[e] = t, unbits(r["wanted"], len(t))
            numbers[e[lasting(t, wanted[e])]] = number(np.cumsum(unpack(r["numbers"]), dtype=np.int64), b, self.n_buckets)
            short = needed(self.entry_ctx[e], t, self.split[e])
            ctx = self.entry_ctx[e][short]
            n = unpack(r["after"]).astype(np.int64).reshape(len(ctx), K + 1)
            self.weight[ctx] = np.log10(alpha(n, self.entry_before[e][short], unpack(r["low"]), d))
        numbered = lasting(totals, wanted)
        self.numbers, place = np.unique(numbers[numbered], return_inverse=True)
        rank = np.zeros(len(totals), np.int64)
        rank[numbered] = place
        self.count, self.rank, self.wanted = self.alone.astype(np.int64), np.zeros(len(self.before), np.int64), np.zeros(len(self.before), bool)
        self.count[self.at], self.rank[self.at], self.wanted[self.at] = totals[self.inverse], rank[self.inverse], wanted[self.inverse]
        self.whole = np.ones(len(self.contexts), bool)
        self.whole[self.entry_ctx[self.split]] = False
        return self


def lasting(totals: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which n-grams can be asked for as contexts."""
    return (totals > 1) | ((totals > 0) & wanted)


def needed(ctx: np.ndarray, totals: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Places of the first entries of contexts that are whole and have an unseen word."""
    heads = np.flatnonzero(np.diff(ctx, prepend=-1))
    unseen = np.maximum.reduceat((totals == 0).astype(np.int8), heads) if len(heads) else np.zeros(0, np.int8)
    return heads[(unseen > 0) & ~split[heads]]


def alpha(n: np.ndarray, before: np.ndarray, low: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights of contexts that occur ``before`` times: ``n`` words after them have counts 1 .. K and more."""
    r = np.arange(1, K + 1)
    small = n[:, :K] * r
    seen = ((small * d[1:]).sum(axis=1) + before - small.sum(axis=1) - DELTA * n[:, K]) / before
    return (1 - seen) / (1 - low)


_REQUEST = ["bucket", "chunk", "ctx", "runs", "words", "own", "held", "low", "lower", "split", "alone"]
_REQUEST_KINDS = [pa.int32(), pa.int64()] + [pa.binary()] * 8 + [pa.int64()]
_REQUEST_DDL = ("bucket int, chunk long, ctx binary, runs binary, words binary, own binary, held binary, low binary, lower binary, "
                "split binary, alone long")


def gram_answers(asked: DataFrame, n: int, n_buckets: int, d_lower: np.ndarray, keep: bool) -> DataFrame:
    """Counts, numbers and backoff of the n-grams of a bucket; ``d_lower`` are the discounts one order lower."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows = sorted(table.select(_REQUEST).to_pylist(), key=lambda r: r["chunk"])
        alone = sum(r["alone"] for r in rows)
        rows = [r for r in rows if len(unpack(r["own"]))]
        if not rows:
            return pa.Table.from_pylist([{"n": n, "bucket": bucket, "chunk": -1, "stats": _with_alone(_stats(np.zeros(0, np.int64)), alone), "parts": []}], _ANSWER)
        runs = [unpack_runs(r["ctx"], r["runs"], r["words"]) for r in rows]
        contexts, place = np.unique(np.concatenate([c for c, _, _ in runs]), return_inverse=True)
        sizes, word = (np.concatenate([x[i] for x in runs]) for i in (1, 2))
        ctx = np.repeat(place, sizes)
        width = int(word.max()) + 1
        every, inverse = np.unique(ctx * width + word, return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([unpack(r["own"]) for r in rows]), len(every)).astype(np.int64)
        entry_ctx = every // width
        wanted = keep | (np.bincount(inverse, np.concatenate([unbits(r["held"], len(w)) for r, (_, _, w) in zip(rows, runs)]), len(every)) > 0)
        low, lower, split = np.empty(len(every), np.int64), np.empty(len(contexts), np.int64), np.empty(len(contexts), bool)
        low[inverse] = np.concatenate([unpack(r["low"]) for r in rows])
        lower[place] = np.concatenate([unpack(r["lower"]) for r in rows])
        split[place] = np.concatenate([unpack(r["split"]) for r in rows]) > 0
        seen, numbered = totals > 0, lasting(totals, wanted)
        rank = np.cumsum(numbered) - 1
        group = np.minimum(totals[seen], K + 1) - 1
        after = np.bincount(entry_ctx[seen] * (K + 1) + group, minlength=len(contexts) * (K + 1)).reshape(-1, K + 1)
        mass = np.bincount(entry_ctx[seen], discounted(low[seen], d_lower) / np.maximum(lower[entry_ctx[seen]], 1), len(contexts))
        most = np.bincount(entry_ctx, np.where(totals > K, totals, 0), len(contexts)).astype(np.int64)
        listed = np.flatnonzero((keep | split) & (after.sum(axis=1) > 0))
        parts = [{"ctx": int(contexts[i]), "n": [*after[i].tolist(), int(most[i])], "low": float(mass[i])} for i in listed]
        out = [{"n": n, "bucket": bucket, "chunk": -1, "stats": _with_alone(_stats(totals), alone), "parts": parts}]
        if keep:
            out[0] |= dict(zip(("ctx", "runs", "words"), pack_runs(contexts[entry_ctx[seen]], every[seen] % width))) | {"counts": pack(narrow(totals[seen]))}
        hi = 0
        for r, (_, _, w) in zip(rows, runs):
            lo, hi = hi, hi + len(w)
            e = inverse[lo:hi]
            t, c = totals[e], ctx[lo:hi]
            short = c[needed(c, t, split[c])]
            out.append({"n": n, "bucket": bucket, "chunk": r["chunk"], "counts": pack(narrow(t)), "wanted": bits(wanted[e]),
                        "numbers": pack(narrow(np.diff(rank[e][numbered[e]], prepend=0))), "after": pack(narrow(after[short].ravel())), "low": pack(mass[short])})
        return pa.Table.from_pylist(out, _ANSWER)

    return asked.groupBy("bucket").applyInArrow(run, _ANSWER_DDL)


class Model:
    """What every task knows while the orders are counted: statistics and numbers of buckets."""

    def __init__(self, train_docs: int, share: int):
        self.train_docs, self.share = train_docs, share
        self.stats: dict[int, list[int]] = {}
        self.buckets: dict[int, int] = {}

    @property
    def n_train(self) -> int:
        return self.stats[1][K + 2]

    def levels(self, store: pa.Table, answers: pa.Table) -> tuple[Chunk, list]:
        """The chunk with its n-grams of all orders that are answered."""
        c = Chunk(*[store[name][0].as_py() for name in ("doc_ids", "lens", "toks", "places")])
        got = sorted(answers.select(["n", "bucket", "counts", "wanted", "numbers", "after", "low"]).to_pylist(), key=lambda r: (r["n"], r["bucket"]))
        out: list = [Words(c, [r for r in got if r["n"] == 1], self.buckets[1], self.n_train)]
        for n in range(2, max(self.stats) + 1):
            out.append(self.following(c, out, self.buckets[n]).answered([r for r in got if r["n"] == n], discounts(self.stats[n])[0]))
        return c, out

    def following(self, c: Chunk, levels: list, n_buckets: int) -> Grams:
        return Grams(c, levels[0], levels[-1], self.train_docs, n_buckets, self.share)


def _met(store: DataFrame, answers: list[DataFrame], run, ddl: str) -> DataFrame:
    """``run`` once a chunk, with the answers of all orders so far."""
    got = answers[0]
    for a in answers[1:]:
        got = got.unionByName(a)
    got = got.filter("chunk >= 0").select("chunk", "n", "bucket", "counts", "wanted", "numbers", "after", "low")
    return store.select("chunk", "doc_ids", "lens", "toks", "places").groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(run, ddl)


def gram_requests(store: DataFrame, answers: list[DataFrame], model: Model, n_buckets: int) -> DataFrame:
    """What chunks ask for about n-grams one word longer than those that are answered."""
    def run(key: tuple, store: pa.Table, got: pa.Table) -> pa.Table:
        c, levels = model.levels(store, got)
        rows = model.following(c, levels, n_buckets).requests(key[0].as_py())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), _REQUEST_KINDS)], names=_REQUEST)

    return _met(store, answers, run, _REQUEST_DDL)


def evaluate(store: DataFrame, answers: list[DataFrame], model: Model) -> DataFrame:
    """Per chunk: a row for each document (n is 0), and one for each document and split context whose weight it
    needs (chunk, at: the document; n, ctx, times)."""
    schema = pa.schema([("n", pa.int32()), ("chunk", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("ctx", pa.int64()), ("times", pa.int64())])

    def run(key: tuple, store: pa.Table, got: pa.Table) -> pa.Table:
        c, levels = model.levels(store, got)
        chunk, docs, n_train, types = key[0].as_py(), len(c.lens), model.n_train, model.stats[1][K + 1]
        d, freed = discounts(model.stats[1])
        free = freed / n_train if n_train else 1.0
        count = levels[0].count
        known = count > 0
        logs = np.log10(np.where(known, discounted(count, d) / max(n_train, 1), free))
        backed = []
        for n, g in enumerate(levels[1:], 2):
            seen = g.count > 0
            now = discounted(g.count, discounts(model.stats[n])[0]) / np.maximum(g.before, 1)
            # an unseen n-gram takes the value one order lower, times the weight of its context if that occurs
            logs = np.where(seen, np.log10(np.where(seen, now, 1)), logs)
            backed = [b & ~seen for b in backed] + [~seen & (g.before > 0)]
        tables = []
        for n, (g, b) in enumerate(zip(levels[1:], backed), 2):
            logs = logs + np.where(b, g.weight[g.ctx], 0)
            at = np.flatnonzero(b & ~g.whole[g.ctx])
            pairs, times = np.unique(c.doc[at] * len(g.contexts) + g.ctx[at], return_counts=True)
            tables.append({"n": np.full(len(pairs), n), "at": pairs // len(g.contexts), "ctx": g.contexts[pairs % len(g.contexts)], "times": times})
        base = np.log10((count + 0.1) / (n_train + 0.1 * (types + 1)))

        def total(x):
            return np.bincount(c.doc, x, docs)

        tables.append({"n": np.zeros(docs, np.int32), "at": np.arange(docs), "doc_id": c.doc_ids, "held_out": c.held, "n_tokens": c.lens,
                       "n_known": total(known).astype(np.int64), "base_score": total(base), "score": total(logs)})
        sized = [t | {"chunk": np.full(len(t["at"]), chunk)} for t in tables]
        return pa.concat_tables([pa.table([pa.array(t[f.name], f.type) if f.name in t else pa.nulls(len(t["at"]), f.type) for f in schema], schema=schema) for t in sized])

    return _met(store, answers, run, "n int, chunk long, at long, doc_id long, held_out boolean, n_tokens long, n_known long, "
                                     "base_score double, score double, ctx long, times long")


def backoff_table(answers: list[DataFrame], model: Model) -> DataFrame:
    """(n, ctx, alpha) of the contexts that buckets list: their parts added up."""
    def weight(n: int) -> Column:
        d = discounts(model.stats[n])[0]
        small = [F.col(f"s{i}") * (i + 1) for i in range(K)]
        before = sum(small[1:], small[0]) + F.col(f"s{K + 1}")
        seen = sum([s * float(d[i + 1]) for i, s in enumerate(small)], F.col(f"s{K + 1}") - F.col(f"s{K}") * DELTA) / before
        return (1 - seen) / (1 - F.col("low"))

    tables = []
    for n, a in enumerate(answers[1:], 2):
        parts = a.filter("chunk = -1").select(F.inline("parts")).withColumnRenamed("n", "s")
        sums = parts.groupBy("ctx").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(K + 2)], F.sum("low").alias("low"))
        tables.append(sums.select(F.lit(n).alias("n"), "ctx", weight(n).alias("alpha")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def score(docs: DataFrame, order: int = 2, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those that ``held_out`` leaves; every document is scored whole.  A null or empty
    text is its end token alone.  Repeated rows are documents of their own (and train as often as they
    occur).  Without training text every token has probability 1.  ``order`` is the n of the model.  An empty table gives no rows.
    Further columns are ignored.
    """
    return _fitted(docs, order, chunk, bucket, keep=False)["scores"]


def fit_and_score(docs: DataFrame, order: int = 2, chunk: int = CHUNK, bucket: int = BUCKET) -> dict[str, DataFrame]:
    """The scores with the model's tables: counts (n, bucket, and packed: contexts, their numbers of words, words, counts; of
    words their digests, counts and numbers) and backoff (n, ctx, alpha)."""
    return _fitted(docs, order, chunk, bucket, keep=True)


def _fitted(docs: DataFrame, order: int, chunk: int, bucket: int, keep: bool) -> dict[str, DataFrame]:
    with released(docs.sparkSession):
        store = cut(chunks(docs, chunk))
        # every training document ends with one end token, so its count is the number of these documents
        is_train = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
        model = Model(store.select(F.explode("doc_ids").alias("id")).filter(is_train).count(), max(1, bucket // 4))
        size = store.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
        answers: list[DataFrame] = []
        for n in range(1, order + 1):
            n_buckets = max(1, -(-int(size.types if n == 1 else size.tokens) // bucket))
            if n == 1:
                found = word_answers(word_requests(store, n_buckets), n_buckets, keep)
            else:
                found = gram_answers(gram_requests(store, answers, model, n_buckets), n, n_buckets, discounts(model.stats[n - 1])[0], keep)
            answers.append(cut(found))
            sums = answers[-1].filter("chunk = -1").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(K + 3)]).first()
            model.stats[n], model.buckets[n] = [int(x) for x in sums], n_buckets
    rows = evaluate(store, answers, model)
    if order > 1:
        rows = cut(rows)
        backoff = backoff_table(answers, model)
        weights = (rows.filter("n > 0").select("n", "ctx", "chunk", "at", "times").join(backoff, ["n", "ctx"])
                   .groupBy("chunk", "at").agg(F.sum(F.col("times") * F.log10("alpha")).alias("weights")))
        scored = rows.filter("n = 0").drop("n", "ctx").join(weights, ["chunk", "at"], "left")
    else:
        backoff = docs.sparkSession.createDataFrame([], "n int, ctx long, alpha double")
        scored = rows.withColumn("weights", F.lit(0.0))
    scores = scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_train).cast("long").alias("train_tokens"), "base_score",
                           (F.col("score") + F.coalesce("weights", F.lit(0.0))).alias("score"))
    counts = answers[0]
    for a in answers[1:]:
        counts = counts.unionByName(a)
    return {"scores": scores, "counts": counts.filter("chunk = -1").drop("chunk", "wanted", "after", "low", "parts", "stats"), "backoff": backoff}
