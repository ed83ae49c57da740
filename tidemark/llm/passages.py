"""Substring deduplication by collinear chaining: passages that repeat across documents, also fuzzily.

Seeds are k-mers of words, sampled as minimisers: of every ``WINDOW`` consecutive k-mers the one with the
smallest hash, so any exact run of ``K + WINDOW - 1`` words that two documents share gives them a common
seed.  The owner of a seed is the smallest doc_id that has it; every other document's seed is matched
with the owner's place, so a seed that n documents share gives n - 1 matches and not n^2 (the documents of
a class are linked through its representative).

For a document and an owner, matches that are in order in both are chained: a Fenwick tree over the
owner's places holds, for each prefix, the best chain that ends there, and gaps cost by their length.
Chains are then aligned word by word over the passage and a margin, which extends them to their true ends
and gives the share of words that agree; a chain with too small a share is cut into the parts that have it,
so exact repeats with other words between them are kept.  Pieces of neighbouring chains are joined, and what covers at
least ``MIN_WORDS`` words is a repeated passage.

A seed has one owner, so a passage whose seeds also occur in earlier, unrelated documents may have its matches
scattered over many of them.  Exact repeats do not depend on that: where a document's consecutive seeds all
occur in several documents (``spans``; any passage that two documents share lies in such a span of both), every
window of ``MIN_WORDS`` words is matched with the smallest document that has the same window.

Every shuffle is keyed by seed, by window, by document, by block of a document or by chain.  Owners of frequent seeds are found
by partial aggregation, and matching is a plain join, which Spark splits where a seed is frequent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, words

K, WINDOW = 5, 8
#: Least words of a repeated passage, and least share of agreeing words in each aligned piece.
MIN_WORDS, MIN_SHARE = 50, 0.8
#: Least words of a chain before it is aligned; the rest of a passage lies between seeds or in other pieces.
MIN_CHAIN = 16
#: Cost of a gap for each word of it (in words), and the gap at which a chain is cut in any case.
GAP_COST, MOST_GAP = 0.1, 64
#: Words of a stored block, and the margin of an alignment.
BLOCK, MARGIN = 64, 48
#: Bytes of text whose words are hashed at a time.
RUN = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word):
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))

    def of_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all ``texts``, one after the other, and where each text's begin, with the end of the
        last; each distinct word is looked up once."""
        trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(trimmed), 0), pa.scalar(None, trimmed.type), trimmed))
        found = lists.flatten().dictionary_encode()
        distinct = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        table = np.fromiter(map(self.__getitem__, distinct), np.uint64, len(distinct))
        lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        return table[found.indices.to_numpy()], np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def runs(batch: pa.RecordBatch, text: int = 1, most: int = RUN) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``most`` bytes of text about."""
    size = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), len(size)]
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def seeds(h: np.ndarray, begins: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimisers of texts: their texts, places in the text and hashes, in order.

    ``h`` are the words' hashes of all texts, ``begins`` where each text's begin, with the end of the last.  The
    smallest hash of every window is found over all texts at once, of equal ones the first; windows that reach
    into the next text are left out.
    """
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(n, np.uint64)
        for i in range(k):
            g = (g ^ (g >> np.uint64(29))) * _ODD + h[i:n + i]
        g = (g ^ (g >> np.uint64(32))) * _MIX
        g ^= g >> np.uint64(31)
    kmers = np.diff(begins) - k + 1
    least, at, width = g, np.arange(n), 1
    while width < window and len(least):
        shift = min(width, window - width)  # the second half may overlap the first
        left = max(0, len(least) - shift)
        at = np.where(least[shift:] < least[:left], at[shift:], at[:left])
        least = np.minimum(least[shift:], least[:left])
        width += shift
    last = np.repeat(begins[:-1] + kmers - window, np.diff(begins))[:len(at)]  # of the windows of a place's text
    at = at[np.arange(len(at)) <= last]
    at = at[np.concatenate([[True], np.diff(at) != 0])] if len(at) else at
    short = begins[:-1][(kmers >= 1) & (kmers < window)]
    sizes = kmers[(kmers >= 1) & (kmers < window)]
    if len(short):
        at = np.sort(np.concatenate([at, [lo + int(np.argmin(g[lo:lo + size])) for lo, size in zip(short.tolist(), sizes.tolist())]]))
    text = np.searchsorted(begins, at, "right") - 1
    return text, at - begins[text], g[at]


def _seed_table(docs: DataFrame) -> DataFrame:
    """(seed, doc, pos, first): the seeds of all documents; first marks a seed's first place in the document."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in (part for b in it for part in runs(b)):
            text, pos, g = seeds(*hashes.of_all(batch.column(1)))
            if not len(g):
                continue
            first = np.zeros(len(g), bool)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]]).tolist()
            for lo, hi in zip(edges, edges[1:]):
                first[lo + np.unique(g[lo:hi], return_index=True)[1]] = True
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(pos.astype(np.int32)),
                                              pa.array(first)], names=["seed", "doc", "pos", "first"])

    return docs.mapInArrow(run, "seed long, doc long, pos int, first boolean")


def _block_table(docs: DataFrame) -> DataFrame:
    """(doc, block, tokens): the documents' words as 32-bit hashes, ``BLOCK`` words a row."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in (part for b in it for part in runs(b)):
            h, begins = hashes.of_all(batch.column(1))
            if not len(h):
                continue
            blocks = -(-np.diff(begins) // BLOCK)
            text = np.repeat(np.arange(len(blocks)), blocks)
            block = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            # blocks follow each other without a gap, so the ends of all but the last are the next one's begin
            edges = np.append(begins[text] + BLOCK * block, len(h)) * 4
            tokens = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(h.astype(np.uint32))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(block.astype(np.int32)), tokens],
                                             names=["doc", "block", "tokens"])

    return docs.mapInArrow(run, "doc long, block int, tokens binary")


def chain(x: np.ndarray, y: np.ndarray, k: int = K) -> list[tuple[int, int, int, int]]:
    """Collinear chains of matches (place x in the document, y in the owner): (x0, x1, y0, y1), ends inclusive."""
    return [ends(c) for c in anchored(x, y, k)]


def ends(anchors: np.ndarray) -> tuple[int, int, int, int]:
    (x0, _, y0), (x, x1, y) = anchors[0].tolist(), anchors[-1].tolist()
    return x0, x1, y0, y + x1 - x


def anchored(x: np.ndarray, y: np.ndarray, k: int = K) -> list[np.ndarray]:
    """Chains as their anchors in order: rows of first and last place in the document, first place in the owner.

    Matches on one diagonal with overlapping or close seeds are one anchor.  The score of a chain is the
    words its anchors cover less ``GAP_COST`` for each word between them on either side; as that is linear,
    score + cost * (x + y) of earlier anchors is kept in a Fenwick tree for prefix maxima over y.  Chains
    are read off best end first, and each anchor is used once.
    """
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    joined = np.concatenate([[False], (np.diff(x - y) == 0) & (np.diff(x) <= k + WINDOW)])
    begin = np.flatnonzero(~joined)
    end = np.concatenate([begin[1:], [len(x)]]) - 1
    x0, y0, x1, y1 = x[begin], y[begin], x[end], y[end]
    m = len(begin)
    weight = (x1 - x0 + k).astype(float)
    if m == 1:
        return [np.stack([x0, x1, y0], axis=1)]
    ranks = np.searchsorted(np.unique(np.concatenate([y0, y1])), np.stack([y0, y1]))
    size = int(ranks.max()) + 2
    tree_value, tree_from = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, back = weight.copy(), np.full(m, -1)
    # an anchor may follow another once the sweep over x has passed the other's end
    by_end = np.argsort(x1, kind="stable")
    done = 0
    for i in np.argsort(x0, kind="stable"):
        while done < m and x1[by_end[done]] < x0[i]:
            j = by_end[done]
            done += 1
            value, at = score[j] + GAP_COST * (x1[j] + y1[j]), int(ranks[1, j]) + 1
            while at <= size:
                if value > tree_value[at]:
                    tree_value[at], tree_from[at] = value, j
                at += at & -at
        best, origin, at = float("-inf"), -1, int(ranks[0, i])  # ends strictly before y0
        while at > 0:
            if tree_value[at] > best:
                best, origin = tree_value[at], tree_from[at]
            at -= at & -at
        if origin >= 0:
            gain = best - GAP_COST * (x0[i] + y0[i])
            if gain > 0:
                score[i], back[i] = weight[i] + gain, origin
    used = np.zeros(m, bool)
    out = []
    for i in np.argsort(-score, kind="stable"):
        if used[i]:
            continue
        members, first = [i], i
        used[i] = True
        while True:
            j = back[first]
            if j < 0 or used[j] or x0[first] - x1[j] > MOST_GAP or y0[first] - y1[j] > MOST_GAP:
                break
            used[j] = True
            members.append(j)
            first = j
        at = np.array(members[::-1])
        out.append(np.stack([x0[at], x1[at], y0[at]], axis=1))
    return out


def spans(doc: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(doc, start, end) of the text where words shared with another document may stand, given the places of the
    seeds that several documents have.

    Consecutive minimisers are at most ``WINDOW`` apart.  In ``MIN_WORDS`` shared words the first one stands
    within the first ``WINDOW`` places of a k-mer, the last one within the last.
    """
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    edges = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(x) > WINDOW)) + 1, [len(x)]])
    lo, hi = edges[:-1], edges[1:] - 1
    fit = x[hi] - x[lo] >= MIN_WORDS - K - 2 * (WINDOW - 1)
    for a, b in zip(lo[fit].tolist(), hi[fit].tolist()):
        yield int(doc[a]), max(0, int(x[a]) - WINDOW + 1), int(x[b]) + K + WINDOW - 1


def windows(h: np.ndarray, n: int = MIN_WORDS) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive words."""
    if len(h) < n:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            g = (g ^ (g >> np.uint64(29))) * _ODD + h[i:len(h) - n + 1 + i]
        g = (g ^ (g >> np.uint64(32))) * _MIX
        return (g ^ (g >> np.uint64(31))).view(np.int64)


def _chains(matches: DataFrame) -> DataFrame:
    """(doc, owner, x0, x1, y0, y1, anchors) of all chains of ``MIN_CHAIN`` words or more, and of all ``spans``, which
    have a start x0 and an end x1 and no owner; one document's matches are in one task."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 4

        def handle(cols):
            doc, owner, x, y = cols
            rows = [(d, None, lo, hi, None, None, None) for d, lo, hi in spans(doc, x)]
            other = doc != owner
            doc, owner, x, y = doc[other], owner[other], x[other], y[other]
            edges = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(owner) != 0)) + 1, [len(doc)]])
            begin, end = edges[:-1], edges[1:]
            fit = (end - begin >= 2) & (x[end - 1] - x[begin] + K >= MIN_CHAIN) if len(x) else np.zeros(len(begin), bool)
            for a, b in zip(begin[fit].tolist(), end[fit].tolist()):
                rows += [(doc[a], owner[a], *c, t.astype(np.int32).tobytes()) for t in anchored(x[a:b], y[a:b])
                         if (c := ends(t))[1] - c[0] + K >= MIN_CHAIN and c[3] > c[2]]
            if rows:
                names = ["doc", "owner", "x0", "x1", "y0", "y1", "anchors"]
                kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in it:
            cols = [np.concatenate([old, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for old, c in zip(kept, batch.columns)]
            if not len(cols[0]):
                continue
            change = np.flatnonzero(np.diff(cols[0]) != 0)
            split = int(change[-1]) + 1 if len(change) else 0
            if split:
                yield from handle([c[:split] for c in cols])
            kept = [c[split:] for c in cols]
        if len(kept[0]):
            yield from handle(kept)

    return (matches.repartition("doc").sortWithinPartitions("doc", "owner", "pos").select("doc", "owner", "pos", "owner_pos")
            .mapInArrow(run, "doc long, owner long, x0 int, x1 int, y0 int, y1 int, anchors binary"))


def extend(a: np.ndarray, b: np.ndarray, drop: int = 4) -> int:
    """How many words two sequences go on alike from their start: the best end of a run of matches (+1) and
    mismatches (-1), given up once it falls ``drop`` below the best."""
    n = min(len(a), len(b))
    if not n:
        return 0
    run = np.cumsum(np.where(a[:n] == b[:n], 1, -1))
    falls = np.flatnonzero(np.maximum.accumulate(np.maximum(run, 0)) - run >= drop)
    run = run[:falls[0]] if len(falls) else run
    return int(np.argmax(run)) + 1 if len(run) and run.max() > 0 else 0


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of a longest common subsequence: equal ends first, the middle bit-parallel."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    lo = n if same.all() else int(np.argmin(same))
    a, b = a[lo:], b[lo:]
    n = min(len(a), len(b))
    same = a[::-1][:n] == b[::-1][:n]
    hi = n if same.all() else int(np.argmin(same)) if n else 0
    a, b = (a[:len(a) - hi], b[:len(b) - hi]) if hi else (a, b)
    if not len(a) or not len(b):
        return lo + hi
    places: dict[int, int] = {}
    for j, t in enumerate(b.tolist()):
        places[t] = places.get(t, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for t in a.tolist():
        u = v & places.get(t, 0)
        v = (v + u | v - u) & full
    return lo + hi + len(b) - v.bit_count()


def align(a: np.ndarray, a0: int, b: np.ndarray, b0: int, c: tuple[int, int, int, int]) -> tuple[int, int, int, int, int]:
    """Aligned passage of a chain: (start, end, owner start, owner end, agreeing words), ends exclusive.

    ``a`` and ``b`` are the words of both documents from places ``a0`` and ``b0`` on.
    """
    x0, x1, y0, y1 = c[0] - a0, c[1] + K - a0, c[2] - b0, c[3] + K - b0
    left = extend(a[:x0][::-1], b[:y0][::-1])
    right = extend(a[x1:], b[y1:])
    x0, y0, x1, y1 = x0 - left, y0 - left, x1 + right, y1 + right
    return x0 + a0, x1 + a0, y0 + b0, y1 + b0, agreeing(a[x0:x1], b[y0:y1])


def parts(a: np.ndarray, a0: int, b: np.ndarray, b0: int, anchors: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """What is left of a chain that agrees in too few words as a whole, as by ``align``: the exact runs of its
    anchors, neighbours joined, best first, as long as what they form agrees in ``MIN_SHARE`` of its words."""
    runs = set()
    for x, last, y in anchors.tolist():
        back = min(x - a0, y - b0)
        i, j = x - a0 - back, y - b0 - back
        n = min(len(a) - i, len(b) - j)
        steps = np.diff((a[i:i + n] == b[j:j + n]).astype(np.int8), prepend=0, append=0)
        for lo, hi in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
            if hi > back and lo < back + last - x + K:
                runs.add((i + lo, i + hi, j + lo, j + hi, hi - lo))
    pieces = sorted(runs)

    def joined(p, q):
        """Both and the words between them, with their share; words that both cover count once."""
        if q[1] < p[1] or q[2] < p[2] or q[3] < p[3]:
            return 0.0, p
        same = p[4] + q[4] + agreeing(a[p[1]:q[0]], b[p[3]:q[2]]) - max(0, p[1] - q[0], p[3] - q[2])
        return same / max(q[1] - p[0], q[3] - p[2]), (p[0], q[1], p[2], q[3], same)

    both = [joined(p, q) for p, q in zip(pieces, pieces[1:])]
    while both:
        i = max(range(len(both)), key=lambda i: both[i][0])
        if both[i][0] < MIN_SHARE:
            break
        pieces[i:i + 2] = [both.pop(i)[1]]
        if i > 0:
            both[i - 1] = joined(pieces[i - 1], pieces[i])
        if i < len(both):
            both[i] = joined(pieces[i], pieces[i + 1])
    out = []
    for x0, x1, y0, y1, same in pieces:
        left, right = extend(a[:x0][::-1], b[:y0][::-1]), extend(a[x1:], b[y1:])
        if left and (more := same + int(np.sum(a[x0 - left:x0] == b[y0 - left:y0]))) >= MIN_SHARE * (left + max(x1 - x0, y1 - y0)):
            x0, y0, same = x0 - left, y0 - left, more
        if right and (more := same + int(np.sum(a[x1:x1 + right] == b[y1:y1 + right]))) >= MIN_SHARE * (right + max(x1 - x0, y1 - y0)):
            x1, y1, same = x1 + right, y1 + right, more
        if x1 - x0 >= MIN_CHAIN:
            out.append((x0 + a0, x1 + a0, y0 + b0, y1 + b0, same))
    return out


def _aligned(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """Chains with their words fetched from the block table, aligned; of a chain below ``MIN_SHARE`` its ``parts`` are left.

    Spans give a row for each window: its hash is other_id, its place is start, and it has no share.
    """
    ident = F.struct("doc", "owner", "x0", "x1", "y0", "y1").alias("chain")

    def side(n: int, doc: str, lo: str, hi: str) -> DataFrame:
        # the anchors go with a chain's first block
        first = F.floor(F.greatest(F.lit(0), F.col(lo) - MARGIN) / BLOCK).cast("int")
        last = F.floor((F.col(hi) + K + MARGIN) / BLOCK).cast("int")
        listed = chains.select(ident, F.lit(n).alias("side"), F.col(doc).alias("want"), F.explode(F.sequence(first, last)).alias("block"), "anchors")
        return listed.withColumn("anchors", F.when((F.lit(n) == 0) & (F.col("block") == F.floor(F.greatest(F.lit(0), F.col("chain.x0") - MARGIN) / BLOCK)), F.col("anchors")))

    wanted = side(0, "doc", "x0", "x1").unionByName(side(1, "owner", "y0", "y1").filter("want is not null"))
    needed = cut(wanted)
    blocks = _block_table(docs).join(needed.select(F.col("want").alias("doc"), "block").distinct(), ["doc", "block"], "left_semi")
    words_of = needed.join(blocks.withColumnRenamed("doc", "want"), ["want", "block"])
    # rows of a chain follow each other, so a task holds the words of one chain at a time
    key = ["doc", "owner", "x0", "x1", "y0", "y1"]
    gathered = (words_of.select("chain.*", "side", "block", "tokens", "anchors").repartition(*key)
                .sortWithinPartitions(*key, "side", "block", "tokens"))

    names = ["doc_id", "other_id", "start", "end", "other_start", "other_end", "share"]
    kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4 + [pa.float64()]

    def compared(c, sides, anchors) -> Iterator[pa.RecordBatch]:
        doc, owner, x0, x1, y0, y1 = c
        if not sides[0]:
            return
        a0 = min(sides[0]) * BLOCK
        a = np.frombuffer(b"".join(sides[0].values()), np.int32)
        if y0 < 0:
            if len(g := windows(a[x0 - a0:x1 - a0].view(np.uint32).astype(np.uint64))):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(g), doc)), pa.array(g), pa.array(np.arange(x0, x0 + len(g), dtype=np.int32)),
                    *[pa.nulls(len(g), k) for k in kinds[3:]]], names=names)
        elif sides[1]:
            b0, b = min(sides[1]) * BLOCK, np.frombuffer(b"".join(sides[1].values()), np.int32)
            found = [align(a, a0, b, b0, (x0, x1, y0, y1))]
            if found[0][4] < MIN_SHARE * max(1, found[0][1] - found[0][0], found[0][3] - found[0][2]):
                found = parts(a, a0, b, b0, np.frombuffer(anchors, np.int32).reshape(-1, 3))
            if found:
                rows = [(doc, owner, u0, u1, v0, v1, min(1.0, same / max(1, u1 - u0, v1 - v0))) for u0, u1, v0, v1, same in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sides, anchors = None, [{}, {}], b""
        for batch in it:
            # spans have no owner and no y, so their y0 becomes -1
            ids = np.stack([c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:6]])
            side, block, tokens, marks = (c.to_pylist() for c in batch.columns[6:])
            edges = (np.flatnonzero((np.diff(ids) != 0).any(axis=0)) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if lo < hi and (c := tuple(ids[:, lo].tolist())) != current:
                    if current is not None:
                        yield from compared(current, sides, anchors)
                    current, sides, anchors = c, [{}, {}], b""
                for i in range(lo, hi):
                    sides[side[i]].setdefault(block[i], tokens[i])
                    anchors = marks[i] or anchors
        if current is not None:
            yield from compared(current, sides, anchors)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in each(it):
            held.append(b)
            size += b.num_rows
            if size > 10_000 or len(held) > 1_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return gathered.mapInArrow(run, "doc_id long, other_id long, start int, end int, other_start int, other_end int, share double")


def _exact(found: DataFrame) -> DataFrame:
    """Pieces from the windows that ``_aligned`` gives: neighbours that repeat neighbours of one document are one piece."""
    every = found.filter("share is null").select(F.col("other_id").alias("window"), F.col("doc_id").alias("doc"), F.col("start").alias("pos"))
    owners = cut(every.groupBy("window").agg(F.min(F.struct("doc", "pos")).alias("own"), F.max("doc").alias("last"))
                 .filter(F.col("own.doc") < F.col("last")).select("window", F.col("own.doc").alias("owner"), F.col("own.pos").alias("owner_pos")))
    same = every.join(owners, "window").filter(F.col("doc") != F.col("owner")).withColumn("shift", F.col("pos") - F.col("owner_pos"))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("owner", "shift", "pos"))
    runs = same.withColumn("run", F.col("pos") - n).groupBy("doc", "owner", "shift", "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    end = F.col("hi") + MIN_WORDS
    return runs.select(F.col("doc").alias("doc_id"), F.col("owner").alias("other_id"), F.col("lo").alias("start"), end.alias("end"),
                       (F.col("lo") - F.col("shift")).alias("other_start"), (end - F.col("shift")).alias("other_end"), F.lit(1.0).alias("share"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Pieces of repeated passages: doc_id, other_id, start, end, other_start, other_end (words, ends
    exclusive), share (of agreeing words), passage_start, passage_end.

    A piece says that words start to end of doc_id repeat those of other_id, a smaller doc_id; pieces that
    touch or overlap form a passage, and only passages of ``MIN_WORDS`` words or more are returned.  So
    the first document that has a passage is only named as other_id, and keeps it.  Documents without
    repeated passages have no row.  Null and empty texts have no words; rows with a null doc_id cannot
    be named and take no part; rows that repeat a doc_id are one document.  An empty table gives no rows.
    """
    named = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text")
    table = cut(_seed_table(named))
    owners = (table.filter("first").groupBy("seed").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.min_by("pos", "doc").alias("owner_pos"))
              .filter(F.col("owner") < F.col("last")).drop("last"))
    owners = cut(owners)  # so that the join below is a plain one, which splits where a seed is frequent
    matches = table.select("seed", "doc", "pos").join(owners, "seed").drop("seed")
    found = cut(_aligned(named, cut(_chains(matches))))
    # an exact piece says nothing new if it lies in a piece of a chain
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "exact", "other_id", "other_start").rowsBetween(Window.unboundedPreceding, -1)
    both = found.filter("share is not null").withColumn("exact", F.lit(False)).unionByName(_exact(found).withColumn("exact", F.lit(True)))
    pieces = (both.withColumn("within", F.max(F.when(~F.col("exact"), F.col("end"))).over(before))
              .filter(~F.col("exact") | F.col("within").isNull() | (F.col("within") < F.col("end"))).drop("exact", "within"))
    order = Window.partitionBy("doc_id").orderBy("start", "end", "other_id", "other_start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(F.col("start") <= F.col("reach") + 2, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    grouped = pieces.distinct().withColumn("reach", reach).withColumn("passage", number)
    whole = Window.partitionBy("doc_id", "passage")
    return (grouped.withColumn("passage_start", F.min("start").over(whole)).withColumn("passage_end", F.max("end").over(whole))
            .filter(F.col("passage_end") - F.col("passage_start") >= MIN_WORDS)
            .select("doc_id", "other_id", "start", "end", "other_start", "other_end", "share", "passage_start", "passage_end"))


def without_passages(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; the first document of each passage keeps it.

    All columns stay; a column n_chars is brought up to date.  Documents of which nothing is left are
    dropped; documents without repeated passages stay exactly as they are.
    """
    names = [c.lower() for c in docs.columns]
    mark = "spans"
    while mark in names or f"{mark}_doc" in names:
        mark += "_"
    spans = (found or repeated_passages(docs)).groupBy(F.col("doc_id").alias(f"{mark}_doc")).agg(
        F.array_sort(F.collect_set(F.struct("passage_start", "passage_end"))).alias(mark))
    joined = docs.join(spans, F.col("doc_id") == F.col(f"{mark}_doc"), "left").drop(f"{mark}_doc")
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in it for i in range(0, b.num_rows, 512)):
            *columns, lists = batch.columns
            if lists.null_count < len(lists):
                texts, keep = columns[text_at].to_pylist(), np.ones(len(lists), bool)
                chars = columns[chars_at].to_pylist() if chars_at is not None else None
                for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    texts[i] = cut_words(texts[i], [(p["passage_start"], p["passage_end"]) for p in lists[i].as_py()])
                    keep[i] = bool(texts[i].encode().split())
                    if chars is not None:
                        chars[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars is not None:
                    columns[chars_at] = pa.array(chars, columns[chars_at].type)
                columns = [c.filter(pa.array(keep)) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, which are sorted and do not overlap; the white space before a
    removed passage stays."""
    starts = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for lo, hi in spans:
        if lo >= len(starts):
            break
        out.append(text[at:starts[lo][0]])
        at = starts[hi][0] if hi < len(starts) else len(text)
    out.append(text[at:])
    return "".join(out)
