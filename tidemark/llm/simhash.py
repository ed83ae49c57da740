"""Near duplicates by SimHash fingerprints: pigeonhole blocks, then the Hamming distance.

A 64-bit fingerprint is cut into five blocks.  Two fingerprints that differ in at most three bits agree
in two blocks at least, so each fingerprint is filed under its ten pairs of blocks (some 26 bits) and only
fingerprints with a common key are compared.  A key with many fingerprints is refined: what is left of
the fingerprint is cut into five blocks again, and the same argument holds, so no link is lost.
Equal fingerprints are one row from the start, so groups of copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, words
from tidemark.llm.components import components

BITS = 3
SEED = 42
#: A key with more fingerprints than this is refined.
CROWDED = 128


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 without words."""
    import xxhash

    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - shingle + 1)
    h = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(w)) - 1:].tolist())
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = hashes[i:i + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of all documents; fp is the fingerprint as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _bits(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    """The bits of some (start, width) ranges side by side."""
    out = F.lit(0).cast("long")
    for start, width in ranges:
        part = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = F.shiftleft(out, width).bitwiseOR(part)
    return out


def _blocks(ranges: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """The bits of ``ranges`` in ``n`` blocks of about equal width, each a list of ranges."""
    bits = np.array([b for start, width in ranges for b in range(start, start + width)])
    runs = [np.split(part, np.flatnonzero(np.diff(part) != 1) + 1) for part in np.array_split(bits, n)]
    return [[(int(run[0]), len(run)) for run in part] for part in runs]


def links(fps: DataFrame, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct fingerprints (column fp) that differ in 1 to ``bits`` bits.

    ``bits`` + 2 blocks, of which two must agree.
    """
    n = bits + 2
    blocks = _blocks([(0, 64)], n)
    pairs = list(combinations(range(n), 2))

    def value(chosen) -> Column:
        return _bits(F.col("fp"), [r for i in chosen for r in blocks[i]])

    keyed = fps.select("fp").distinct().select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("pair"), value(chosen).alias("key")) for k, chosen in enumerate(pairs)])).alias("f")).select("fp", "f.*")
    sizes = keyed.groupBy("pair", "key").count().filter(F.col("count") > crowded).select("pair", "key", F.lit(True).alias("crowded"))
    marked = keyed.join(sizes, ["pair", "key"], "left")
    # what a crowded key does not fix, cut into blocks again; one list of finer keys for each pair
    finer = None
    for k, chosen in enumerate(pairs):
        rest = _blocks([r for i in range(n) if i not in chosen for r in blocks[i]], n)
        keys = F.array(*[F.struct(F.lit(j + 1).alias("part"), _bits(F.col("fp"), [r for i in two for r in rest[i]]).alias("fine"))
                         for j, two in enumerate(combinations(range(n), 2))])
        finer = F.when(F.col("pair") == k, keys) if finer is None else finer.when(F.col("pair") == k, keys)
    plain = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("fine")))
    filed = cut(marked.withColumn("f", F.explode(F.when(F.col("crowded"), finer).otherwise(plain))).select("pair", "key", "f.part", "f.fine", "fp"))
    left, right = filed.withColumnRenamed("fp", "a"), filed.withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return left.join(right, ["pair", "key", "part", "fine"]).filter(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id that can be reached over links, n_links the number of other
    fingerprints that link to the document's own.  Null and empty texts have fingerprint zero and link
    like any other; a null doc_id keeps its row and never names a component that has other ids.
    """
    own = cut(fingerprints(docs, shingle))
    reps = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    pairs = cut(links(reps))
    degree = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    groups = components(pairs)
    rep_of = reps.join(groups, reps.fp == groups.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    ids = rep_of.groupBy("component").agg(F.min("rep").alias("component_id"))
    # one row for each fingerprint; written, so that the join below is a plain one that splits where many
    # documents share a fingerprint
    known = cut(rep_of.join(ids, "component").join(degree.withColumnRenamed("a", "fp"), "fp", "left")
                .select("fp", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    return own.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
