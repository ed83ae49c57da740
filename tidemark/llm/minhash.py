"""Near copies by the Jaccard similarity of their word shingles: MinHash bands for candidates, then the true similarity.

Of ``BANDS`` bands of ``ROWS`` minima each, two documents with similarity s agree in a band with probability
s^ROWS, so of 100,000 pairs at 0.8 one agrees in none of 30 bands.  Pairs of a band's key that has up to
``CROWDED`` sets are all compared.  In a larger key every set is compared with one of them, another in each band; a
link can be missed there, unless other links join the two.

Documents with equal sets of shingles are one row from the start, so groups of copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.components import components
from tidemark.llm.passages import Hashes, windows

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
#: Sets with a common band key of which all pairs are compared.
CROWDED = 16
_FACTORS = np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Distinct shingles, as sorted hashes, given the hashes of a text's words; a shorter text is one shingle."""
    return np.unique(windows(h, max(1, min(n, len(h)))).view(np.uint64))


def digest(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles; 0 for the empty set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) if len(s) else 0


def bands(s: np.ndarray) -> np.ndarray:
    if not len(s):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        least = np.min([np.min(_FACTORS[:, None] * s[None, i:i + 4096], axis=1) for i in range(0, len(s), 4096)], axis=0).reshape(BANDS, ROWS)
        return np.concatenate([windows(r, ROWS) for r in least])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, own, bands) of all documents; own tells the set of shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in it:
            sets = [shingles(hashes.of(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(s) for s in sets], pa.int64()),
                                              pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "own", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, own long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(own, items): the sets of shingles, items as 32-bit parts of their hashes."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in it:
            sets = [shingles(hashes.of(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()),
                                              pa.array([np.unique(s.astype(np.uint32)).tobytes() for s in sets], pa.binary())], names=["own", "items"])

    return docs.select("text").mapInArrow(run, "own long, items binary")


def links(docs: DataFrame, reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) with a < b: sets (columns own, bands of ``reps``) whose similarity is at least ``similarity``."""
    keyed = cut(reps.select("own", F.posexplode("bands").alias("band", "key")))
    sizes = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("own", F.xxhash64("own", "band")).alias("center")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["band", "key"]))
    few = shared.filter(F.col("n") <= CROWDED).select("band", "key", "own")
    pairs = few.withColumnRenamed("own", "a").join(few.withColumnRenamed("own", "b"), ["band", "key"]).filter("a < b").select("a", "b")
    centers = shared.filter((F.col("n") > CROWDED) & (F.col("own") != F.col("center"))).select(F.least("own", "center").alias("a"), F.greatest("own", "center").alias("b"))
    pairs = cut(pairs.unionByName(centers).distinct())
    wanted = pairs.select(F.col("a").alias("own")).unionByName(pairs.select(F.col("b").alias("own"))).distinct()
    sets = cut(_sets(docs).join(wanted, "own", "left_semi").dropDuplicates(["own"]))
    left, right = (sets.select(F.col("own").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = b.column(2), b.column(3)
            near = [jaccard(np.frombuffer(x[i].as_py(), np.uint32), np.frombuffer(y[i].as_py(), np.uint32)) >= similarity for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id that can be reached over links).

    Null and empty texts have no shingles and are copies of each other; a null doc_id keeps its row and never
    names a component that has other ids.  An empty table gives no rows.
    """
    own = cut(_sketches(docs))
    reps = own.groupBy("own").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    groups = components(cut(links(docs, reps, similarity)))
    of = reps.join(groups, reps.own == groups.node, "left").select("own", "rep", F.coalesce("component", "own").alias("component"))
    ids = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = cut(of.join(ids, "component").select("own", "component_id"))
    return own.join(known, "own").select("doc_id", "component_id")
