"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors are rotated by a fixed random orthogonal matrix and kept in column blocks.  Each vector is in the
list of its nearest centroid; a query probes the lists with the most promising centroids.  The first few are
scanned in full, and the k-th best score found there goes with the query to the other lists as its floor.
There a candidate's partial distance over the first blocks, scaled to all dimensions, is tested from the first
row on against the distance that would still beat the floor; the hypothesis test widens the estimate by its
error, and who fails is abandoned before the other blocks are read.  Survivors get the exact score.

For inner products the distance that still enters is |q|^2 + |x|^2 - 2 s, with s the floor.

Centroids are fitted on a bounded sample (``SAMPLE`` rows by hash) and every row is indexed.  Lists and
the queries that probe them are dealt in parts of bounded size, so a crowded list is many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vectors as V
from tidemark.llm.common import cut

SAMPLE = 16_384
MOST_LISTS = 1024
#: The nearest lists that are scanned in full hold about this many times k + 1 rows.
FIRST = 4
PART_ROWS = 2048
#: Dimensions in a column block, and the width of the test in standard errors.
BLOCK_DIMS = 16
WIDTH = 2.0
#: Pairs held at once in a scan, and the share of them alive from which single pairs are read.
PAIRS = 1 << 18
GATHER = 0.7
#: The share of true neighbours that probing must reach on the sample.
RECALL = 0.97


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit_lists(sample: np.ndarray, n_rows: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the sample by Lloyd's rounds; their number follows the root of the table's rows."""
    n = int(min(MOST_LISTS, max(1, np.sqrt(n_rows)), max(1, len(sample) // 4)))
    if n < 2:
        return sample.mean(axis=0, keepdims=True)
    rng = np.random.default_rng(11)
    c = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c ** 2).sum(1) - 2 * sample @ c.T, axis=1)
        size = np.bincount(near, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], sample[rng.choice(len(sample), n)])
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c ** 2).sum(1) - 2 * x @ c.T, axis=1)


def probes(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]


def fit_probes(sample: np.ndarray, c: np.ndarray, k: int) -> int:
    """The fewest probes that find ``RECALL`` of the sample's own neighbours, with half as many again.

    Neighbours in a sample are farther away than in the table, so this errs to the safe side.
    """
    if len(c) == 1:
        return 1
    near, hits = assign(sample, c), []
    for q in np.array_split(np.arange(min(len(sample), 512)), 8):
        score = sample[q] @ sample.T
        score[np.arange(len(q)), q] = -np.inf
        top = np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, :k]
        place = np.argsort(probes(sample[q], c, len(c)), axis=1)  # rank of each list for each query
        hits.append(np.take_along_axis(place, near[top], axis=1).ravel())
    need = int(np.quantile(np.concatenate(hits), RECALL)) + 1
    return min(len(c), need + need // 2)


def best_of(score: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Mask of each query's scores (a row of ``score``) that may be among its k + 1 best, ties included."""
    if copies.sum() <= k + 1:
        return np.ones(score.shape, bool)
    order = np.argsort(-score, axis=1, kind="stable")
    place = (np.cumsum(copies[order], axis=1) <= k).sum(axis=1)
    return score >= np.take_along_axis(score, order, axis=1)[np.arange(len(score)), place][:, None]


def spans(own: np.ndarray):
    """(value, begin, end) of the runs of equal values."""
    edge = np.nonzero(np.diff(own, prepend=-1, append=-1))[0] if len(own) else np.zeros(0, int)
    return [(own[a], a, b) for a, b in zip(edge[:-1], edge[1:])]


def scan(x, xr, norms, q, qr, floor):
    """(query, candidate) positions that the test leaves, and how many dimensions of all pairs were read.

    A pair's squared distance over the first blocks, scaled to all dimensions, is tested against the distance that
    would still beat the query's ``floor`` (a score; minus infinity: every pair stays).  Blocks are read for whole
    queries x candidates while most pairs live, then for single pairs.
    """
    d, found, read = x.shape[1], [], 0
    slab = max(1, PAIRS // max(len(x), 1))
    for begin in range(0, len(q), slab):
        own = slice(begin, begin + slab)
        need = (q[own] ** 2).sum(axis=1)[:, None] + norms[None, :] - 2 * floor[own][:, None]
        part, at, live = np.zeros(need.shape), None, need.size
        alive = np.ones(need.shape, bool)
        for b in range(0, d, BLOCK_DIMS):
            used = min(b + BLOCK_DIMS, d)
            xb, qb = xr[:, b:used], qr[own, b:used]
            if at is None and live <= GATHER * need.size:
                at = np.nonzero(alive)
                part, need = part[at], need[at]
            if at is None:
                read += need.size * (used - b)
                part = part + (qb ** 2).sum(axis=1)[:, None] + (xb ** 2).sum(axis=1)[None, :] - 2 * qb @ xb.T
            else:
                read += len(part) * (used - b)
                diff = qb[at[0]] - xb[at[1]]
                part = part + np.einsum("ij,ij->i", diff, diff)
            # a random rotation leaves a Beta share of the distance in the first blocks: its relative error
            slack = 1 + WIDTH * np.sqrt(2 * (d - used) / (used * (d + 2)))
            alive = part * (d / used) <= need * slack + 1e-9 * (1 + np.abs(need))
            live = int(alive.sum())
            if at is not None:
                at, part, need = (at[0][alive], at[1][alive]), part[alive], need[alive]
        left = np.nonzero(alive) if at is None else at
        found.append((left[0] + begin, left[1]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), 0
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), read


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest inner products found, in double precision.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but those with
    the query's own id; ties go to smaller ids.  Rows that cannot take part are named in
    ``vectors.usable`` (nor do zero vectors).  Repeated rows count once.  Fewer candidates than ``k`` are
    all returned; an empty table, or a single row, gives no rows.  Further columns are ignored.
    """
    usable = cut(V.usable(embeddings, lambda x: x, zeros=False))
    queries = cut(V.query_classes(usable, every))
    table = cut(V.classes(usable, k + 1))
    n_rows = table.count()
    picked = table.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(picked):
        return V.best(table.select(F.col("cls").alias("qcls"), F.lit(0.0).alias("score"), "ids").limit(0), queries, k)
    sample = V.matrix(picked)
    centroids = fit_lists(sample, n_rows)
    n_probes, d = fit_probes(sample, centroids, k), sample.shape[1]
    turn = rotation(d)

    def assigned(it):
        for pdf in it:
            if len(pdf):
                yield pdf.assign(list=assign(V.matrix(pdf["v"]), centroids).astype(np.int32))

    first = min(n_probes, 1 + -(-FIRST * (k + 1) * len(centroids) // n_rows))

    def asked(it):
        for pdf in it:
            if len(pdf):
                yield pdf.assign(lists=list(probes(V.matrix(pdf["v"]), centroids, n_probes).astype(np.int32)))

    rows = cut(table.mapInPandas(assigned, "cls string, v array<double>, ids array<long>, list int"))
    ask = cut(table.join(queries.select("cls").distinct(), "cls", "left_semi").select("cls", "v")
              .mapInPandas(asked, "cls string, v array<double>, lists array<int>"))

    def search(cands: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        names, at, score, ids = [], np.zeros(0, int), np.zeros(0), []
        if len(cands) and len(asks):
            x, ids = V.matrix(cands["v"]), cands["ids"].tolist()
            copies = np.array([len(i) for i in ids])
            q, floor = V.matrix(asks["v"]), asks["floor"].to_numpy(dtype=float)
            own, at, _ = scan(x, x @ turn, (x * x).sum(axis=1), q, q @ turn, floor)
            score = np.concatenate([(x[a] * q[o]).sum(axis=1) for o, a in zip(np.array_split(own, 1 + len(own) // PAIRS),
                                                                            np.array_split(at, 1 + len(own) // PAIRS))])
            # of what a query's floor leaves here, no more than its best: positions of one query are together
            keep = score >= floor[own]
            for o, a, b in spans(own):
                keep[a:b] &= best_of(score[None, a:b], copies[at[a:b]], k)[0]
            names, at, score = asks["cls"].to_numpy()[own[keep]], at[keep], score[keep]
        return pd.DataFrame({"qcls": pd.Series(names, dtype=object), "score": score,
                             "ids": pd.Series([ids[i] for i in at.tolist()], dtype=object)})

    def scanned(asking: DataFrame) -> DataFrame:
        """``search`` over every list that ``asking`` (cls, v, floor, list) names."""
        # one row for each list, at most MOST_LISTS: how many parts its rows and its queries are dealt in
        deal = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
                           .join(asking.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("packs")), "list"))

        def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
            return (df.join(deal, "list").withColumn(mine, F.pmod(F.xxhash64("cls"), F.col(own)).cast("int"))
                    .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1))).drop("parts", "packs"))

        left = dealt(rows, "parts", "packs", "part", "pack").groupBy("list", "part", "pack")
        right = dealt(asking, "packs", "parts", "pack", "part").groupBy("list", "part", "pack")
        return left.cogroup(right).applyInPandas(search, "qcls string, score double, ids array<long>")

    lowest = F.lit(float("-inf"))
    near = cut(scanned(ask.select("cls", "v", lowest.alias("floor"), F.explode(F.slice("lists", 1, first)).alias("list"))))
    best = Window.partitionBy("qcls").orderBy(F.desc("score"), F.asc("id"))
    floors = (near.select("qcls", "score", F.explode("ids").alias("id")).withColumn("n", F.row_number().over(best))
              .filter(F.col("n") == k + 1).select(F.col("qcls").alias("cls"), F.col("score").alias("floor")))
    if n_probes > first:
        rest = ask.join(floors, "cls", "left").select(
            "cls", "v", F.coalesce("floor", lowest).alias("floor"), F.explode(F.slice("lists", first + 1, n_probes)).alias("list"))
        near = near.unionByName(scanned(cut(rest)))
    return V.best(near, queries, k)
