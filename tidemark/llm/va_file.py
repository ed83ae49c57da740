"""Exact top-k inner products with a vector-approximation file.

Every vector is quantised to one small cell per dimension.  The cells of a block of vectors give an
upper and a lower bound of each inner product with a query.  The first phase scans only cells: the k-th
best lower bound of a query over all blocks is a floor for its result, and what has its upper bound below
the floor is out.  The second phase reads exact vectors of the rest in the order of their upper bounds
until the next bound is below the k-th best score found.

Blocks and packs of queries have a bounded size; every pack meets every block in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vectors as V
from tidemark.llm.common import cut

CELLS = 64
BLOCK_ROWS = 4096
PACK_ROWS = 1024
#: Below this magnitude sums of products of 64-bit integers cannot overflow for up to 2^15 dimensions.
SAFE = 1 << 23
LONG = np.iinfo(np.int64)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; values too large for 64-bit arithmetic are summed exactly, then held to long."""
    if max(np.abs(rows.astype(np.float64)).max(initial=0), np.abs(query.astype(np.float64)).max(initial=0)) < SAFE:
        return rows @ query
    exact = [sum(int(a) * int(b) for a, b in zip(r, query)) for r in rows]
    return np.array([min(max(s, int(LONG.min)), int(LONG.max)) for s in exact], np.int64)


def _dealt(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """``df`` with a number from 0 that deals it in parts of about ``rows`` rows, and how many there are."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn(name, F.pmod(F.xxhash64("cls"), F.lit(n)).cast("int")), n


def _each(name: str, n: int):
    """Every number below ``n``: a row for each part of the other side that it meets."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest inner products of floor(scale * x) vectors.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but those with
    the query's own id; ties go to smaller ids.  Rows that cannot take part are named in
    ``vectors.usable`` (zero vectors do take part).  Repeated rows count once.  Components beyond the
    range of long are held to it, and so are scores.  An empty table, or a single row, gives no rows.
    Further columns are ignored.
    """
    usable = cut(V.usable(embeddings, lambda x: F.floor(x * scale).cast("long"), zeros=True))
    queries = cut(V.query_classes(usable, every))
    every_class = cut(V.classes(usable, k + 1))
    limits = every_class.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").collect()
    low = np.array([r.lo for r in limits], np.float64)
    width = np.maximum((np.array([r.hi for r in limits], np.float64) - low) / CELLS, 1e-9)
    edge = float(np.max(np.abs(low), initial=1) + CELLS * np.max(width, initial=1))

    def block_file(pdf: pd.DataFrame) -> pd.DataFrame:
        exact = V.matrix(pdf["v"], np.int64)
        cells = np.clip(np.floor((exact - low) / width), 0, CELLS - 1).astype(np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "n": [len(pdf)], "cls": [pdf["cls"].tolist()],
                             "ids": [pdf["ids"].tolist()], "cells": [cells.tobytes()], "exact": [exact.tobytes()]})

    in_blocks, n_blocks = _dealt(every_class, BLOCK_ROWS, "block")
    file = cut(in_blocks.groupBy("block").applyInPandas(
        block_file, "block int, n int, cls array<string>, ids array<array<long>>, cells binary, exact binary"))
    asked = every_class.join(queries.select("cls").distinct(), "cls", "left_semi").select("cls", "v")
    in_packs, n_packs = _dealt(asked, PACK_ROWS, "pack")
    packs = cut(in_packs)

    def scan(key, blocks: pd.DataFrame, pack: pd.DataFrame) -> pd.DataFrame:
        cols = ["qcls", "block", "at", "upper", "lower", "ids_n"]
        if not len(blocks) or not len(pack):
            return pd.DataFrame({c: [] for c in cols})
        n = int(blocks["n"].iloc[0])
        cells = np.frombuffer(blocks["cells"].iloc[0], np.uint8).reshape(n, -1)
        lower_edge = low + cells * width
        upper_edge = lower_edge + width
        slack = 1e-9 * edge * max(1, len(low))
        out = []
        qs, names = V.matrix(pack["v"], np.float64), pack["cls"].tolist()
        weight = np.frombuffer(blocks["copies"].iloc[0], np.int32)
        for i in range(0, len(qs), 128):
            q = qs[i:i + 128]
            pos, neg = np.maximum(q, 0), np.minimum(q, 0)
            margin = slack * np.maximum(1, np.abs(q).max(axis=1, initial=1))[:, None]
            upper = pos @ upper_edge.T + neg @ lower_edge.T + margin
            lower = pos @ lower_edge.T + neg @ upper_edge.T - margin
            for j in range(len(q)):
                lb, ub = lower[j], upper[j]
                order = np.argsort(-lb)[:k + 1]
                got = np.searchsorted(np.cumsum(weight[order]), k + 1)  # copies of one vector fill several ranks
                floor = lb[order[got]] if got < len(order) else -np.inf
                at = np.flatnonzero(ub >= floor)
                out.append(pd.DataFrame({"qcls": names[i + j], "block": key[0], "at": at, "upper": ub[at], "lower": lb[at], "ids_n": weight[at]}))
        return pd.concat(out)

    cells = (file.select("block", "n", "cells", F.transform("ids", lambda x: F.size(x)).alias("sizes"))
             .select("block", _each("pack", n_packs), "n", "cells", _pack_ints("sizes").alias("copies")))
    asked_of = packs.select(_each("block", n_blocks), "pack", "cls", "v")
    survivors = cut(cells.groupBy("block", "pack").cogroup(asked_of.groupBy("block", "pack")).applyInPandas(
        scan, "qcls string, block int, at int, upper double, lower double, ids_n int"))
    # the floor of each query: the lower bound at which k + 1 rows are certain
    w = Window.partitionBy("qcls").orderBy(F.desc("lower"), "block", "at")
    nth = survivors.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    running = nth.withColumn("rows", F.sum("ids_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    floors = running.filter(F.col("rows") >= k + 1).groupBy("qcls").agg(F.max("lower").alias("floor"))
    left = survivors.join(floors, "qcls", "left").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    asked_for = (left.groupBy("qcls", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("upper")).alias("minus_upper"), "at"))).alias("visits"), F.first("floor").alias("floor"))
                 .join(packs.select(F.col("cls").alias("qcls"), "v", "pack"), "qcls"))

    def visit(key, blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(blocks) and len(asked):
            n = int(blocks["n"].iloc[0])
            exact = np.frombuffer(blocks["exact"].iloc[0], np.int64).reshape(n, -1)
            ids = blocks["ids"].iloc[0]
            for name, v, visits, floor in zip(asked["qcls"], asked["v"], asked["visits"], asked["floor"]):
                q = np.asarray(v, np.int64)
                known = -np.inf if floor is None or floor != floor else floor
                seen: list[int] = []
                for begin in range(0, len(visits), 32):
                    part = visits[begin:begin + 32]
                    if -part[0]["minus_upper"] < known:
                        break  # no bound that follows can reach the k-th best
                    at = np.array([x["at"] for x in part])
                    for a, s in zip(at.tolist(), inner(exact[at], q).tolist()):
                        rows.append((name, s, list(ids[a])))
                        seen.extend([s] * len(ids[a]))
                    if len(seen) > k:
                        seen = sorted(seen, reverse=True)[:k + 1]
                        known = max(known, float(seen[k]))
        return pd.DataFrame(rows, columns=["qcls", "score", "ids"])

    exact = file.select("block", _each("pack", n_packs), "n", "ids", "exact").join(
        asked_for.select("block", "pack").distinct(), ["block", "pack"], "left_semi")
    found = exact.groupBy("block", "pack").cogroup(asked_for.groupBy("block", "pack")).applyInPandas(visit, "qcls string, score long, ids array<long>")
    return V.best(found, queries, k)


def _pack_ints(column: str):
    """An array of small integers as little-endian int32 bytes, which pandas hands over as they are."""
    hexed = F.transform(column, lambda x: F.concat(F.lpad(F.hex(x), 2, "0"), F.lit("000000")))
    return F.unhex(F.array_join(hexed, ""))


#: DuckDB twin of the query.
SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""
