"""Vector tables as the searches take them: usable rows only, equal vectors once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, value: Column, zeros: bool) -> DataFrame:
    """(vec_id, v) of the rows that can take part in a search.

    Left out: null ids, null or empty vectors, vectors with null or non-finite components, all-zero
    vectors unless ``zeros``, and vectors of another length than most (ties: the greater length), as they
    have no inner product with the others.  ``value`` maps a component to what is searched.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.lit(True) if zeros else F.exists("embedding", lambda x: x != 0)
    v = (rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine & some)
         .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: value(x.cast("double"))).alias("v")))
    lengths = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return v.filter(F.size("v") == (lengths[0].n if lengths else 0))


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one row: cls (a 128-bit digest), v, ids (its ``k`` smallest ids in order).

    A search for the k best with ties to smaller ids needs no more of a class, however large it is.
    """
    w = Window.partitionBy("cls").orderBy("vec_id")
    keyed = vectors.withColumn("cls", F.md5(F.col("v").cast("string"))).select("cls", "vec_id", "v")
    first = keyed.dropDuplicates(["cls", "vec_id"]).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    return first.groupBy("cls").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def query_classes(vectors: DataFrame, every: int) -> DataFrame:
    """(query_id, cls) of the rows whose id is divisible by ``every``, repeated rows once."""
    return (vectors.filter(F.col("vec_id") % every == 0)
            .select(F.col("vec_id").alias("query_id"), F.md5(F.col("v").cast("string")).alias("cls")).distinct())


def best(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from ``found`` (qcls, score, ids): the k best of each query, itself excluded.

    The k + 1 best of a query vector are found once and handed to all queries that have it.
    """
    per = found.select("qcls", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), F.asc("vec_id")]
    top = (per.withColumn("n", F.row_number().over(Window.partitionBy("qcls").orderBy(*order))).filter(F.col("n") <= k + 1).drop("n"))
    own = queries.join(top.withColumnRenamed("qcls", "cls"), "cls").filter(F.col("query_id") != F.col("vec_id"))
    # a query vector has at most k + 1 candidates here, so ranks are counted among these few
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def matrix(column, dtype=np.float64) -> np.ndarray:
    """Rows of a pandas column of arrays as a matrix."""
    return np.array(column.tolist(), dtype=dtype)
