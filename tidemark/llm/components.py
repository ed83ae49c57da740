"""Connected components of a table of links, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: every node hands its smallest neighbour to its larger ones; small star: to its smaller."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    near = both.join(smallest, "a")
    if large:
        out = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its smallest reachable node.

    Alternates large-star and small-star steps until the links are stars around the smallest nodes,
    which takes a number of rounds that is logarithmic in the longest chain.  Each round is a table in the
    shared folder, so lineage stays short and a lost executor costs one round.  An empty table of links
    gives no rows.  Links to itself are ignored.
    """
    links = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        mark = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == state or not mark.n:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = mark
        links = cut(_star(_star(links, True), False))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
