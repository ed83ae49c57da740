"""Row numbers and running totals that stay spread out when one group is huge.

A plain ``row_number() over (partition by account order by ...)`` sends a whole account through
one task.  Here the order is cut into nested *levels*: leading columns of the order (a date, then a
block of keys within the date).  Totals are pre-aggregated per level, the running sum of a level stays
inside the level above it, and only the short stretch inside the innermost bucket is sorted row by row.
So a task orders the dates of an account, the blocks of one date, or the rows of one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    levels: Sequence[Sequence[tuple[str, Column]]],
    order: Sequence[str | Column],
    sums: dict[str, str] | None = None,
    row_number: str | None = None,
) -> DataFrame:
    """Add a dense ``row_number`` and running ``sums`` (output name -> input column) per group.

    ``levels`` lists, from the outermost, (name, expression) pairs; sorting by all of them in turn must
    agree with a prefix of ``order``.  Their values must not be null.
    """
    sums = sums or {}
    counted = {"__rows": F.count(F.lit(1)), **{f"__sum_{out}": F.sum(src) for out, src in sums.items()}}
    result = df.select("*", *[expr.alias(name) for level in levels for name, expr in level])
    fine = [*group, *[name for level in levels for name, _ in level]]
    # written once, as each level reads other columns of them and would read ``df`` again
    totals = cut(result.groupBy(*fine).agg(*[total.alias(c) for c, total in counted.items()]))
    parts, above = [], list(group)
    for level in levels:
        names = [name for name, _ in level]
        keys = [*above, *names]
        part = totals.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counted]) if keys != fine else totals
        before = Window.partitionBy(*above).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
        parts.append((keys, part.select(*keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before{c}") for c in counted])))
        above = keys
    # from the innermost level out: its window leaves the rows where the join with the level above wants them
    offsets = parts[-1][1]
    for keys, part in reversed(parts[:-1]):
        outer = part.select(*keys, *[F.col(f"__before{c}").alias(f"__outer{c}") for c in counted])
        offsets = offsets.join(outer, keys).select(
            *fine, *[(F.col(f"__outer{c}") + F.col(f"__before{c}")).alias(f"__before{c}") for c in counted])

    inside = Window.partitionBy(*fine).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = result.join(offsets, fine)
    added = [(F.col(f"__before__sum_{out}") + F.sum(src).over(upto)).alias(out) for out, src in sums.items()]
    if row_number:
        added.append((F.col("__before__rows") + F.row_number().over(inside)).alias(row_number))
    return joined.select(*[F.col(c) for c in df.columns], *added)


def ranked(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with its dense position in a global order, which should be total.

    A range sort deals the order to tasks; the sizes of the ranges, one number for each partition, give the
    offsets.
    """
    ranges = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = {r["__range"]: r["count"] for r in ranges.groupBy("__range").count().collect()}
    starts, total = [], 0
    for i in range(max(sizes, default=0) + 1):
        starts.append(F.lit(total).cast("long"))
        total += sizes.get(i, 0)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn(name, F.element_at(F.array(*starts), F.col("__range") + 1) + place).drop("__range")
