"""Exact quantiles whose groups may be arbitrarily large.

``percentile`` keeps every distinct value of a group in one buffer.  That is right for groups
bounded by the calendar (the weeks of one account) and wrong for all accounts of a panel or all
payments to one merchant.  ``exact_quantiles`` first counts equal values (keyed by the value, so a
hot group spreads out), finds by per-bucket counts which narrow value bucket holds each wanted
rank, and ranks only inside those buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_E = 4096  # value buckets per factor e; the number of buckets is bounded by the range


def _bucket(value: Column) -> Column:
    x = value.cast("double")
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * F.lit(float(BUCKETS_PER_E))).cast("long")


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    wanted: dict[str, float | Callable[[Column], Column]],
    freq: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group: one row per ``by``, one double column per wanted.

    ``wanted`` maps output name -> probability, or -> function of the group's row count giving the
    0-based (fractional) position.  Null values are ignored.
    """
    weight = F.sum(freq) if freq else F.count(F.lit(1))
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("__v"))
        .agg(weight.cast("long").alias("__n"))
        .withColumn("__b", _bucket(F.col("__v")))
    )
    buckets = counted.groupBy(*by, "__b").agg(F.sum("__n").alias("__bn"))
    upto = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    placed = buckets.select(
        *by,
        "__b",
        F.coalesce(F.sum("__bn").over(upto), F.lit(0)).alias("__before"),
        "__bn",
        F.sum("__bn").over(whole).alias("__total"),
    )

    def position(spec) -> Column:
        total = F.col("__total")
        return spec(total) if callable(spec) else (total - 1) * F.lit(float(spec))

    ranks = {}
    for out, spec in wanted.items():
        pos = position(spec).cast("double")
        ranks[out] = (F.floor(pos).cast("long"), F.ceil(pos).cast("long"), pos - F.floor(pos))
    start, end = F.col("__before"), F.col("__before") + F.col("__bn")
    holds = F.lit(False)
    for lo, hi, _ in ranks.values():
        holds = holds | ((lo >= start) & (lo < end)) | ((hi >= start) & (hi < end))
    target = placed.where(holds)

    inside = (
        Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = counted.join(target, [*by, "__b"]).withColumn(
        "__first", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    )
    first, last = F.col("__first"), F.col("__first") + F.col("__n")
    picks = []
    for out, (lo, hi, frac) in ranks.items():
        number = F.col("__v").cast("double")
        picks.append(F.max(F.when((lo >= first) & (lo < last), number)).alias(f"__lo_{out}"))
        picks.append(F.max(F.when((hi >= first) & (hi < last), number)).alias(f"__hi_{out}"))
        picks.append(F.max(frac).alias(f"__fr_{out}"))
    chosen = ranked.groupBy(*by).agg(*picks)
    return chosen.select(
        *by,
        *[
            (
                F.col(f"__lo_{out}")
                + (F.col(f"__hi_{out}") - F.col(f"__lo_{out}")) * F.col(f"__fr_{out}")
            ).alias(out)
            for out in wanted
        ],
    )
