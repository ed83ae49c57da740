"""Scores per account and model, and their summaries over the panel.

Predictions are long rows: account_id, period, model, y_true, y_pred, anchor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import cut

# Thresholds below which a scale or a holdout counts as flat.
FLAT_SCALE = 1e-9
FLAT_VARIANCE = 1e-6


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; on a flat series 1 if every prediction is exact, else 0."""
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, 1.0).otherwise(0.0))


def error_aggregates(y: Column, p: Column, prefix: str = "") -> list[Column]:
    return [
        F.sqrt(F.avg((y - p) * (y - p))).alias(f"{prefix}rmse"),
        F.avg(F.abs(y - p)).alias(f"{prefix}mae"),
    ]


def flow_metrics(preds: DataFrame, by: Sequence[str] = ("account_id", "model")) -> DataFrame:
    y, p = F.col("y_true"), F.col("y_pred")
    return preds.groupBy(*by).agg(*error_aggregates(y, p), r2(y, p).alias("r2"))


def balance_metrics(preds: DataFrame, by: Sequence[str] = ("account_id", "model")) -> DataFrame:
    """One step ahead from the actual balance: both sides are anchor + flow."""
    true, pred = F.col("anchor") + F.col("y_true"), F.col("anchor") + F.col("y_pred")
    return preds.groupBy(*by).agg(*error_aggregates(true, pred, "balance_"))


def naive_scale(rows: DataFrame) -> DataFrame:
    """Mean absolute one-step change of the training flow per account, with its fallbacks."""
    train = rows.where(~F.col("is_test"))
    change = F.abs(F.col("net_flow") - F.lag("net_flow").over(
        Window.partitionBy("account_id").orderBy("period")))
    sums = train.select("account_id", "net_flow", change.alias("__change")).groupBy("account_id").agg(
        F.coalesce(F.avg("__change"), F.lit(0.0)).alias("__step"),
        F.avg(F.abs("net_flow")).alias("__level"),
    )
    level = F.when(F.col("__level") == 0, 1.0).otherwise(F.col("__level"))
    return sums.select(
        "account_id", F.when(F.col("__step") < FLAT_SCALE, level).otherwise(F.col("__step")).alias("scale")
    )


def mase(preds: DataFrame, scales: DataFrame) -> DataFrame:
    mae = preds.groupBy("account_id", "model").agg(
        F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    return mae.join(scales, "account_id").select(
        "account_id", "model", (F.col("mae") / F.col("scale")).alias("mase"))


def holdout_scores(rows: DataFrame, models: dict[str, Column]) -> DataFrame:
    """RMSE, MAE, R2 and MASE of prediction columns, one row per account and model.

    One pass: training scale and holdout errors come out of a single aggregate on rows that are
    already partitioned by account.
    """
    by_period = Window.partitionBy("account_id").orderBy("period")
    change = F.abs(F.col("net_flow") - F.lag("net_flow").over(by_period))
    test, y = F.col("is_test"), F.col("total_next")
    slim = rows.select(
        "account_id", "is_test", "net_flow", "total_next", change.alias("__change"),
        *[p.alias(f"__p{i}") for i, p in enumerate(models.values())],
    )
    aggs = [
        F.coalesce(F.avg(F.when(~test, F.col("__change"))), F.lit(0.0)).alias("__step"),
        F.avg(F.when(~test, F.abs("net_flow"))).alias("__level"),
    ]
    for i in range(len(models)):
        true, pred = F.when(test, y), F.when(test, F.col(f"__p{i}"))
        aggs += [*error_aggregates(true, pred, f"__{i}_"), r2(true, pred).alias(f"__{i}_r2")]
    level = F.when(F.col("__level") == 0, 1.0).otherwise(F.col("__level"))
    scale = F.when(F.col("__step") < FLAT_SCALE, level).otherwise(F.col("__step"))
    long = [
        F.struct(
            F.lit(name).alias("model"), F.col(f"__{i}_rmse").alias("rmse"), F.col(f"__{i}_mae").alias("mae"),
            F.col(f"__{i}_r2").alias("r2"), (F.col(f"__{i}_mae") / scale).alias("mase"),
        )
        for i, name in enumerate(models)
    ]
    return slim.groupBy("account_id").agg(*aggs).select("account_id", F.inline(F.array(*long)))


def pinball(y: Column, q: Column, alpha: float) -> Column:
    d = y - q
    return F.avg(F.greatest(alpha * d, (alpha - 1) * d))


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(y.between(lo, hi).cast("double"))


def drop_flat_accounts(preds: DataFrame) -> DataFrame:
    """Per account: holdout variance and whether it is scored; a reason where it is not."""
    stats = preds.groupBy("account_id").agg(F.var_pop("y_true").alias("variance"))
    flat = F.col("variance") < FLAT_VARIANCE
    return stats.withColumn("is_scored", ~flat).withColumn(
        "skip_reason", F.when(flat, "flat holdout"))


def account_distribution(scores: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles of a score over all accounts and the share above 0, per ``by``."""
    quarters = exact_quantiles(scores, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    shares = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_accounts"),
        (100 * F.avg((F.col(value) > 0).cast("double"))).alias("pct_positive"),
    )
    return shares.join(quarters, list(by))


def benchmark_summary(scores: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Per model over all accounts: median MASE and R2, share beating the naive scale, best model.

    ``scores`` has account_id, model, mase, r2; it is read several times, so it is written to the
    shared folder first.  The summary has one row per model, so marking the best of them compares
    a handful of rows.
    """
    scores = cut(scores.select("account_id", "model", "mase", "r2"))
    errors = exact_quantiles(scores, ["model"], "mase", {"median_mase": 0.5})
    fits = exact_quantiles(scores, ["model"], "r2", {"median_r2": 0.5})
    beats = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_clients"),
        (100 * F.avg((F.col("mase") < 1.0).cast("double"))).alias("pct_beats_naive"),
    )
    table = beats.join(errors, "model").join(fits, "model")
    strong = F.when(F.col("model") != baseline, F.struct("median_mase", "model"))
    every = Window.partitionBy(F.lit(0))
    return table.withColumn("is_best", F.struct("median_mase", "model") == F.min(strong).over(every))


def track_comparison(scores: DataFrame, tracks: Sequence[str], value: str = "r2") -> DataFrame:
    """Median score over accounts, one row per model and one column per track."""
    medians = exact_quantiles(scores, ["model", "track"], value, {"score": 0.5})
    return medians.groupBy("model").pivot("track", list(tracks)).agg(F.first("score"))
