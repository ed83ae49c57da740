"""Forecasters without learned weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import ROLLS
from tidemark.operators.folds import expanding_fold


def predictions(rows: DataFrame, model: str, y_pred: Column) -> DataFrame:
    """Long prediction rows of the holdout."""
    return rows.where("is_test").select(
        "account_id", "period", F.lit(model).alias("model"),
        F.col("total_next").alias("y_true"), y_pred.alias("y_pred"),
        F.col("end_balance").alias("anchor"),
    )


def naive(rows: DataFrame, model: str = "baseline") -> DataFrame:
    """The next flow equals the current flow."""
    return predictions(rows, model, F.col("net_flow"))


def choose_window(rows: DataFrame, freq: str) -> DataFrame:
    """Trailing-mean window per account with the least mean fold RMSE (ties: the shorter)."""
    n = F.col("n_train")
    k = F.least(F.lit(5).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(n / 10)))
    folded = rows.where(~F.col("is_test")).withColumn("fold", expanding_fold(F.col("rn"), n, k))

    def error(w: int) -> Column:
        return F.col("total_next") - F.col(f"nf_roll_mean_{w}")

    per_fold = folded.where(F.col("fold").isNotNull()).groupBy("account_id", "fold").agg(
        *[F.sqrt(F.avg(error(w) * error(w))).alias(f"w{w}") for w in ROLLS[freq]]
    )
    scores = per_fold.groupBy("account_id").agg(*[F.avg(f"w{w}").alias(f"w{w}") for w in ROLLS[freq]])
    best = F.array_min(F.array(*[
        F.struct(F.col(f"w{w}").alias("rmse"), F.lit(w).alias("window")) for w in ROLLS[freq]
    ]))
    return scores.select("account_id", best["window"].alias("window"), best["rmse"].alias("cv_rmse"))


def window_mean(freq: str) -> Column:
    """Trailing mean over the chosen window of a row."""
    return F.coalesce(*[F.when(F.col("window") == w, F.col(f"nf_roll_mean_{w}")) for w in ROLLS[freq]])


def moving_average(rows: DataFrame, freq: str, model: str = "baseline") -> DataFrame:
    """Predict the total flow by the trailing mean of the chosen window."""
    return predictions(rows.join(choose_window(rows, freq), "account_id"), model, window_mean(freq))
