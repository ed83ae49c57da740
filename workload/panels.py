"""Series and feature rows of the fixtures, shared by the model queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import week_ending
from tidemark.operators import features as X
from tidemark.operators import folds as O
from tidemark.operators import recurring as N
from tidemark.operators import rollup as R
from workload import adapters as A

N_TEST = 12
# accounts of a task that fills their days or weeks, and the least tasks: periods take little in the shuffle and many
# times that when they are filled and summed, so tasks dealt by bytes would outgrow their memory
ACCOUNTS_A_TASK, LEAST_TASKS = {"D": 250, "W": 1000}, 8


def _tasks(spark: SparkSession, sf: str, freq: str) -> int:
    return max(LEAST_TASKS, -(-A.accounts(spark, sf) // ACCOUNTS_A_TASK[freq]))


def daily_panel(spark: SparkSession, sf: str) -> DataFrame:
    return R.daily_series(A.ledger_flows(spark, sf), tasks=_tasks(spark, sf, "D"))


def weekly_panel(spark: SparkSession, sf: str) -> DataFrame:
    return R.weekly_series(A.ledger_flows(spark, sf), tasks=_tasks(spark, sf, "W"))


def weekly_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Direct-target weekly rows of every account."""
    return X.model_rows(weekly_panel(spark, sf), "W")


def weekly_split(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    rows, names = weekly_rows(spark, sf)
    return O.temporal_split(rows, N_TEST), names


def narrowed(rows: DataFrame, names: list[str], used: Sequence[str] | None) -> DataFrame:
    """Rows without the features (``names``) that a query does not use; all of them if ``used`` is None."""
    return rows if used is None else rows.drop(*[c for c in names if c not in used])


def event_daily(spark: SparkSession, sf: str) -> DataFrame:
    tx = A.ledger_events(spark, sf).withColumn(
        "spending_group", F.when(F.col("amount") > 0, "income").otherwise("shopping"))
    return R.daily_series(tx, ("income", "shopping"))


def planted_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return A.ledger_planted(spark, sf).select("account_id", week_ending(F.col("txn_date")).alias("period"))


def gated_backbone(tx: DataFrame, daily: DataFrame, series: DataFrame, freq: str, n_test: int = N_TEST) -> DataFrame:
    cuts = N.cutoffs(tx, freq, n_test)
    rules, habit = N.detect_gated(tx, cuts), N.habitual_rates(daily, cuts, freq)
    return N.backbone(N.bounds(series, freq, N.HORIZON[freq]), rules, habit, freq)
