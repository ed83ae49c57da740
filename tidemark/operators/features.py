"""Backward-looking features and the next-period target.

All windows share one partitioning and order, so the panel is shuffled and sorted once.  A window
holds at most the periods of one account, a group bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Feature groups, lags, windows and seasonal settings per frequency.
SPEND_GROUPS = ("groceries", "dining", "transport", "shopping", "subscriptions", "utilities",
                "savings", "income")
LAGS = {"D": (1, 2, 3, 7, 14), "W": (1, 2, 3, 4, 8)}
ROLLS = {"D": (3, 7, 14, 30), "W": (4, 8, 12)}
GROUP_ROLLS = {"D": (7, 30), "W": (4, 12)}
MONTH_PERIOD = {"D": 30.44, "W": 4.345}
HARMONICS = {"D": 3, "W": 2}

FRAME = ("net_flow", "end_balance", "total_next", "det_next", "y")


def _by_period() -> Window:
    return Window.partitionBy("account_id").orderBy("period")


def _full(value: Column, k: int) -> Column:
    """Null until ``k`` periods have been seen."""
    return F.when(F.col("t") >= k - 1, value)


def feature_names(columns: Sequence[str], freq: str, with_backbone: bool = False) -> list[str]:
    """Feature columns in model order, for a series with these columns."""
    names = ["dow", "is_weekend"] if freq == "D" else []
    names.append("month")
    for h in range(1, HARMONICS[freq] + 1):
        names += [f"fourier_sin_{h}", f"fourier_cos_{h}"]
    names += [f"nf_lag_{k}" for k in LAGS[freq]]
    for k in ROLLS[freq]:
        names += [f"nf_roll_mean_{k}", f"nf_roll_std_{k}", f"nf_roll_sum_{k}"]
    names.append("txn_roll_mean")
    names += [f"{g}_roll{k}" for g in SPEND_GROUPS if f"grp_{g}" in columns for k in GROUP_ROLLS[freq]]
    names += ["periods_since_income", "balance_lag_1"]
    return names + (["expected_flow", "expected_flow_next"] if with_backbone else [])


def calendar_columns(period: Column, t: Column, freq: str) -> dict[str, Column]:
    """Calendar and Fourier features of a period at position ``t``."""
    out = {}
    if freq == "D":
        out["dow"] = F.weekday(period).cast("double")
        out["is_weekend"] = (F.weekday(period) >= 5).cast("double")
    out["month"] = F.month(period).cast("double")
    for h in range(1, HARMONICS[freq] + 1):
        angle = t.cast("double") * F.lit(2 * math.pi * h / MONTH_PERIOD[freq])
        out[f"fourier_sin_{h}"] = F.sin(angle)
        out[f"fourier_cos_{h}"] = F.cos(angle)
    return out


def feature_matrix(series: DataFrame, freq: str, det: DataFrame | None = None) -> DataFrame:
    """One row per period with every feature (null in the warm-up) and the carried series columns.

    ``det`` (account_id, period, det) adds the backbone signals.
    """
    if det is not None:
        series = series.join(det, ["account_id", "period"], "left")
    w = _by_period()
    flow, balance = F.col("net_flow"), F.col("end_balance")
    groups = [g for g in SPEND_GROUPS if f"grp_{g}" in series.columns]
    typed = series.select(
        "account_id", "period",
        *[F.col(c).cast("double").alias(c) for c in
          ("net_flow", "end_balance", "txn_count", *[f"grp_{g}" for g in groups])],
        *([F.col("det")] if det is not None else []),
        (F.row_number().over(w) - 1).alias("t"),
        F.count(F.lit(1)).over(Window.partitionBy("account_id")).alias("n_periods"),
    )

    def trailing(k: int) -> Window:
        return w.rowsBetween(-(k - 1), 0)

    t = F.col("t")
    cols = calendar_columns(F.col("period"), t, freq)
    for k in LAGS[freq]:
        cols[f"nf_lag_{k}"] = F.lag(flow, k).over(w)
    for k in ROLLS[freq]:
        cols[f"nf_roll_mean_{k}"] = _full(F.avg(flow).over(trailing(k)), k)
        cols[f"nf_roll_std_{k}"] = _full(F.stddev_samp(flow).over(trailing(k)), k)
        cols[f"nf_roll_sum_{k}"] = _full(F.sum(flow).over(trailing(k)), k)
    shortest = ROLLS[freq][0]
    cols["txn_roll_mean"] = _full(F.avg("txn_count").over(trailing(shortest)), shortest)
    for g in groups:
        for k in GROUP_ROLLS[freq]:
            cols[f"{g}_roll{k}"] = _full(F.sum(f"grp_{g}").over(trailing(k)), k)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    income = F.col("grp_income") > 0 if "income" in groups else F.lit(False)
    seen = F.last(F.when(income, t), ignorenulls=True).over(upto)
    cols["periods_since_income"] = (t - F.coalesce(seen, F.lit(-1))).cast("double")
    cols["balance_lag_1"] = F.lag(balance).over(w)
    if det is not None:
        cols["expected_flow"] = F.col("det")
        cols["expected_flow_next"] = F.lead("det").over(w)
    carried = [c for c in typed.columns if c not in cols]
    return typed.select(*carried, *[c.alias(name) for name, c in cols.items()])


def with_target(matrix: DataFrame, mode: str = "total") -> DataFrame:
    """Add total_next, det_next and the target ``y`` (total flow, or flow minus backbone)."""
    w = _by_period()
    det_next = F.lead("det").over(w) if "det" in matrix.columns else F.lit(0.0)
    out = matrix.withColumn("total_next", F.lead("net_flow").over(w)).withColumn("det_next", det_next)
    target = F.col("total_next") - F.col("det_next") if mode == "residual" else F.col("total_next")
    return out.withColumn("y", target)


def complete_cases(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose features, target and frame are all known; adds the count left per account.

    The flag goes through the counting window before it is filtered on, so the optimizer sees a
    filter on one column and not on every feature (its constraint inference would otherwise grow
    exponentially with the number of features).
    """
    known = reduce(and_, [F.col(c).isNotNull() for c in dict.fromkeys([*features, *FRAME])])
    counted = rows.withColumn("__known", known).withColumn(
        "n_rows", F.count_if("__known").over(Window.partitionBy("account_id")))
    return counted.where("__known").drop("__known")


def length_gate(rows: DataFrame, min_periods: int, min_rows: int) -> DataFrame:
    """Accounts with enough periods in the series and enough complete rows."""
    return rows.where((F.col("n_periods") >= min_periods) & (F.col("n_rows") >= min_rows))


def model_rows(
    series: DataFrame, freq: str, mode: str = "total", det: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """Complete feature rows with target, and the names of the feature columns."""
    names = feature_names(series.columns, freq, det is not None)
    rows = complete_cases(with_target(feature_matrix(series, freq, det), mode), names)
    keep = ["account_id", "period", "t", "n_periods", "n_rows", *names,
            *[c for c in FRAME if c not in names]]
    return rows.select(*keep), names


def pooled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """All accounts as one training table: missing features become 0, the account is the group."""
    return rows.fillna(0.0, subset=list(features)).withColumn("group_id", F.col("account_id"))
