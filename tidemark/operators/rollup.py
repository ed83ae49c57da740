"""Transactions to gap-filled daily and weekly series.

The transaction side is one hash aggregate (partial sums before the shuffle), so an account with a
third of all rows costs no more than any other after the map side.  Everything later works on at
most one row per account and calendar day, a group bounded by the calendar.  A weekly series is summed
from the transactions by week; days are only filled for a daily one.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import week_ending
from tidemark.functions.labels import SPENDING_GROUPS

ALL_GROUPS = tuple(sorted(SPENDING_GROUPS))
NOT_SUMMED = ("account_id", "period", "end_balance")


def _adder(kind: T.DataType):
    """Functions to and from what is summed.  Decimals are summed as whole numbers of their last digit, which
    stay in the registers of a hash aggregate; a sum beyond a long fails instead of wrapping."""
    if not isinstance(kind, T.DecimalType):
        return (lambda c: c), (lambda c: F.coalesce(c, F.lit(0)).cast("decimal(28,4)"))
    unit = Decimal(10) ** kind.scale
    out = f"decimal(28,{max(kind.scale, 4)})"
    return (lambda c: (c * F.lit(unit)).cast("long")), (lambda c: (F.coalesce(c, F.lit(0)).cast("decimal(20,0)") * F.lit(1 / unit)).cast(out))


def daily_flows(
    tx: DataFrame,
    groups: Sequence[str] = ALL_GROUPS,
    income_is_credits: bool = False,
    freq: str = "D",
) -> DataFrame:
    """One row per account and day with transactions; with ``freq`` "W" per week, labelled by its Sunday.

    Columns: net_flow, txn_count, debit_sum, credit_sum, ``grp_<g>``; with a ``balance`` column in
    ``tx`` also end_balance (last non-null by id) and opening (balance before the day's first row).
    ``income_is_credits`` makes ``grp_income`` the sum of all credits whatever their label.
    """
    to, back = _adder(tx.schema["amount"].dataType)
    units, group = F.col("__units"), F.col("spending_group")
    tx = tx.withColumn("__units", to(F.col("amount")))
    sums = {"net_flow": units, "debit_sum": F.when(units < 0, -units), "credit_sum": F.when(units >= 0, units)}
    for g in groups:
        hit = (units > 0) if income_is_credits and g == "income" else (group == g)
        sums[f"grp_{g}"] = F.when(hit, units)
    aggs = [F.count(F.lit(1)).alias("txn_count"), *[F.sum(c).alias(name) for name, c in sums.items()]]
    if "balance" in tx.columns:
        order = "id" if freq == "D" else "struct(txn_date, id)"
        aggs.append(F.expr(f"max_by(balance, {order}) filter (where balance is not null)").alias("end_balance"))
        aggs.append(F.expr(f"min_by(balance - amount, {order})").alias("opening"))
    period = F.col("txn_date") if freq == "D" else week_ending(F.col("txn_date"))
    days = tx.groupBy("account_id", period.alias("period")).agg(*aggs)
    kept = [c for c in ("end_balance", "opening") if c in days.columns]
    amounts = {name: back(F.col(name)).alias(name) for name in sums}
    order = ["net_flow", "txn_count", *[name for name in sums if name != "net_flow"]]
    return days.select("account_id", "period", *[amounts.get(name, F.col(name)) for name in order], *kept)


def fill_calendar(daily: DataFrame, step: int = 1) -> DataFrame:
    """Every calendar day (every ``step``-th) from an account's first to its last: sums 0, balance carried forward.

    Each row is repeated up to the period before the next one, so no calendar join is needed.
    """
    by_day = Window.partitionBy("account_id").orderBy("period")
    following = F.lead("period").over(by_day)
    carried = [c for c in daily.columns if c not in NOT_SUMMED and c != "opening"]
    spans = daily.withColumn(
        "__days", F.sequence("period", F.coalesce(F.date_sub(following, step), F.col("period")), F.make_dt_interval(F.lit(step)))
    )
    if "end_balance" in daily.columns:
        upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        spans = spans.withColumn("end_balance", F.last("end_balance", ignorenulls=True).over(upto))
    days = spans.select("*", F.explode("__days").alias("__day"))
    own = F.col("__day") == F.col("period")
    kept = [
        F.when(own, F.col(c)).otherwise(F.lit(0).cast(daily.schema[c].dataType)).alias(c)
        for c in carried
    ]
    out = [F.col("account_id"), F.col("__day").alias("period"), *kept]
    if "end_balance" in daily.columns:
        out.append(F.col("end_balance"))
    if "opening" in daily.columns:
        out.append(F.when(own, F.col("opening")).alias("opening"))
    return days.select(*out)


def balance_flow(daily: DataFrame) -> DataFrame:
    """net_flow from the authoritative balance: its day-to-day change; first day against opening."""
    by_day = Window.partitionBy("account_id").orderBy("period")
    before = F.lag("end_balance").over(by_day)
    return daily.withColumn(
        "net_flow",
        F.col("end_balance") - F.when(before.isNull(), F.col("opening")).otherwise(before),
    )


def opening_balance(tx: DataFrame) -> DataFrame:
    """Balance before an account's first transaction by (date, id)."""
    return tx.groupBy("account_id").agg(
        F.min_by(F.col("balance") - F.col("amount"), F.struct("txn_date", "id")).alias("opening")
    )


def reconstruct_balance(series: DataFrame, start: Column | float = 0.0) -> DataFrame:
    """end_balance = start + running net_flow within the account."""
    upto = (
        Window.partitionBy("account_id")
        .orderBy("period")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    begin = start if isinstance(start, Column) else F.lit(start).cast(series.schema["net_flow"].dataType)
    return series.withColumn("end_balance", begin + F.sum("net_flow").over(upto))


def daily_series(tx: DataFrame, groups: Sequence[str] = ALL_GROUPS, tasks: int | None = None) -> DataFrame:
    """Gap-filled daily series of a labelled ledger; ``tasks`` deals the accounts to so many tasks.

    With statement balances the end-of-day balance is read from them.  Without, it is rebuilt from
    an opening of 0 on the daily rows, which spares sorting the transactions.
    """
    days = daily_flows(tx, groups)
    filled = fill_calendar(days.repartition(tasks, "account_id") if tasks else days)
    return filled.drop("opening") if "balance" in tx.columns else reconstruct_balance(filled)


def weekly_series(tx: DataFrame, groups: Sequence[str] = ALL_GROUPS, tasks: int | None = None) -> DataFrame:
    """``weekly`` of ``daily_series`` without the days: transactions are summed by week and only weeks are filled;
    ``tasks`` deals the accounts to so many tasks."""
    weeks = daily_flows(tx, groups, freq="W")
    filled = fill_calendar(weeks.repartition(tasks, "account_id") if tasks else weeks, step=7)
    if "balance" in tx.columns:
        return filled.drop("opening").where(F.col("end_balance").isNotNull())
    return reconstruct_balance(filled)


def panel_daily(tx: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Daily series of a bank panel: all credits as income, net_flow from the balance column."""
    daily = fill_calendar(daily_flows(tx, groups, income_is_credits=True))
    return balance_flow(daily).drop("opening")


def weekly(daily: DataFrame) -> DataFrame:
    """Monday-to-Sunday weeks labelled by their Sunday; weeks without a balance are dropped."""
    summed = [c for c in daily.columns if c not in NOT_SUMMED]
    return (
        daily.groupBy("account_id", week_ending(F.col("period")).alias("__week"))
        .agg(
            *[F.sum(c).alias(c) for c in summed],
            F.expr("max_by(end_balance, period) filter (where end_balance is not null)").alias(
                "end_balance"
            ),
        )
        .where(F.col("end_balance").isNotNull())
        .withColumnRenamed("__week", "period")
    )


def at_frequency(daily: DataFrame, freq: str) -> DataFrame:
    return daily if freq == "D" else weekly(daily)


def core_view(daily: DataFrame) -> DataFrame:
    """Spendable-cash view: savings taken out of the flow, balance rebuilt from the opening."""
    by_day = Window.partitionBy("account_id").orderBy("period")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    has_savings = "grp_savings" in daily.columns
    savings = F.coalesce(F.col("grp_savings"), F.lit(0)) if has_savings else F.lit(0)
    opening = F.first(F.col("end_balance") - F.col("net_flow")).over(whole)
    core = F.col("net_flow") - savings
    out = daily.select(
        *[c for c in daily.columns if c not in ("net_flow", "end_balance")],
        core.alias("net_flow"),
        (opening + F.sum(core).over(upto)).alias("end_balance"),
    )
    if has_savings:
        out = out.withColumn("grp_savings", F.lit(0).cast(daily.schema["grp_savings"].dataType))
    return out
