"""Recurring payments and the deterministic backbone they give.

Payments are first reduced to one row per (account, merchant, day, group, amount) with a count, before any
join, so a merchant with a third of all payments spreads out; this table is written once, and cadence,
votes and amounts are all read from it.  Gaps, days of month and weekdays are exact weighted percentiles
over at most one row per calendar day; the median amount, whose distinct values are not bounded, goes
through ``exact_quantiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import next_sunday, period_of
from tidemark.functions.labels import merchant_key
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import cut as write_once

# Groups with scheduled flows, groups with habitual spending, forecast horizons.
RECURRING_GROUPS = ("income", "subscriptions", "utilities")
HABITUAL_GROUPS = ("groceries", "dining", "transport")
HORIZON = {"D": 30, "W": 8}
STEP_DAYS = {"D": 1, "W": 7}
# rows of a task that orders the payments of merchants, and the most tasks: a row takes little in the shuffle and a
# hundred times that when it is sorted, so tasks dealt by bytes would outgrow their memory
PAYMENTS_A_TASK, MOST_TASKS = 200_000, 20_000


def cutoffs(tx: DataFrame, freq: str, n_test: int, strict: bool = False) -> DataFrame:
    """First test period per account; rules may only use earlier days.

    The weekly cutoff is the Sunday label itself, so the days of that week before Sunday still
    count as training.  ``strict`` moves it to the Monday.
    """
    last = period_of(F.max("txn_date"), freq)
    cut = F.date_sub(last, STEP_DAYS[freq] * (n_test - 1))
    if strict and freq == "W":
        cut = F.date_sub(cut, 6)
    return tx.groupBy("account_id").agg(cut.alias("cutoff"))


def payments(tx: DataFrame, cuts: DataFrame, first: bool = False) -> DataFrame:
    """Payments before the cutoff as (account, key, day, group, amount) with ``rows``, written once.

    ``first`` keeps the smallest id of each, which tells what group the first payment of a day has.
    """
    keyed = tx.select("account_id", merchant_key(F.col("counterparty"), F.col("details")).alias("key"), "txn_date", "spending_group", "amount", *(["id"] if first else []))
    counted = keyed.groupBy("account_id", "key", "txn_date", "spending_group", "amount").agg(
        F.count(F.lit(1)).alias("rows"), *([F.min("id").alias("first_id")] if first else []))
    return write_once(counted.join(cuts, "account_id").where(F.col("txn_date") < F.col("cutoff")))


def _cadence(train: DataFrame) -> DataFrame:
    """Per account and key: n, median gap, dispersion, median day of month and weekday, groups."""
    first = F.min_by("spending_group", "first_id") if "first_id" in train.columns else F.min("spending_group")
    days = train.groupBy("account_id", "key", "txn_date").agg(F.sum("rows").alias("rows"), first.alias("group"))
    days = days.repartition(max(1, min(MOST_TASKS, -(-train.count() // PAYMENTS_A_TASK))), "account_id", "key")
    by_day = Window.partitionBy("account_id", "key").orderBy("txn_date")
    gap = F.datediff("txn_date", F.lag("txn_date").over(by_day))
    # a day with several payments adds gaps of 0
    points = days.select("account_id", "key", "txn_date", "group", "rows", gap.alias("gap")).select(
        "account_id", "key", "txn_date", "group",
        F.inline(F.array(
            F.struct(F.col("gap"), F.lit(1).cast("long").alias("gaps"), F.col("rows").alias("rows")),
            F.struct(F.lit(0).alias("gap"), (F.col("rows") - 1).alias("gaps"), F.lit(0).cast("long").alias("rows")),
        )),
    )
    total = F.sum(F.when(F.col("gap").isNotNull(), F.col("gaps")))
    s1, s2 = F.sum(F.col("gap") * F.col("gaps")), F.sum(F.col("gap") * F.col("gap") * F.col("gaps"))
    spread = F.sqrt((s2 - s1 * s1 / total) / F.nullif(total - 1, F.lit(0)))
    return points.groupBy("account_id", "key").agg(
        F.sum("rows").alias("n"),
        F.percentile("gap", 0.5, F.col("gaps")).alias("median_gap"),
        F.coalesce(spread, F.lit(0.0)).alias("gap_stddev"),
        F.percentile(F.day("txn_date"), 0.5, F.col("rows")).cast("int").alias("median_day"),
        F.percentile(F.weekday("txn_date"), 0.5, F.col("rows")).cast("int").alias("median_weekday"),
        F.min_by("group", "txn_date").alias("first_group"),
    )


def _with_amount(stats: DataFrame, train: DataFrame, least: float) -> DataFrame:
    """Median signed amount of the keys still in play."""
    keys = ["account_id", "key"]
    chosen = train.join(stats.select(*keys), keys, "left_semi")
    amounts = exact_quantiles(chosen, keys, "amount", {"amount": 0.5}, freq="rows")
    return stats.join(amounts, keys).where(F.abs("amount") >= least)


def detect_gated(tx: DataFrame, cuts: DataFrame) -> DataFrame:
    """Monthly rules among the scheduled groups: n >= 3, median gap 20..40 days, |amount| >= 1."""
    train = payments(tx.where(F.col("spending_group").isin(*RECURRING_GROUPS)), cuts, first=True)
    stats = _cadence(train).where((F.col("n") >= 3) & F.col("median_gap").between(20, 40))
    return _with_amount(stats, train, 1.0).select(
        "account_id", "key", F.col("first_group").alias("group"), "amount",
        F.col("median_day").alias("day_of_month"), "n",
        F.lit("monthly").alias("cadence"), F.lit(0).alias("weekday"),
    )


def detect_agnostic(tx: DataFrame, cuts: DataFrame, min_n: int = 4, paid: DataFrame | None = None) -> DataFrame:
    """Monthly and weekly rules over all groups, kept by the regularity of their gaps.

    ``paid`` is the table of ``payments`` where it exists already.
    """
    train = (paid or payments(tx, cuts)).where(F.col("key") != "")
    gap = F.col("median_gap")
    monthly, weekly = gap.between(24, 35), gap.between(5, 9)
    stats = _cadence(train).where(
        (F.col("n") >= min_n) & (gap > 0) & (F.col("gap_stddev") / gap < 0.6) & (monthly | weekly)
    )
    keys = ["account_id", "key"]
    votes = (
        train.join(stats.select(*keys), keys, "left_semi")
        .groupBy(*keys, "spending_group").agg(F.sum("rows").alias("votes"))
        .groupBy(*keys)
        .agg(F.min_by("spending_group", F.struct(-F.col("votes"), "spending_group")).alias("group"))
    )
    rules = _with_amount(stats, train, 2.0).join(votes, keys)
    return rules.select(
        "account_id", "key", "group", "amount",
        F.when(monthly, F.col("median_day")).otherwise(0).alias("day_of_month"), "n",
        F.when(monthly, "monthly").otherwise("weekly").alias("cadence"),
        F.when(monthly, 0).otherwise(F.col("median_weekday")).alias("weekday"),
    )


def bounds(series: DataFrame, freq: str, horizon: int = 0) -> DataFrame:
    """First and last period per account, the last moved ``horizon`` periods on."""
    return series.groupBy("account_id").agg(
        F.min("period").alias("start"),
        F.date_add(F.max("period"), horizon * STEP_DAYS[freq]).alias("end"),
    )


def spine(limits: DataFrame, freq: str) -> DataFrame:
    """Every period between the bounds."""
    step = F.expr(f"interval {STEP_DAYS[freq]} day")
    return limits.select("account_id", F.explode(F.sequence("start", "end", step)).alias("period"))


def occurrences(rules: DataFrame, limits: DataFrame) -> DataFrame:
    """Every date a rule fires between the bounds of its account."""
    start, end = F.col("start"), F.col("end")
    months = F.transform(
        F.sequence(F.trunc(start, "MM"), end, F.expr("interval 1 month")),
        lambda m: F.make_date(
            F.year(m), F.month(m), F.least(F.col("day_of_month"), F.day(F.last_day(m)))
        ),
    )
    first = F.date_add(start, F.pmod(F.col("weekday") - F.weekday(start), F.lit(7)))
    weeks = F.when(first <= end, F.sequence(first, end, F.expr("interval 7 day")))
    fires = F.when(F.col("cadence") == "weekly", weeks).otherwise(months)
    return (
        rules.join(limits, "account_id")
        .select("account_id", "key", "cadence", "amount", "start", "end", F.explode(fires).alias("day"))
        .where(F.col("day").between(start, end))
        .drop("start", "end")
    )


def habitual_rates(daily: DataFrame, cuts: DataFrame, freq: str) -> DataFrame:
    """Median per-period spend of each habitual group before the cutoff (long form)."""
    present = [g for g in HABITUAL_GROUPS if f"grp_{g}" in daily.columns]
    before = daily.join(cuts, "account_id").where(F.col("period") < F.col("cutoff"))
    summed = before.groupBy("account_id", period_of(F.col("period"), freq).alias("p")).agg(
        *[F.sum(f"grp_{g}").cast("double").alias(g) for g in present]
    )
    return summed.groupBy("account_id").agg(*[F.median(g).alias(g) for g in present]).unpivot(
        "account_id", present, "group", "rate"
    )


def habitual_residual(tx: DataFrame, rules: DataFrame, cuts: DataFrame, freq: str, paid: DataFrame | None = None) -> DataFrame:
    """Median per-period habitual spend outside the recurring keys, zero periods included."""
    train = (paid or payments(tx, cuts)).where(F.col("spending_group").isin(*HABITUAL_GROUPS))
    rest = train.join(rules.select("account_id", "key"), ["account_id", "key"], "left_anti")
    sums = rest.groupBy("account_id", period_of(F.col("txn_date"), freq).alias("period")).agg(
        F.sum(F.col("amount") * F.col("rows").cast("decimal(12,0)")).cast("double").alias("spend")
    )
    last = period_of(F.date_sub("cutoff", 1), freq)
    limits = (
        sums.groupBy("account_id").agg(F.min("period").alias("start"))
        .join(cuts, "account_id").select("account_id", "start", last.alias("end"))
    )
    return (
        spine(limits, freq).join(sums, ["account_id", "period"], "left")
        .groupBy("account_id").agg(F.median(F.coalesce("spend", F.lit(0.0))).alias("rate"))
        .select("account_id", F.lit("habitual_residual").alias("group"), "rate")
    )


def _bucket(day: Column, freq: str) -> Column:
    # a payment on a Sunday counts to the following week
    return day if freq == "D" else next_sunday(day)


def backbone(limits: DataFrame, rules: DataFrame, habitual: DataFrame, freq: str) -> DataFrame:
    """Expected flow per period: the habitual total plus every rule payment landing in it."""
    scheduled = (
        occurrences(rules, limits)
        .groupBy("account_id", _bucket(F.col("day"), freq).alias("period"))
        .agg(F.sum("amount").alias("scheduled"))
    )
    rates = habitual.groupBy("account_id").agg(F.sum("rate").alias("habitual"))
    none = F.lit(0.0)
    return (
        spine(limits, freq)
        .join(scheduled, ["account_id", "period"], "left")
        .join(rates, "account_id", "left")
        .select(
            "account_id", "period",
            (F.coalesce("habitual", none) + F.coalesce("scheduled", none)).alias("det"),
        )
    )


def largest_rules(rules: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` rules of each account with the largest absolute amount."""
    order = Window.partitionBy("account_id").orderBy(F.desc(F.abs("amount")), "key")
    return rules.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


__all__ = [
    "HABITUAL_GROUPS", "HORIZON", "RECURRING_GROUPS", "STEP_DAYS", "backbone", "bounds", "cutoffs",
    "detect_agnostic", "detect_gated", "habitual_rates", "habitual_residual", "largest_rules",
    "occurrences", "payments", "spine",
]
