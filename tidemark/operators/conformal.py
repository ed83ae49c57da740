"""Conformal bands: prequential or calibration-account residuals, scaled by recent volatility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles

# Fan levels, the volatility column and the bounds of its multiplier.
LEVELS = (0.5, 0.7, 0.8, 0.9, 0.95)
SIGMA = "nf_roll_std_4"
LOWEST, HIGHEST = 0.6, 1.6


def volatility(ref: Column, value: Column | None = None) -> Column:
    """Bounded volatility multiplier; 1 where the series has no volatility column."""
    if value is None:
        return F.lit(1.0)
    ratio = F.abs(F.coalesce(value, F.lit(0.0))) / F.greatest(ref, F.lit(1.0))
    return F.least(F.greatest(ratio, F.lit(LOWEST)), F.lit(HIGHEST))


def reference_volatility(rows: DataFrame, sigma: str = SIGMA) -> DataFrame:
    """Median absolute volatility of each account's training rows."""
    return rows.where(~F.col("is_test")).groupBy("account_id").agg(
        F.median(F.abs(F.col(sigma))).alias("ref"))


def _position(n: Column, level: float) -> Column:
    """0-based position of the conformal quantile among n scores."""
    return (n - 1) * F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(level)) / n)


def margins(scores: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Margin per account and level from (account_id, ref, score); one account has at most one
    score per period."""
    sorted_scores = scores.groupBy("account_id").agg(
        F.first("ref").alias("ref"), F.sort_array(F.collect_list("score")).alias("s"))
    sized = sorted_scores.withColumn("n", F.size("s"))
    options = []
    for level in levels:
        pos = _position(F.col("n"), level)
        low = F.element_at("s", (F.floor(pos) + 1).cast("int"))
        high = F.element_at("s", (F.ceil(pos) + 1).cast("int"))
        margin = low + (high - low) * (pos - F.floor(pos))
        options.append(F.struct(F.lit(level).alias("level"), margin.alias("margin")))
    return sized.select("account_id", "ref", F.inline(F.array(*options)))


def prequential_spec(
    rows: DataFrame, residuals: DataFrame, levels: Sequence[float] = LEVELS, sigma: str | None = SIGMA
) -> DataFrame:
    """Spec (account_id, ref, level, margin) from one-step residuals of the training rows."""
    if sigma is None:
        scores = residuals.select("account_id", F.lit(1.0).alias("ref"), F.abs("residual").alias("score"))
        return margins(scores, levels)
    ref = reference_volatility(rows, sigma)
    scores = (
        residuals.join(rows.select("account_id", "period", sigma), ["account_id", "period"])
        .join(ref, "account_id")
        .select("account_id", "ref", (F.abs("residual") / volatility(F.col("ref"), F.col(sigma))).alias("score"))
    )
    return margins(scores, levels)


def global_spec(calibration: DataFrame, levels: Sequence[float] = LEVELS, sigma: str = SIGMA) -> DataFrame:
    """One spec for all accounts from calibration rows with columns y, prediction and ``sigma``."""
    size = calibration.select(F.abs(F.col(sigma)).alias("v"), "y", "prediction")
    ref = exact_quantiles(size, [], "v", {"ref": 0.5}).scalar()
    scores = size.select(
        (F.abs(F.col("y") - F.col("prediction")) / volatility(ref, F.col("v"))).alias("score"))
    wanted = {f"m{i}": (lambda n, c=level: _position(n, c)) for i, level in enumerate(levels)}
    wide = exact_quantiles(scores, [], "score", wanted)
    options = [F.struct(F.lit(c).alias("level"), F.col(f"m{i}").alias("margin")) for i, c in enumerate(levels)]
    return wide.select(
        F.lit(None).cast("long").alias("account_id"), ref.alias("ref"), F.inline(F.array(*options)))


def intervals(scored: DataFrame, spec: DataFrame, sigma: str | None = SIGMA, point: str = "y_pred") -> DataFrame:
    """Rows times levels with lo and hi around the point; the spec holds one row per level.  Accounts without a
    spec keep one row with null level and bounds."""
    rel = volatility(F.col("ref"), F.col(sigma) if sigma else None)
    half = F.col("margin") * rel
    joined = scored.join(spec, "account_id", "left")
    return joined.withColumn("lo", F.col(point) - half).withColumn("hi", F.col(point) + half).drop("ref", "margin")


def global_intervals(scored: DataFrame, spec: DataFrame, sigma: str = SIGMA, point: str = "y_pred") -> DataFrame:
    """As ``intervals`` with one spec for every account (its few rows become a scalar array)."""
    packed = spec.agg(F.sort_array(F.collect_list(F.struct("level", "margin", "ref"))).alias("spec"))
    rows = scored.select("*", F.inline(packed.scalar()))
    half = F.col("margin") * volatility(F.col("ref"), F.col(sigma))
    return rows.withColumn("lo", F.col(point) - half).withColumn("hi", F.col(point) + half).drop("ref", "margin")


def balance_fan(bands: DataFrame, kind: str = "holdout") -> DataFrame:
    """Bands on the balance: the actual balance before the step plus the flow band."""
    return bands.select(
        "account_id", "period", "level",
        (F.col("anchor") + F.col("lo")).alias("lo"), (F.col("anchor") + F.col("hi")).alias("hi"),
        (F.col("anchor") + F.col("y_pred")).alias("p50"), F.lit(kind).alias("kind"),
    )


def marginal_offsets(residuals: DataFrame) -> DataFrame:
    """10th and 90th percentile of each account's out-of-fold residuals."""
    p = F.percentile("residual", F.array(F.lit(0.1), F.lit(0.9)))
    return residuals.groupBy("account_id").agg(p.alias("p")).select(
        "account_id", F.col("p")[0].alias("off10"), F.col("p")[1].alias("off90"))


def width_statistics(bands: DataFrame, level: float = 0.8) -> DataFrame:
    """Calm, median and widest band of each account at one level, with its coverage."""
    width = F.col("hi") - F.col("lo")
    inside = F.col("y_true").between(F.col("lo"), F.col("hi")).cast("double")
    return bands.where(F.abs(F.col("level") - level) < 1e-9).groupBy("account_id").agg(
        F.percentile(width, 0.25).alias("width_calm"), F.median(width).alias("width_median"),
        F.max(width).alias("width_max"), F.avg(inside).alias("coverage"))


def marginal_bands(preds: DataFrame, offsets: DataFrame) -> DataFrame:
    """The 80 % band of plain residual percentiles around each prediction."""
    joined = preds.join(offsets, "account_id")
    return joined.withColumn("lo", F.col("y_pred") + F.col("off10")).withColumn("hi", F.col("y_pred") + F.col("off90")).drop("off10", "off90")


def before_after(preds: DataFrame, offsets: DataFrame, adaptive: DataFrame, level: float = 0.8) -> DataFrame:
    """Coverage and width of the marginal band next to those of the adaptive band, per account."""
    old = marginal_bands(preds, offsets).groupBy("account_id").agg(
        F.avg(F.col("y_true").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage_before"),
        F.max(F.col("hi") - F.col("lo")).alias("width_before"))
    new = width_statistics(adaptive, level).withColumnRenamed("coverage", "coverage_after")
    return old.join(new, "account_id")
