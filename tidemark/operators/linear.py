"""Linear forecasters per account.

All fits come from product sums (``gram``), added up where an account's rows meet.  Folds are blocks of
those sums: a fit on the rows before a fold, and its squared error on the fold, need no row again.  The
leave-one-out choice of a ridge penalty projects the rows on the components of each account's sums, and the
prequential residuals are one refit a row.  All are grouped jobs, each group bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import solvers
from tidemark.operators import gram
from tidemark.operators.baseline import predictions
from tidemark.operators.folds import expanding_fold

# When an unregularised fit counts as inflated, and the client ridge penalty.
COEF_TRIGGER = 150.0
CV_TRIGGER = 1.15
CLIENT_ALPHA = 10.0
# how the grouped fits are dealt
ACCOUNTS_A_TASK, MOST_TASKS = 12, 20_000

FIT_SCHEMA = (
    "account_id long, model string, alpha double, weights array<double>, intercept double, "
    "std_coef array<double>, max_abs_coef double, cv_rmse double, reason string"
)


def train_only(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_test"))


def least_squares(rows: DataFrame, features: Sequence[str], target: str = "y") -> DataFrame:
    """Standardised least squares per account, with the largest absolute coefficient."""
    return gram.fit(train_only(rows), ["account_id"], features, target)


def client_ridge(rows: DataFrame, features: Sequence[str], target: str = "y", alpha: float = CLIENT_ALPHA) -> DataFrame:
    """Fixed-penalty ridge on each account's own training rows."""
    return gram.fit(train_only(rows), ["account_id"], features, target, alpha)


def predict(rows: DataFrame, fits: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """Join each account's fit to its rows and add the prediction; accounts without a fit keep their rows
    with a null prediction."""
    slim = fits.select("account_id", F.col("weights").alias("__w"), F.col("intercept").alias("__b"))
    joined = rows.join(slim, "account_id", "left")
    return joined.withColumn(out, gram.linear(features, "__w", "__b")).drop("__w", "__b")


def total_flow(column: str = "prediction") -> Column:
    """Prediction of the target turned into total flow (the backbone is 0 on direct targets)."""
    return F.col("det_next") + F.col(column)


def holdout(rows: DataFrame, fits: DataFrame, features: Sequence[str], model: str, residual: bool = False) -> DataFrame:
    scored = predict(rows.where("is_test"), fits, features)
    return predictions(scored, model, total_flow() if residual else F.col("prediction"))


def _spread(rows: DataFrame) -> DataFrame:
    """Training rows dealt by account, a few accounts a task: adaptive execution would go by bytes, and fold a costly,
    but small, table into one task."""
    fits = rows.select("account_id").distinct().count()
    return train_only(rows).repartition(max(1, min(fits, MOST_TASKS, -(-fits // ACCOUNTS_A_TASK))), "account_id")


def _period(rows: DataFrame) -> str:
    return f"period {rows.schema['period'].dataType.simpleString()}"


FAMILY_FIELDS = [("model", pa.string()), ("alpha", pa.float64()), ("weights", gram.ARRAY), ("intercept", pa.float64()), ("std_coef", gram.ARRAY),
                 ("max_abs_coef", pa.float64()), ("cv_rmse", pa.float64()), ("reason", pa.string())]
FAMILY_SCHEMA = FIT_SCHEMA.removeprefix("account_id long, ")


def _family(rows: DataFrame, features: Sequence[str], target: str, k: int, models: Sequence[str], scored: bool) -> DataFrame:
    """Fits of ``models`` per account, with their fold RMSE if ``scored`` (not of the ridge)."""
    p = len(features)

    def fitted(z: np.ndarray, table: pa.Table) -> dict[str, Any]:
        z, n = z[np.argsort(table["rn"].to_numpy())], len(z)
        means = z.mean(axis=0)
        upto = solvers.running_rows(z - means, n, k, nested=scored)
        # a fit in a fold takes its penalty from folds of its own; the paths of all of them are followed together
        sizes = sorted({n, *[a for a, _ in solvers.time_folds(n, k) if scored]}) if "lasso" in models else []
        lassos = dict(zip(sizes, solvers.lassos_from_sums(upto, sizes, p, k)))
        fits = {"ols": solvers.ols_from_sums, "lasso": lambda upto, n, p: lassos[n]}
        out = []
        for name in models:
            if name == "ridge":
                weights, intercept, coef, alpha = solvers.row_ridge(z, p, solvers.RIDGE_ALPHAS)
                cv, reason = None, None
            else:
                coef, mean, scale, alpha, reason = fits[name](upto, n, p)
                mean = mean + means
                weights, intercept = solvers.raw_weights(coef, mean[:p], scale, mean[p])
                cv = solvers.fold_rmse(fits[name], upto, n, p, k) if scored else None
            out.append((name, alpha, weights, float(intercept), coef, float(np.abs(coef).max()), cv, reason))
        return {name: list(values) for (name, _), values in zip(FAMILY_FIELDS, zip(*out))}

    return gram.grouped(gram.keyed(_spread(rows), ["account_id"]), ["account_id"], [*features, target], fitted, FAMILY_FIELDS, FAMILY_SCHEMA, ["rn"])


def ridge_cv(rows: DataFrame, features: Sequence[str], target: str = "y", alphas: Sequence[float] = tuple(solvers.RIDGE_ALPHAS)) -> DataFrame:
    """Ridge per account, penalty by leave-one-out error over 25 log-spaced values."""
    fits = gram.ridge(train_only(rows), ["account_id"], features, target, alphas)
    return fits.select(
        "account_id", F.lit("ridge").alias("model"), "alpha", "weights", "intercept", "std_coef", "max_abs_coef",
        F.lit(None).cast("double").alias("cv_rmse"), F.lit(None).cast("string").alias("reason"))


def lasso_cv(rows: DataFrame, features: Sequence[str], target: str = "y", k: int = 5) -> DataFrame:
    """Lasso per account, penalty over a 100-step path by five expanding folds; ``reason`` tells of fits
    that had no folds or did not reach the smallest penalties."""
    return _family(rows, features, target, k, ["lasso"], scored=False)


def linear_family(
    rows: DataFrame, features: Sequence[str], target: str = "y", k: int = 5, residuals: DataFrame | None = None
) -> DataFrame:
    """Least squares, lasso and ridge per account, each with its mean fold RMSE.

    ``residuals`` are the ``fold_residuals`` of the ridge with their fold, where the caller has them already.
    """
    fits = _family(rows, features, target, k, ["ols", "lasso", "ridge"], scored=True)
    if residuals is None:
        residuals = fold_residuals(rows, features, target, k, with_fold=True)
    squares = residuals.groupBy("account_id", "fold").agg(
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))
    scores = squares.groupBy("account_id").agg(F.avg("rmse").alias("__cv"))
    cv = F.when(F.col("model") == "ridge", F.col("__cv")).otherwise(F.col("cv_rmse"))
    return fits.join(scores, "account_id", "left").withColumn("cv_rmse", cv).drop("__cv")


def choose_regularised(family: DataFrame) -> DataFrame:
    """Workflow over the fitted family: regularise when least squares is inflated or clearly worse
    by folds, then take the candidate with the least fold RMSE.  Adds chosen fit per account."""
    is_ols = F.col("model") == "ols"
    facts = family.groupBy("account_id").agg(
        F.max(F.when(is_ols, F.col("max_abs_coef"))).alias("ols_max_abs_coef"),
        F.max(F.when(is_ols, F.col("cv_rmse"))).alias("ols_cv"),
        F.min(F.when(~is_ols, F.col("cv_rmse"))).alias("best_regularised"),
    )
    regularise = (F.col("ols_max_abs_coef") > COEF_TRIGGER) | (
        F.col("ols_cv") > CV_TRIGGER * F.col("best_regularised")
    )
    judged = family.join(facts.withColumn("regularise", regularise), "account_id")
    allowed = judged.where(~F.col("regularise") | (F.col("model") != "ols"))
    fields = ["model", "alpha", "weights", "intercept", "std_coef", "cv_rmse", "ols_max_abs_coef", "regularise"]
    best = allowed.groupBy("account_id").agg(
        F.min_by(F.struct(*fields), F.struct("cv_rmse", "model")).alias("best")
    )
    return best.select("account_id", *[F.col(f"best.{f}").alias(f) for f in fields])


def fold_residuals(
    rows: DataFrame, features: Sequence[str], target: str = "y", k: int = 5, alphas: Sequence[float] | None = None, with_fold: bool = False
) -> DataFrame:
    """Out-of-fold ridge residuals of the training rows."""
    grid = [float(a) for a in (solvers.RIDGE_ALPHAS if alphas is None else alphas)]
    p = len(features)

    def left(z: np.ndarray, table: pa.Table) -> dict[str, Any]:
        folds = table["__fold"].to_numpy()
        place, residual = solvers.fold_ridge_residuals(z, folds, p, k, grid)
        return {"period": table["period"].combine_chunks().take(pa.array(place)), "fold": folds[place], "residual": residual}

    marked = _spread(rows).withColumn("__fold", F.coalesce(expanding_fold(F.col("rn"), F.col("n_train"), k), F.lit(-1)))
    out = gram.grouped(
        gram.keyed(marked, ["account_id"]), ["account_id"], [*features, target], left,
        [("period", None), ("fold", pa.int32()), ("residual", pa.float64())], f"{_period(rows)}, fold int, residual double",
        ["period", "__fold"])
    return out if with_fold else out.drop("fold")


def prequential_residuals(
    rows: DataFrame, features: Sequence[str], target: str = "y", alphas: Sequence[float] | None = None
) -> DataFrame:
    """One-step residuals of the later half, each from the ridge on all rows before it."""
    grid = solvers.RIDGE_ALPHAS if alphas is None else np.asarray(alphas, dtype=float)
    p = len(features)

    def refitted(z: np.ndarray, table: pa.Table) -> dict[str, Any]:
        order = np.argsort(table["period"].to_numpy(), kind="stable")
        place, residual = solvers.prequential(z[order, :p], z[order, p], grid)
        return {"period": table["period"].combine_chunks().take(pa.array(order[place])), "residual": residual}

    return gram.grouped(
        _spread(rows), ["account_id"], [*features, target], refitted,
        [("period", None), ("residual", pa.float64())], f"{_period(rows)}, residual double", ["period"])


def blend_weights(rows: DataFrame, features: Sequence[str], shared: str, target: str = "y") -> DataFrame:
    """Weight of the shared prediction against the client ridge, 0..1 in steps of 0.1.

    Chosen by the least out-of-fold mean absolute error; ties go to the smaller weight, 1 where
    fewer than three rows can be scored.  A row enters the sums of every fold that trains on it.
    """
    n = F.col("n_train")
    k = F.least(F.lit(3).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(n / 12))).cast("int")
    folded = train_only(rows).withColumn("__k", k).withColumn(
        "__fold", F.coalesce(expanding_fold(F.col("rn"), n, F.col("__k")), F.lit(-1))
    )
    users = F.when(F.col("__fold") < F.col("__k") - 1, F.sequence(F.col("__fold") + 1, F.col("__k") - 1))
    trained = folded.withColumn("fold", F.explode(users))
    fits = gram.fit(trained, ["account_id", "fold"], features, target, CLIENT_ALPHA)
    slim = fits.select("account_id", F.col("fold").alias("__fold"), "weights", "intercept")
    scored = folded.where(F.col("__fold") >= 0).join(slim, ["account_id", "__fold"])
    own, y = gram.linear(features), F.col(target)
    steps = [i / 10 for i in range(11)]
    errors = scored.select("account_id", y.alias("y"), F.col(shared).alias("g"), own.alias("c"))
    mae = errors.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("scored"),
        *[
            F.avg(F.abs(F.col("y") - (w * F.col("g") + (1 - w) * F.col("c")))).alias(f"m{i}")
            for i, w in enumerate(steps)
        ],
    )
    best = F.array_min(F.array(*[
        F.struct(F.col(f"m{i}").alias("mae"), F.lit(w).alias("w")) for i, w in enumerate(steps)
    ]))
    chosen = mae.select("account_id", F.when(F.col("scored") >= 3, best["w"]).otherwise(1.0).alias("w"))
    every = train_only(rows).select("account_id").distinct()
    return every.join(chosen, "account_id", "left").select(
        "account_id", F.coalesce("w", F.lit(1.0)).alias("w"))
