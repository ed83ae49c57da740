"""Pooled tree ensembles and pooled ridge (MLlib), capacity tuning, and forests of new clients.

One distributed fit covers every account.  MLlib trees split on histograms, so their values differ
a little from exact-split trees.

Fits that do not depend on each other (folds, families, settings) run from a bounded pool of threads over one
written table of feature vectors, so that their short jobs fill the cores together.  A setting that only
differs in the number of trees or rounds is not fitted again: the largest ensemble is scored at every
prefix asked for.
"""

from __future__ import annotations

import ast
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.attribution import tree_nodes
from tidemark.operators.folds import expanding_fold, fold_train_end, group_folds
from tidemark.operators.metrics import r2
from tidemark.session import cut

SEED = 42
# Settings of the tree families and of the tuning grids.
FOREST = {"trees": 400, "depth": 6, "leaf": 5, "features": "sqrt"}
BOOSTING = {"rounds": 300, "depth": 3, "rate": 0.03, "subsample": 0.8, "leaf": 5}
UNSEEN_BOOSTING = {"rounds": 300, "depth": 3, "rate": 0.05, "subsample": 0.8, "leaf": 20}
FOREST_GRID = [{"trees": n, "depth": d, "leaf": 20, "features": "all"} for n in (100, 300) for d in (8, None)]
BOOSTING_GRID = [{"rounds": n, "depth": d, "rate": 0.05, "subsample": 0.8, "leaf": 20}
                 for n in (200, 400) for d in (2, 3)]
RIDGE_GRID = [{"alpha": a} for a in (1.0, 10.0, 100.0)]
DEEPEST = 30  # MLlib's limit stands for "unlimited"
KNEE = 1.03
WARM_TREES = 50
# how fits are spread: fits at a time; rows of a task (a boosting round is many short jobs, a forest few long
# ones) up to ``SPREAD`` tasks, more rows a task beyond, as every task shuffles histograms of all nodes whatever its rows,
# and the most rows of a task, which it holds in memory; MB of histograms that one pass over the rows may fill
CONCURRENT = 8
BOOSTING_ROWS, FOREST_ROWS, SPREAD, MOST_ROWS = 50_000, 4_000, 24, 250_000
HISTOGRAMS_MB = 512


def together(jobs: Sequence[Callable[[], Any]], most: int = CONCURRENT) -> list:
    """Results of independent Spark jobs that run from ``most`` threads at a time, in their order."""
    if not jobs:
        return []
    with ThreadPoolExecutor(min(most, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with the vector column "features", unless they carry it already (see ``vectors``)."""
    if "features" in rows.columns:
        return rows
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def vectors(rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Written table of the columns ``keep`` and the feature vector, which several fits read."""
    return cut(assembled(rows, features).select(*keep, "features"))


def fit_tasks(n: int, rows_a_task: int) -> int:
    """Tasks of a fit over ``n`` rows."""
    return max(1, min(-(-n // rows_a_task), max(SPREAD, -(-n // MOST_ROWS))))


def _training(rows: DataFrame, features: Sequence[str], target: str, rows_a_task: int) -> DataFrame:
    slim = assembled(rows, features).select("features", target)
    return slim.repartition(fit_tasks(rows.count(), rows_a_task))


def fit_forest(rows: DataFrame, features: Sequence[str], target: str = "y", config: dict[str, Any] = FOREST):
    model = RandomForestRegressor(
        labelCol=target, numTrees=config["trees"], maxDepth=config["depth"] or DEEPEST,
        minInstancesPerNode=config["leaf"], featureSubsetStrategy=config["features"], seed=SEED,
        subsamplingRate=1.0, bootstrap=config.get("bootstrap", True), maxMemoryInMB=HISTOGRAMS_MB,
    )
    return model.fit(_training(rows, features, target, FOREST_ROWS))


def fit_boosting(rows: DataFrame, features: Sequence[str], target: str = "y", config: dict[str, Any] = BOOSTING):
    model = GBTRegressor(
        labelCol=target, maxIter=config["rounds"], maxDepth=config["depth"], stepSize=config["rate"],
        subsamplingRate=config["subsample"], minInstancesPerNode=config["leaf"], seed=SEED, maxMemoryInMB=HISTOGRAMS_MB,
    )
    return model.fit(_training(rows, features, target, BOOSTING_ROWS))


def fit_ridge(rows: DataFrame, features: Sequence[str], target: str = "y", config: dict[str, Any] | None = None):
    """Pooled standardised ridge; MLlib scales the target, so the penalty is scaled to match."""
    alpha = (config or {"alpha": 10.0})["alpha"]
    size = rows.agg(F.count(F.lit(1)), F.stddev_samp(target)).first()
    penalty = alpha / size[0] * size[1] if size[0] and size[1] else 0.0
    model = LinearRegression(labelCol=target, regParam=penalty, elasticNetParam=0.0, solver="normal")
    return model.fit(assembled(rows, features).select("features", target))


#: What a family calls its number of trees.
LENGTHS = {"random_forest": "trees", "boosted_trees": "rounds"}
FAMILIES = {"linear": (fit_ridge, RIDGE_GRID), "random_forest": (fit_forest, FOREST_GRID),
            "boosted_trees": (fit_boosting, BOOSTING_GRID)}


def predict(rows: DataFrame, model, features: Sequence[str], out: str = "prediction") -> DataFrame:
    scored = model.setPredictionCol(out).transform(assembled(rows, features))
    return scored.drop("features")


def choose_tree(rows: DataFrame, features: Sequence[str], target: str = "y", k: int = 5,
                forest: dict[str, Any] = FOREST, boosting: dict[str, Any] = BOOSTING) -> DataFrame:
    """Mean RMSE over expanding folds of both tree families, the better one marked.

    Every account contributes its own expanding folds to one pooled fit per fold and family.
    """
    n, rn = F.col("n_train"), F.col("rn")
    train = rows.where(~F.col("is_test")).withColumn("__fold", expanding_fold(rn, n, k))
    ready = vectors(train, features, ["__fold", "rn", "n_train", target])
    error = F.col(target) - F.col("prediction")

    def score(f: int, name: str, fit, config) -> tuple[str, float]:
        model = fit(ready.where(rn <= fold_train_end(F.lit(f), n, k)), features, target, config)
        scored = predict(ready.where(F.col("__fold") == f), model, features)
        return name, scored.agg(F.sqrt(F.avg(error * error))).first()[0]

    families = (("gradient_boosting", fit_boosting, boosting), ("random_forest", fit_forest, forest))
    jobs = [lambda f=f, family=family: score(f, *family) for family in families for f in range(k)]
    scores = rows.sparkSession.createDataFrame(together(jobs), "model string, rmse double")
    scores = scores.groupBy("model").agg(F.avg("rmse").alias("cv_rmse"))
    best = F.min_by("model", "cv_rmse").over(Window.partitionBy(F.lit(0)))
    return scores.withColumn("is_best", F.col("model") == best)


def later_block(blocks: int) -> Column:
    """Block 0 .. ``blocks`` - 1 of a training row in the later half of its account's, null in the earlier half."""
    begin = F.greatest(F.lit(8), F.floor(F.col("n_train") * 0.5))
    place = F.col("rn") - 1 - begin
    return F.when(place >= 0, F.floor(place * blocks / (F.col("n_train") - begin))).cast("int")


def staged_residuals(rows: DataFrame, features: Sequence[str], fit, config: dict[str, Any], stage: Column, stages: int,
                     target: str = "y") -> DataFrame:
    """Residuals (account_id, period, residual) of the training rows that have a ``stage``, each from a pooled model of
    all rows in stages before it; rows without a stage are only trained on.

    With ``later_block`` these are prequential residuals a block at a time, as a pooled ensemble cannot be refitted
    for every row; with ``expanding_fold`` they are out-of-fold residuals.
    """
    train = rows.where(~F.col("is_test")).withColumn("__stage", F.coalesce(stage, F.lit(-1)))
    ready = vectors(train, features, ["account_id", "period", "__stage", target])
    own = F.col("__stage")
    models = together([lambda s=s: fit(ready.where(own < s), features, target, config) for s in range(stages)])
    parts = [predict(ready.where(own == s), model, features) for s, model in enumerate(models)]
    residual = (F.col(target) - F.col("prediction")).cast("double")
    return reduce(DataFrame.unionByName, parts).select("account_id", "period", residual.alias("residual"))


def prefix_errors(model, rows: DataFrame, features: Sequence[str], target: str, sizes: Sequence[int]) -> list[float]:
    """Mean absolute error on ``rows`` of the first 1 .. n trees (rounds) of an ensemble, for each n in ``sizes``.

    Boosting adds its rounds up, a forest takes the mean over its first trees.
    """
    ready = assembled(rows, features)
    if hasattr(model, "evaluateEachIteration"):
        errors = model.evaluateEachIteration(ready.select("features", F.col(target).cast("double").alias(model.getLabelCol())), "absolute")
        return [errors[n - 1] for n in sizes]
    leaves = tree_nodes(model, rows.sparkSession).where(F.col("left") < 0).select("treeID", "id", "value")
    # the leaf values are part of the model, which MLlib holds on the driver and ships whole as well
    values = [t["value"].to_numpy() for _, t in leaves.toPandas().sort_values(["treeID", "id"]).groupby("treeID")]
    shipped = rows.sparkSession.sparkContext.broadcast(values)
    scored = model.setLeafCol("__leaf").setPredictionCol("__p").transform(ready)
    scored = scored.select(F.col(target).cast("double").alias("y"), vector_to_array("__leaf").alias("leaf"))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = np.stack(batch["leaf"].to_numpy()).astype(int)
            found = np.cumsum(np.stack([v[place[:, t]] for t, v in enumerate(shipped.value)], axis=1), axis=1)
            y = batch["y"].to_numpy()
            yield pd.DataFrame({"n": list(sizes), "rows": len(y), "error": [np.abs(y - found[:, n - 1] / n).sum() for n in sizes]})

    sums = scored.mapInPandas(added, "n int, rows long, error double").groupBy("n").agg((F.sum("error") / F.sum("rows")).alias("mae"))
    by_size = {r.n: r.mae for r in sums.collect()}
    model.setLeafCol("")
    return [by_size[n] for n in sizes]


def step_scale(rows: DataFrame, target: str = "y") -> float:
    """Mean absolute change of the target from one period to the next within accounts."""
    by_period = Window.partitionBy("account_id").orderBy("period")
    change = F.abs(F.col(target) - F.lag(target).over(by_period))
    return rows.select(change.alias("c")).agg(F.avg("c")).first()[0] or 1.0


def tune(rows: DataFrame, features: Sequence[str], family: str, grid: Sequence[dict] | None = None,
         k: int = 3, target: str = "y") -> DataFrame:
    """Capacity sweep over account folds: validation MASE and seconds per fit of every setting.

    The knee is the cheapest setting within 3 % of the best.  All fits run together; a setting that is a prefix
    of another counts its share of that fit's seconds.
    """
    fit, default = FAMILIES[family]
    grid = list(grid or default)
    folds = group_folds(rows, k).select("account_id", "fold")
    ready = vectors(rows.join(folds, "account_id"), features, ["account_id", "period", "fold", target])
    scale = step_scale(ready, target)
    # settings that differ in their number of trees only share one fit
    length = LENGTHS.get(family)
    shared: dict[str, list[int]] = {}
    for i, config in enumerate(grid):
        shared.setdefault(str({c: v for c, v in config.items() if c != length}), []).append(i)

    def fold_errors(members: list[int], f: int) -> list[tuple[int, float, float]]:
        """(setting, mean absolute error, seconds) of all settings of one fit."""
        largest = max((grid[i] for i in members), key=lambda c: c.get(length, 0))
        seen, held = ready.where(F.col("fold") != f), ready.where(F.col("fold") == f)
        began = time.perf_counter()
        model = fit(seen, features, target, largest)
        spent = time.perf_counter() - began
        if length is None:
            scored = predict(held, model, features)
            return [(members[0], scored.agg(F.avg(F.abs(F.col(target) - F.col("prediction")))).first()[0], spent)]
        sizes = [grid[i][length] for i in members]
        return [(i, e, spent * n / largest[length]) for i, n, e in zip(members, sizes, prefix_errors(model, held, features, target, sizes))]

    jobs = [lambda m=m, f=f: fold_errors(m, f) for m in shared.values() for f in range(k)]
    found = [r for part in together(jobs) for r in part]
    results = []
    for i, config in enumerate(grid):
        own = [(e, s) for j, e, s in found if j == i]
        results.append((family, str(config), float(np.mean([e for e, _ in own])) / scale, float(np.mean([s for _, s in own]))))
    limit = KNEE * min(r[2] for r in results)
    knee = min((r for r in results if r[2] <= limit), key=lambda r: r[3])
    table = [(*r, r is knee) for r in results]
    return rows.sparkSession.createDataFrame(
        table, "family string, config string, mase double, fit_s double, is_knee boolean")


def knee_settings(tuned: DataFrame) -> dict[str, dict]:
    """The setting at the knee of every family of ``tune`` results, as the benchmark takes them."""
    return {r.family: ast.literal_eval(r.config) for r in tuned.where("is_knee").collect()}


def out_of_fold(rows: DataFrame, features: Sequence[str], family: str, config: dict, k: int = 5, target: str = "y") -> DataFrame:
    """Predictions for every account from a model that never saw it."""
    fit, _ = FAMILIES[family]
    folds = group_folds(rows, k).select("account_id", "fold")
    ready = vectors(rows.join(folds, "account_id"), features, ["account_id", "period", "fold", target])
    models = together([lambda f=f: fit(ready.where(F.col("fold") != f), features, target, config) for f in range(k)])
    parts = []
    for f, model in enumerate(models):
        scored = predict(ready.where(F.col("fold") == f), model, features)
        parts.append(scored.select("account_id", "period", F.lit(family).alias("model"),
                                   F.col(target).alias("y_true"), F.col("prediction").alias("y_pred")))
    return reduce(DataFrame.unionByName, parts)


def pooled_r2(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model").agg(
        r2(F.col("y_true"), F.col("y_pred")).alias("r2"), F.count(F.lit(1)).alias("n"))


def client_forest(rows: DataFrame, features: Sequence[str], target: str = "y", trees: int = WARM_TREES,
                  depth: int | None = 8, leaf: int = 20) -> DataFrame:
    """Holdout predictions of a small forest grown on the new clients' own training rows.

    One distributed fit over all of them: trees for each client alone would be a local learner on a few
    dozen rows.
    """
    config = {"trees": trees, "depth": depth, "leaf": leaf, "features": "all"}
    model = fit_forest(rows.where(~F.col("is_test")), features, target, config)
    scored = predict(rows.where("is_test"), model, features, out="client_forest")
    return scored.select("account_id", "period", "client_forest")


def warm_forest(scored: DataFrame, own: DataFrame, shared: str, shared_trees: int, trees: int = WARM_TREES) -> DataFrame:
    """The shared forest kept and ``trees`` trees of the new clients added: the mean over all trees."""
    total = shared_trees + trees
    return scored.join(own, ["account_id", "period"]).withColumn(
        "warm_forest",
        (F.col(shared) * shared_trees + F.col("client_forest") * trees) / total,
    ).drop("client_forest")
