import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution as AT
from tidemark.operators import baseline as B
from tidemark.operators import conformal as C
from tidemark.operators import features as X
from tidemark.operators import folds as O
from tidemark.operators import linear as LN
from tidemark.operators import metrics as M
from tidemark.operators import projection as PJ
from tidemark.operators import recurring as N
from tidemark.operators import trees as T
from tidemark.plans import newclient as NC
from tidemark.session import cut


def weekly_frame(n=60, accounts=3, seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for a in range(1, accounts + 1):
        flow = np.round(rng.normal(size=n) * 100 + 30 * np.sin(np.arange(n)), 2)
        parts.append(pd.DataFrame({
            "account_id": a, "period": pd.date_range("2023-01-01", periods=n, freq="7D").date, "net_flow": flow,
            "end_balance": flow.cumsum(), "txn_count": rng.integers(1, 9, n), "grp_income": np.maximum(flow, 0) * (rng.random(n) < 0.7),
            "grp_cash": np.minimum(flow, 0)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def panel(spark):
    series = cut(spark.createDataFrame(weekly_frame()))
    rows, names = X.model_rows(series, "W")
    return series, cut(O.temporal_split(rows, 12)), names


def test_features_match_pandas(spark):
    pdf = weekly_frame(accounts=1)
    got = X.feature_matrix(spark.createDataFrame(pdf), "W").orderBy("period").toPandas()
    flow = pdf["net_flow"]
    for k in (4, 8, 12):
        for name, want in (("mean", flow.rolling(k).mean()), ("std", flow.rolling(k).std()), ("sum", flow.rolling(k).sum())):
            assert np.allclose(got[f"nf_roll_{name}_{k}"].astype(float), want, equal_nan=True)
    assert np.allclose(got["nf_lag_3"].astype(float), flow.shift(3), equal_nan=True)
    since, count = [], 0
    for v in pdf["grp_income"] > 0:
        count = 0 if v else count + 1
        since.append(count)
    assert got["periods_since_income"].tolist() == since


def test_features_ignore_the_future(spark):
    pdf = weekly_frame(accounts=1)
    changed = pdf.copy()
    changed.loc[40:, ["net_flow", "end_balance", "txn_count", "grp_income"]] = 999
    names = X.feature_names(list(pdf.columns), "W")
    a, b = (X.feature_matrix(spark.createDataFrame(p), "W").where("t < 40").orderBy("period").select(*names).toPandas() for p in (pdf, changed))
    pd.testing.assert_frame_equal(a, b)


def test_split_and_folds(panel):
    _, rows, _ = panel
    got = rows.withColumn("fold", O.expanding_fold(F.col("rn"), F.col("n_train"), 5)).where("account_id = 1").orderBy("rn").toPandas()
    n = len(got)
    assert got["is_test"].sum() == min(12, n // 4) and got["is_test"].iloc[-1]
    train = got[~got["is_test"]]
    size = len(train) // 6
    assert train["fold"].isna().sum() == len(train) - 5 * size
    assert (train["fold"].dropna().value_counts() == size).all()


def test_account_folds_are_disjoint_and_balanced(spark):
    rows = spark.createDataFrame([(a,) for a in range(20) for _ in range(a % 4 + 1)], "account_id long")
    folds = O.group_folds(rows, 3).toPandas()
    assert folds["account_id"].is_unique and folds.groupby("fold")["fold_rows"].sum().max() <= 20
    roles = O.account_holdout(rows.select("account_id").distinct(), 15, 4).toPandas()["role"].value_counts()
    assert roles.to_dict() == {"train": 11, "unseen": 5, "calibration": 4}


def test_scale_of_constant_and_zero_series(spark):
    rows = spark.createDataFrame(
        [(a, dt.date(2024, 1, i), v, False, v) for a, v in ((1, 5.0), (2, 0.0)) for i in range(1, 5)]
        + [(a, dt.date(2024, 1, 9), v, True, v + 10) for a, v in ((1, 5.0), (2, 0.0))],
        "account_id long, period date, net_flow double, is_test boolean, total_next double")
    assert {r.account_id: r.scale for r in M.naive_scale(rows).collect()} == {1: 5.0, 2: 1.0}
    got = {r.account_id: r.mase for r in M.holdout_scores(rows, {"m": F.col("net_flow")}).collect()}
    assert got == {1: 2.0, 2: 10.0}


def test_rules_from_hand_made_payments(spark):
    rows = []
    for m in range(1, 9):  # rent on the 31st or month end, twice in March
        last = (dt.date(2024, m + 1, 1) - dt.timedelta(days=1)).day
        rows.append((1, dt.date(2024, m, min(31, last)), "Rent 7", "x", -500.0, "utilities"))
    rows.append((1, dt.date(2024, 3, 31), "Rent 8", "x", -500.0, "utilities"))
    rows += [(1, dt.date(2024, 1, 3) + dt.timedelta(days=7 * i), "Gym", "x", -12.0, "leisure") for i in range(30)]
    rows += [(1, dt.date(2024, 9, 1), "Last", "x", -1.0, "cash")]
    tx = spark.createDataFrame(rows, "account_id long, txn_date date, counterparty string, details string, amount double, spending_group string")
    tx = tx.withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("id", F.monotonically_increasing_id())
    cuts = N.cutoffs(tx, "W", 1)
    gated = N.detect_gated(tx, cuts).collect()
    assert [(r.key, r.amount, r.day_of_month, r.n) for r in gated] == [("RENT", -500.0, 31, 9)]
    loose = {r.key: (r.cadence, r.weekday, r.group) for r in N.detect_agnostic(tx, cuts).collect()}
    assert loose["GYM"] == ("weekly", 2, "leisure")


def test_schedule_and_backbone(spark):
    rules = spark.createDataFrame(
        [(1, "R", -100.0, 31, "monthly", 0), (1, "S", -7.0, 0, "weekly", 6)],
        "account_id long, key string, amount double, day_of_month int, cadence string, weekday int")
    limits = spark.createDataFrame([(1, dt.date(2024, 2, 4), dt.date(2024, 3, 10))], "account_id long, start date, end date")
    days = {(r.key, str(r.day)) for r in N.occurrences(rules, limits).collect()}
    assert ("R", "2024-02-29") in days and ("S", "2024-02-04") in days and ("S", "2024-03-10") in days and len(days) == 7
    habit = spark.createDataFrame([(1, "dining", -20.0)], "account_id long, `group` string, rate double")
    det = {str(r.period): r.det for r in N.backbone(limits, rules, habit, "W").collect()}
    # a payment on a Sunday counts to the next week, and past the end it is dropped
    assert det["2024-02-04"] == -20.0 and det["2024-02-11"] == -27.0 and det["2024-03-03"] == -127.0 and len(det) == 6


def test_ridge_predictions_match_numpy(panel):
    _, rows, names = panel
    got = LN.holdout(rows, LN.client_ridge(rows, names), names, "r").where("account_id = 2").orderBy("period").toPandas()
    pdf = rows.where("account_id = 2").orderBy("period").toPandas()
    train, test = pdf[~pdf["is_test"]], pdf[pdf["is_test"]]
    x, y = train[names].to_numpy(float), train["y"].to_numpy(float)
    scale = x.std(0)
    scale[scale == 0] = 1
    z = (x - x.mean(0)) / scale
    coef = np.linalg.solve(z.T @ z + 10 * np.eye(len(names)), z.T @ (y - y.mean()))
    want = (test[names].to_numpy(float) - x.mean(0)) / scale @ coef + y.mean()
    assert np.allclose(got["y_pred"], want, rtol=1e-5, atol=1e-4)


def test_margins_match_numpy_and_nest(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"account_id": [1] * 17 + [2] * 40, "score": rng.random(57)})
    pdf["ref"] = 1.0
    got = C.margins(spark.createDataFrame(pdf)).toPandas()
    for a, g in pdf.groupby("account_id"):
        n = len(g)
        for c in C.LEVELS:
            want = np.quantile(g["score"], min(1.0, np.ceil((n + 1) * c) / n))
            assert np.isclose(got[(got.account_id == a) & (got.level == c)]["margin"].iloc[0], want)
        assert got[got.account_id == a].sort_values("level")["margin"].is_monotonic_increasing


def test_global_spec_matches_numpy(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"nf_roll_std_4": rng.random(500) * 50, "y": rng.normal(size=500), "prediction": rng.normal(size=500)})
    ref = np.median(pdf["nf_roll_std_4"])
    rel = np.clip(pdf["nf_roll_std_4"] / max(ref, 1), 0.6, 1.6)
    scores = np.abs(pdf["y"] - pdf["prediction"]) / rel
    got = {r.level: r.margin for r in C.global_spec(spark.createDataFrame(pdf)).collect()}
    for c in C.LEVELS:
        assert np.isclose(got[c], np.quantile(scores, min(1, np.ceil(501 * c) / 500)))


def test_projection_is_repeatable_nested_and_centred(panel):
    series, rows, names = panel
    fits = LN.client_ridge(rows, names)
    start = cut(PJ.seeds(series, "W", 8).join(fits, "account_id").withColumn("margin", F.lit(50.0)).withColumn("ref", F.lit(80.0)))
    point = PJ.linear_point(names)
    paths = PJ.simulate(start, "W", 8, point, n_paths=40)
    a, b = (p.orderBy("account_id", "path", "step").toPandas() for p in (paths, paths.repartition(3)))
    pd.testing.assert_frame_equal(a, b)
    bands = PJ.fan(paths).toPandas().sort_values(["account_id", "period", "level"])
    for _, g in bands.groupby(["account_id", "period"]):
        assert g["lo"].is_monotonic_decreasing and g["hi"].is_monotonic_increasing
    quiet = PJ.simulate(start, "W", 8, point, n_paths=1, noise=False).orderBy("account_id", "step").toPandas()
    alone = PJ.recursive(start, "W", 8, point).orderBy("account_id", "step").toPandas()
    assert np.allclose(quiet["balance"], alone["p50"])
    # the first step is the model's forecast at the newest row
    newest = X.feature_matrix(series, "W").join(fits.select("account_id", "weights", "intercept"), "account_id")
    last = newest.orderBy(F.desc("period")).limit(3).toPandas().sort_values("account_id")
    want = [r["end_balance"] + r["intercept"] + np.dot(r["weights"], [r[n] for n in names]) for _, r in last.iterrows()]
    assert np.allclose(alone[alone.step == 1]["p50"], want)


def test_a_fan_is_taken_where_its_paths_are(panel, monkeypatch):
    """Accounts are dealt to tasks by number, and their paths are not shuffled or sorted between tasks again."""
    series, rows, names = panel
    start = PJ.seeds(series, "W", 3).join(LN.client_ridge(rows, names), "account_id")
    start = cut(start.withColumn("ref", F.lit(50.0)).withColumn("margin", F.lit(80.0)))
    columns = ["account_id", "period", "level", "lo", "hi"]

    def fan():
        out = PJ.fan(PJ.simulate(start, "W", 3, PJ.linear_point(names), n_paths=40))
        return out, sorted(tuple(r) for r in out.select(*columns).collect())

    _, together = fan()
    monkeypatch.setattr(PJ, "ACCOUNTS_A_TASK", 1)
    out, dealt = fan()
    assert dealt == together and len(dealt) == 3 * 3 * len(C.LEVELS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_tree_contributions_add_up(panel):
    _, rows, names = panel
    model = T.fit_forest(LN.train_only(rows), names, config={"trees": 5, "depth": 4, "leaf": 5, "features": "all"})
    phi = AT.tree_attribution(rows.where("is_test"), model, names, average=True).toPandas()
    pred = T.predict(rows.where("is_test"), model, names).select("account_id", "period", "prediction").toPandas()
    both = phi.merge(pred, on=["account_id", "period"])
    assert np.allclose(both[names].sum(axis=1) + both["base"], both["prediction"])


def test_moving_average_takes_the_best_window(panel):
    _, rows, _ = panel
    choice = B.choose_window(rows, "W").toPandas().set_index("account_id")
    pdf = rows.where("account_id = 1 and not is_test").orderBy("period").toPandas()
    n = len(pdf)
    k = min(5, max(2, n // 10))
    size = n // (k + 1)
    scores = {}
    for w in (4, 8, 12):
        blocks = [pdf.iloc[n - (k - f) * size: n - (k - f - 1) * size] for f in range(k)]
        scores[w] = np.mean([np.sqrt(np.mean((b["total_next"] - b[f"nf_roll_mean_{w}"]) ** 2)) for b in blocks])
    assert choice.loc[1, "window"] == min(scores, key=scores.get)


def test_trees_are_shipped_in_groups(spark, panel):
    _, rows, names = panel
    model = T.fit_forest(LN.train_only(rows), names, config={"trees": 6, "depth": 3, "leaf": 2, "features": "all"})
    test = rows.where("is_test")
    whole = AT.tree_attribution(test, model, names, average=True).orderBy("account_id", "period").toPandas()
    parts = AT.tree_attribution(test, model, names, average=True, most_nodes=20).orderBy("account_id", "period").toPandas()
    assert np.allclose(whole[["base", *names]], parts[["base", *names]])
    assert AT.tree_groups({0: 5, 1: 5, 2: 9, 3: 1}, 10) == [[0, 1], [2, 3]]
    with pytest.raises(ValueError):
        AT.tree_groups({0: 11}, 10)


def test_lightest_fold_first(spark):
    from tidemark.operators import folds as O

    sizes = [5, 4, 3, 3, 3]
    rows = spark.createDataFrame([(a,) for a, n in enumerate(sizes) for _ in range(n)], "account_id long")
    got = {r.account_id: r.fold for r in O.group_folds(rows, 2).collect()}
    assert [got[a] for a in range(5)] == [0, 1, 1, 0, 1]


def test_dealing_by_blocks_equals_one_account_after_the_other():
    import random

    from tidemark.operators.folds import dealt

    rng = random.Random(0)
    for _ in range(400):
        k, sizes = rng.randrange(1, 7), sorted((rng.choice([1, 2, 3, 5, 7, 50]) for _ in range(rng.randrange(60))), reverse=True)
        load, plain = [0] * k, []
        for size in sizes:
            f = min(range(k), key=lambda i: (load[i], i))
            load[f] += size
            plain.append(f)
        got = []
        for size, before, first in dealt([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)], k):
            assert before == len(got)
            got += [first[i] if i < len(first) else first[len(first) - k + (i - len(first)) % k] for i in range(sizes.count(size))]
        assert got == plain


@pytest.fixture(scope="module")
def wavy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.uniform(size=(400, 3))
    y = np.sin(5 * x[:, 0]) * 10 + x[:, 1]
    return spark.createDataFrame([(i % 20, i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))],
                                 "account_id long, period int, a double, b double, c double, y double")


def test_prefix_of_an_ensemble_is_scored_as_the_smaller_one(wavy):
    from pyspark.sql import functions as F

    from tidemark.operators import trees as T

    names, config = ["a", "b", "c"], {"rounds": 12, "depth": 2, "rate": 0.2, "subsample": 1.0, "leaf": 2}
    mae = lambda model: T.predict(wavy, model, names).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    whole = T.fit_boosting(wavy, names, "y", config)
    errors = T.prefix_errors(whole, wavy, names, "y", [1, 5, 12])
    assert errors[2] == pytest.approx(mae(whole))
    assert errors[1] == pytest.approx(mae(T.fit_boosting(wavy, names, "y", config | {"rounds": 5})))
    forest = T.fit_forest(wavy, names, "y", {"trees": 9, "depth": 4, "leaf": 2, "features": "all"})
    found = T.prefix_errors(forest, wavy, names, "y", [1, 9])
    assert found[1] == pytest.approx(mae(forest)) and found[0] != found[1]


def test_tuning_fits_the_largest_of_a_family_only(wavy):
    from tidemark.operators import trees as T

    grid = [{"rounds": n, "depth": d, "rate": 0.2, "subsample": 1.0, "leaf": 2} for n in (3, 9) for d in (1, 2)]
    tuned = T.tune(wavy, ["a", "b", "c"], "boosted_trees", grid, k=2)
    rows = {r.config: r for r in tuned.collect()}
    assert len(rows) == 4 and sum(r.is_knee for r in rows.values()) == 1
    assert rows[str(grid[3])].mase < rows[str(grid[1])].mase
    assert T.knee_settings(tuned)["boosted_trees"] in grid


def test_jobs_run_together_keep_their_order():
    from tidemark.operators import trees as T

    assert T.together([lambda i=i: i * i for i in range(20)], 3) == [i * i for i in range(20)] and T.together([]) == []


def test_staged_residuals_come_from_earlier_stages(spark):
    """A pooled tree with one leaf value a side: each block's residuals against the means of the blocks before."""
    rng = np.random.default_rng(5)
    pdf = pd.concat([pd.DataFrame({"account_id": a, "rn": np.arange(1, n + 1), "n_train": n, "is_test": False,
                                   "x": rng.integers(0, 2, n).astype(float), "y": rng.normal(size=n)}) for a, n in ((1, 40), (2, 23), (3, 7))])
    pdf["period"] = [dt.date(2024, 1, 1) + dt.timedelta(days=int(i)) for i in pdf["rn"]]
    config = {"trees": 1, "depth": 1, "leaf": 1, "features": "all", "bootstrap": False}
    out = T.staged_residuals(spark.createDataFrame(pdf), ["x"], T.fit_forest, config, T.later_block(5), 5).toPandas()
    begin = np.maximum(8, pdf["n_train"] // 2)
    place = pdf["rn"] - 1 - begin
    pdf["stage"] = np.where(place >= 0, np.floor(place * 5 / (pdf["n_train"] - begin)), -1)
    assert len(out) == (pdf["stage"] >= 0).sum() and set(out["account_id"]) == {1, 2}
    got = pdf.merge(out, on=["account_id", "period"])
    for stage in range(5):
        means = pdf[pdf["stage"] < stage].groupby("x")["y"].mean()
        own = got[got["stage"] == stage]
        assert np.allclose(own["residual"], own["y"] - own["x"].map(means))


def test_better_point_per_account(spark):
    from tidemark.plans import headline as H

    rows = [(1, "linear", 1.0, 2.0), (1, "tree", 1.0, 1.0), (1, "linear", 3.0, 3.0), (1, "tree", 3.0, 3.0),  # the tree is exact
            (2, "linear", 1.0, 1.0), (2, "tree", 1.0, 1.0), (2, "linear", 2.0, 2.0), (2, "tree", 2.0, 2.0),  # a tie
            (3, "linear", 5.0, 1.0), (3, "tree", 5.0, 4.0)]  # one row: both have 0
    points = spark.createDataFrame(rows, "account_id long, model string, y_true double, y_pred double")
    assert {r.account_id: r.point for r in H.better_point(points).collect()} == {1: "tree", 2: "linear", 3: "linear"}


def test_headline_with_a_tree(spark):
    """Points, bands and fan of every account come from the family it chose."""
    from tidemark.operators import rollup as R
    from tidemark.plans import headline as H
    from workload import adapters as A

    tx = cut(A.ledger_flows(spark, "/root/testdata/sf0.001").where("account_id <= 6"))
    forest = {"trees": 5, "depth": 3, "leaf": 5, "features": "sqrt"}
    out = H.headline(tx, cut(R.daily_series(tx)), paths=20, tree="forest", forest=forest)
    choice = {r.account_id: r.point for r in out.points.collect()}
    bands = out.bands.toPandas()
    assert set(bands["account_id"]) == set(choice) and (bands["account_id"].map(choice) == bands["model"]).all()
    assert (bands.groupby(["account_id", "period"]).size() == len(C.LEVELS)).all() and (bands["lo"] <= bands["hi"]).all()
    assert {r.account_id for r in out.quality.collect()} == set(choice)
    fan = out.fan.toPandas()
    assert set(fan["kind"]) == {"holdout", "anchor", "projection"}
    ahead = fan[fan["kind"] == "projection"]
    assert (ahead.groupby("account_id").size() == N.HORIZON["W"] * len(C.LEVELS)).all() and set(ahead["account_id"]) == set(choice)


def test_fits_stop_adding_tasks_with_rows(spark):
    """Every task of a fit shuffles histograms of all nodes, so tasks must not follow the rows one for 4,000."""
    from tidemark.operators import trees

    rows = spark.range(200_000).select(F.col("id").cast("double").alias("x"), F.rand(1).alias("y"))
    few = rows.where("x < 40000")
    assert trees._training(rows, ["x"], "y", trees.FOREST_ROWS).rdd.getNumPartitions() == trees.SPREAD
    assert trees._training(few, ["x"], "y", trees.FOREST_ROWS).rdd.getNumPartitions() == 10
    assert trees._training(rows, ["x"], "y", trees.FOREST_ROWS).count() == 200_000
    assert [trees.fit_tasks(n, trees.FOREST_ROWS) for n in (0, 1, 20_000_000)] == [1, 1, 80]


def test_tuned_benchmark_makes_its_rows_once(spark, monkeypatch):
    """Tuning and the fit at the knee read the same written rows; the features are not computed again for the second."""
    rng = np.random.default_rng(5)
    rows = []
    for account in range(9):
        x = rng.normal(size=20)
        rows += [(account, f"2020-01-{i + 1:02d}", "unseen" if account > 7 else "train", i >= 16, float(x[i]), float(2 * x[i] + rng.normal())) for i in range(20)]
    made = spark.createDataFrame(rows, "account_id long, period string, role string, is_test boolean, a double, y double")
    calls = []

    def with_roles(weekly, n_train, n_calibration):
        calls.append((n_train, n_calibration))
        return weekly, made, ["a"]

    monkeypatch.setattr(NC, "with_roles", with_roles)
    sweep, bench = NC.tuned_benchmark(made, 8, 0, ["linear"])
    assert calls == [(8, 0)]
    knee = T.knee_settings(sweep)
    assert sweep.count() == 3 and bench.settings == knee and bench.features == ["a"]
    plain = T.predict(made, T.fit_ridge(made.where("role = 'train'"), ["a"], "y", knee["linear"]), ["a"]).collect()
    got = {(r.account_id, r.period): r.linear for r in bench.rows.collect()}
    assert len(got) == 180 and all(np.isclose(got[r.account_id, r.period], r.prediction) for r in plain)


def test_benchmark_writes_its_rows_once_and_only_used_features(spark, monkeypatch):
    """Models of one feature write no other; predictions are not written with the rows again."""
    from tidemark.plans import newclient as NC

    rng = np.random.default_rng(8)
    weekly = pd.concat([pd.DataFrame({
        "account_id": a, "period": [dt.date(2020, 1, 5) + dt.timedelta(weeks=i) for i in range(70)], "net_flow": rng.normal(size=70) * 100 + a,
        "txn_count": 3, "grp_income": 1.0, "grp_groceries": rng.normal(size=70), "end_balance": rng.normal(size=70)}) for a in range(1, 9)])
    weekly = spark.createDataFrame(weekly).selectExpr("account_id", "period", "cast(net_flow as decimal(28,4)) net_flow", "cast(txn_count as long) txn_count",
                                                      "cast(grp_income as decimal(28,4)) grp_income", "cast(grp_groceries as decimal(28,4)) grp_groceries",
                                                      "cast(end_balance as decimal(28,4)) end_balance")
    written, plain = [], NC.cut
    monkeypatch.setattr(NC, "cut", lambda df: written.append(df.columns) or plain(df))
    settings = {"linear": {"alpha": 10.0}}
    whole, one = NC.benchmark(weekly, 5, 1, settings), NC.benchmark(weekly, 5, 1, settings, ["nf_lag_1"])
    wide = [c for c in written if "role" in c]
    assert len(wide) == 2 and "nf_lag_2" in wide[0] and "nf_lag_1" in wide[1] and "nf_lag_2" not in wide[1]
    for bench in (whole, one):
        assert {"linear", "role", "is_test", "y", "total_next"} <= set(bench.rows.columns)
        scored = bench.rows.orderBy("account_id", "period").toPandas()
        assert set(scored["role"]) == {"train", "calibration", "unseen"} and scored["linear"].notna().all()
        model = bench.models["linear"]
        assert np.allclose(scored["linear"], scored[bench.features].to_numpy(float) @ model.coefficients.toArray() + model.intercept)
        assert {r.account_id for r in NC.zero_shot(bench).select("account_id").collect()} == set(scored["account_id"][scored["role"] == "unseen"])
