import os
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import solvers as S

sys.path.insert(0, os.path.dirname(__file__))
import dense as D  # noqa: E402


def data(n=80, p=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 5, 20, 1, 0.1, 3][:p] + 4
    return x, x[:, 0] * 3 - x[:, 1] + rng.normal(size=n) * 2


def refit(x, y, alpha):
    mean, scale = x.mean(0), x.std(0)
    z, level = (x - mean) / scale, y.mean()
    coef = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - level))
    return coef, mean, scale, level


def test_ridge_penalty_is_the_one_with_least_left_out_error():
    x, y = data()
    z = (x - x.mean(0)) / x.std(0)
    errors = []
    for alpha in S.RIDGE_ALPHAS:
        e = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            zi, yi = z[keep], y[keep]
            c, m = zi.mean(0), yi.mean()
            b = np.linalg.solve((zi - c).T @ (zi - c) + alpha * np.eye(z.shape[1]), (zi - c).T @ (yi - m))
            e.append(y[i] - m - (z[i] - c) @ b)
        errors.append(np.mean(np.square(e)))
    coef, *_, alpha = S.ridge(x, y)
    assert np.isclose(alpha, S.RIDGE_ALPHAS[int(np.argmin(errors))])
    assert np.allclose(coef, refit(x, y, alpha)[0])


def test_gram_ridge_equals_direct_solution():
    x, y = data()
    z = np.column_stack([x, y])
    sums = [v for i in range(z.shape[1]) for v in [z[:, i].sum(), *[(z[:, i] * z[:, j]).sum() for j in range(i + 1)]]]
    for alpha in (0.0, 10.0):
        assert np.allclose(S.gram_ridge(sums, len(y), x.shape[1], alpha)[0], refit(x, y, alpha)[0], atol=1e-8)


def test_gram_handles_collinear_and_constant_features():
    x, y = data()
    x = np.column_stack([x, 4 * x[:, 1], np.full(len(y), 7.0)])
    z = np.column_stack([x, y])
    shift = z.mean(0)
    z = z - shift
    sums = [v for i in range(z.shape[1]) for v in [z[:, i].sum(), *[(z[:, i] * z[:, j]).sum() for j in range(i + 1)]]]
    coef, mean, scale, level = S.gram_ridge(sums, len(y), x.shape[1], 0.0, shift)
    plain = D.ols(x, y)
    assert np.allclose((x - mean) / scale @ coef + level, (x - plain[1]) / plain[2] @ plain[0] + plain[3], atol=1e-6)


def test_large_levels_keep_their_slope(spark):
    """Mean 1e8, deviation 50, slope 3: lost in uncentred sums of products."""
    from tidemark.operators import gram

    rng = np.random.default_rng(1)
    x = 1e8 + 50 * rng.normal(size=200)
    rows = spark.createDataFrame([(1, float(a), float(3 * a + rng.normal())) for a in x], "account_id long, x double, y double")
    fit = gram.fit(rows, ["account_id"], ["x"], "y").first()
    assert np.isclose(fit.weights[0], 3, atol=0.01)


def panel(spark, sizes=(24, 47, 80), p=4):
    """Accounts of different length, the last column a multiple of the first."""
    rows = []
    for account, n in enumerate(sizes):
        x, y = data(n=n, p=p, seed=account)
        x = np.column_stack([x, 2 * x[:, 0]])
        rows += [(account, f"2020-01-01T{i:04d}", i + 1, n, False, *map(float, x[i]), float(y[i] + 1000 * account)) for i in range(n)]
    names = [f"x{i}" for i in range(p + 1)]
    df = spark.createDataFrame(rows, ["account_id", "period", "rn", "n_train", "is_test", *names, "y"])
    df = df.withColumn("rn", df.rn.cast("int"))
    back = {a: (np.array([r[5:-1] for r in rows if r[0] == a]), np.array([r[-1] for r in rows if r[0] == a])) for a in range(len(sizes))}
    return df, names, back


def test_family_from_sums_equals_fits_on_rows(spark):
    from tidemark.operators import linear as LN

    df, names, back = panel(spark)
    got = {(r.account_id, r.model): r for r in LN.linear_family(df, names).collect()}
    plain = {"ols": lambda a, b: (*D.ols(a, b), 0.0), "lasso": D.lasso, "ridge": S.ridge}
    for a, (x, y) in back.items():
        for name, fit in plain.items():
            coef, mean, scale, level, alpha, *_ = fit(x, y)
            r = got[a, name]
            assert np.isclose(r.alpha, alpha, rtol=1e-6), (a, name)
            assert np.allclose(x @ np.array(r.weights) + r.intercept, (x - mean) / scale @ coef + level, atol=1e-5), (a, name)
            assert np.isclose(r.cv_rmse, D.fold_rmse(fit, x, y), rtol=1e-5), (a, name)


def test_fold_residuals_equal_refits(spark):
    from tidemark.operators import linear as LN

    df, names, back = panel(spark)
    for alphas in (None, [10.0]):
        got = {(r.account_id, r.period): r.residual for r in LN.fold_residuals(df, names, alphas=alphas).collect()}
        count = 0
        for a, (x, y) in back.items():
            place, resid = D.fold_residuals(lambda u, v: S.ridge(u, v, S.RIDGE_ALPHAS if alphas is None else np.array(alphas)), x, y)
            for i, r in zip(place, resid):
                assert np.isclose(got[a, f"2020-01-01T{i:04d}"], r, atol=1e-5)
                count += 1
        assert count == len(got)


def from_sums(x, y, **options):
    n, p = x.shape
    z = np.column_stack([x, y])
    z = z - z.mean(0)
    sums = lambda v: [s for i in range(p + 1) for s in [v[:, i].sum(), *[(v[:, i] * v[:, j]).sum() for j in range(i + 1)]]]
    blocks = [(i + 1, 1, sums(z[i:i + 1])) for i in range(n)]
    return S.lasso_from_sums(S.running(blocks, p), n, p)


def test_lasso_tells_of_fits_that_are_not_whole():
    x, y = data(n=5, p=2)
    assert from_sums(x, y)[-1] == "too few rows"
    assert from_sums(*data())[-1] is None
    assert from_sums(data()[0], np.ones(80))[-1] == "constant target"
    out = S.lasso_at(np.eye(1), np.array([1.0]), np.array([1.0, 0.5]))
    assert np.allclose(out, [[0.0, 0.5]])


def test_lasso_path_meets_its_optimality_conditions():
    x, y = data(p=6)
    x = np.column_stack([x, 2 * x[:, 2]])
    z = (x - x.mean(0)) / x.std(0)
    yc = y - y.mean()
    gram, cross = z.T @ z / len(y), z.T @ yc / len(y)
    top = np.abs(cross).max()
    for alpha in np.geomspace(top, top * 1e-3, 30):
        b = S.lasso_at(gram, cross, np.array([top, alpha]))[:, 1]
        g = cross - gram @ b
        assert np.abs(g).max() <= alpha + 1e-8
        assert np.allclose(g[b != 0], alpha * np.sign(b[b != 0]), atol=1e-7)


def test_prequential_equals_refits():
    x, y = data(n=30, p=2)
    place, resid = S.prequential(x, y, [10.0])
    assert place[0] == 15 and place[-1] == 29
    for i, r in zip(place, resid):
        coef, mean, scale, level = refit(x[:i], y[:i], 10.0)
        assert np.isclose(r, y[i] - ((x[i] - mean) / scale @ coef + level))


def test_time_folds_cover_the_end():
    folds = S.time_folds(23, 5)
    assert folds == [(8, 3), (11, 3), (14, 3), (17, 3), (20, 3)]


def test_added_trees_learn_a_step(spark):
    from tidemark.operators import trees as T

    rng = np.random.default_rng(1)
    x = rng.uniform(size=300)
    rows = spark.createDataFrame([(i % 3, f"{2000 + i}-01-01", bool(i >= 240), float(v), 10.0 * float(v > 0.5), 4.0) for i, v in enumerate(x)],
                                 "account_id long, period string, is_test boolean, x double, y double, shared double")
    own = T.client_forest(rows, ["x"], trees=20)
    got = own.join(rows.where("is_test"), ["account_id", "period"]).collect()
    clear = [r for r in got if abs(r.x - 0.5) > 0.1]
    assert len(clear) > 30 and all(abs(r.client_forest - 10 * (r.x > 0.5)) < 2 for r in clear)
    mixed = T.warm_forest(rows.where("is_test"), own, "shared", 60, 20).first()
    assert "warm_forest" in mixed.asDict()


def test_malformed_panel_cells_fail_the_read(spark, tmp_path):

    from tidemark.sources import panel

    good = ["1", "10", "2020-01-01", "5.00", "5.00", "C", "", "", "", ""]
    (tmp_path / "good.tsv").write_text("\t".join(good) + "\n")
    assert panel.read_panel(spark, str(tmp_path / "good.tsv")).count() == 1
    (tmp_path / "bad.tsv").write_text("\t".join(good[:3] + ["abc"] + good[4:]) + "\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        panel.read_panel(spark, str(tmp_path / "bad.tsv")).collect()


def test_sums_of_an_account_do_not_widen_its_rows(spark):
    """The plan of a fit shuffles values, not products: no vectors of products, no aggregate that sorts them."""
    from tidemark.operators import linear as LN

    df, names, _ = panel(spark)
    text = LN.least_squares(df, names)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text and "Join" not in text


def test_prequential_refits_equal_fits_on_all_rows_before():
    """Collinear columns, one that starts late and one of a large level."""
    x, y = data(n=60)
    late = np.where(np.arange(60) < 40, 0.0, 1e6 + np.arange(60))
    x = np.column_stack([x, 4 * x[:, 1], late, 1e8 + x[:, 0]])
    place, resid = S.prequential(x, y)
    assert place.tolist() == list(range(30, 60))
    for i, got in zip(place, resid):
        coef, mean, scale, level = S.ridge(x[:i], y[:i])[:4]
        assert np.isclose(got, y[i] - ((x[i] - mean) / scale @ coef + level), rtol=1e-5, atol=1e-5)


def test_fits_need_known_values(spark):
    from pyspark.errors import PythonException

    from tidemark.operators import gram

    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, None, 3.0), (1, 3.0, 4.0)], "account_id long, x double, y double")
    with pytest.raises(PythonException, match="null or NaN"):
        gram.fit(rows, ["account_id"], ["x"], "y").collect()
    one = rows.where("x is not null").withColumn("account_id", F.when(F.col("y") < 4, F.col("account_id")))
    assert [r.account_id for r in gram.fit(one.unionByName(one), ["account_id"], ["x"], "y").collect()] == [1]


def one_path(gram, cross, floor):
    """The lasso path of one problem, its active block solved anew at every kink."""
    corr, beta = cross.copy(), np.zeros(len(cross))
    alpha, active, left = np.abs(corr).max(), [int(np.argmax(np.abs(corr)))], -1
    alphas, betas = [alpha], [beta.copy()]
    while alpha > floor * (1 + 1e-12):
        move = np.linalg.solve(gram[np.ix_(active, active)], np.sign(corr[active]))
        rate = gram[:, active] @ move
        ways = [((alpha - c) / (1 - r) if r < 1 else np.inf, (alpha + c) / (1 + r) if r > -1 else np.inf) for c, r in zip(corr, rate)]
        joins = [np.inf if j in active or j == left else max(min(w), 0.0) for j, w in enumerate(ways)]
        leaves = [-beta[j] / m if -beta[j] / m > 1e-15 else np.inf for j, m in zip(active, move)]
        step = min(min(joins), min(leaves), alpha - floor)
        beta[active] += step * move
        corr, alpha, left = corr - step * rate, alpha - step, -1
        if min(leaves) <= step:
            left = active.pop(int(np.argmin(leaves)))
            beta[left] = 0.0
        else:
            active.append(int(np.argmin(joins)))
        alphas.append(alpha)
        betas.append(beta.copy())
    return np.array(alphas), np.array(betas)


def problems(count=12, p=9):
    """Correlated features (coefficients also leave), of different lengths and levels."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(count):
        x = rng.normal(size=(20 + 7 * i, p)) @ (np.eye(p) + 0.8 * rng.normal(size=(p, p)))
        x = x - x.mean(0)
        y = x @ rng.normal(size=p) + rng.normal(size=len(x)) * 10 ** (i % 3)
        y = y - y.mean()
        out.append((x.T @ x / len(x), x.T @ y / len(x)))
    return out


def test_paths_followed_together_equal_single_ones():
    grams, crosses = map(np.stack, zip(*problems()))
    floors = np.abs(crosses).max(axis=1) * 1e-3
    found = S.lasso_knots(grams, crosses, floors)
    assert len({len(a) for a, _ in found}) > 1 and any((np.diff((b != 0).sum(axis=1)) < 0).any() for _, b in found)
    for gram, cross, floor, (alphas, betas) in zip(grams, crosses, floors, found):
        plain = one_path(gram, cross, floor)
        assert np.allclose(alphas, plain[0], rtol=1e-9) and np.allclose(betas, plain[1], atol=1e-9 * np.abs(plain[1]).max())


def test_paths_with_dependent_features_end_early():
    """Three features of which one is the sum of the others: a path ends where all would be active, the others go on."""
    gram, cross = problems(1, 2)[0]
    join = np.array([[1.0, 0, 1], [0, 1, 1]])
    whole, part = (np.eye(3), np.array([3.0, 2, 1])), (join.T @ gram @ join, np.array([1.0, -1, 3]) * 5)
    wanted = np.geomspace(15, 15e-3, 30)
    first, second = S.lasso_each([(*whole, wanted), (*part, wanted)])
    assert np.allclose(first, np.sign(whole[1])[:, None] * np.maximum(np.abs(whole[1])[:, None] - wanted, 0))
    assert np.isnan(second).any() and not np.isnan(second[:, 0]).any() and not np.isnan(first).any()


def test_all_paths_of_an_account_are_followed_together(monkeypatch):
    """The fit on all rows, the five in its folds, and the folds of each of these: 36 paths in one call."""
    from tidemark.operators import linear as LN

    x, y = data(n=120)
    calls, plain = [], S.lasso_knots
    monkeypatch.setattr(S, "lasso_knots", lambda *a: calls.append(len(a[0])) or plain(*a))
    monkeypatch.setattr(LN.gram, "keyed", lambda rows, keys: rows)
    monkeypatch.setattr(LN, "_spread", lambda rows: rows)
    bodies = []
    monkeypatch.setattr(LN.gram, "grouped", lambda rows, keys, columns, body, *rest: bodies.append(body))
    LN._family(None, [f"x{i}" for i in range(x.shape[1])], "y", 5, ["ols", "lasso", "ridge"], True)
    out = bodies[0](np.column_stack([x, y]), pa.table({"rn": np.arange(120)}))
    assert calls == [36] and out["model"] == ["ols", "lasso", "ridge"]
