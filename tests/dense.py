"""Plain linear fits on rows, which the fits from product sums are held against."""

import numpy as np

from tidemark.functions.solvers import PATH_DEPTH, PATH_LENGTH, lasso_at, standardise, time_folds


def ols(x, y):
    mean, scale = standardise(x)
    coef = np.linalg.lstsq((x - mean) / scale, y - y.mean(), rcond=1e-10)[0]
    return coef, mean, scale, y.mean()


def lasso(x, y, k=5):
    """Standardised lasso, penalty by mean squared error over expanding folds.

    Penalties that a path does not reach are out of the choice.  The last value says why a fit is not the
    full one: "too few rows" for folds, "constant target" or "path ends early"; else None.
    """
    n = len(y)
    mean, scale = standardise(x)
    z = (x - mean) / scale
    cuts = [(a, b) for a, b in time_folds(n, k) if a >= 2 and b >= 1]
    ends = [a for a, _ in cuts] + [n]
    centres = [(z[:e].mean(axis=0), y[:e].mean()) for e in ends]
    top = np.abs((z - centres[-1][0]).T @ (y - centres[-1][1])).max() / n
    if top <= 0 or not cuts:
        return np.zeros(x.shape[1]), mean, scale, y.mean(), 0.0, "too few rows" if not cuts else "constant target"
    alphas = np.geomspace(top, top * PATH_DEPTH, PATH_LENGTH)
    betas = []
    for end, (c, v) in zip(ends, centres):
        zc, yc = z[:end] - c, y[:end] - v
        betas.append(lasso_at(zc.T @ zc / end, zc.T @ yc / end, alphas))
    errors = np.zeros(PATH_LENGTH)
    for i, (a, b) in enumerate(cuts):
        c, v = centres[i]
        pred = (z[a : a + b] - c) @ betas[i] + v
        errors += ((y[a : a + b, None] - pred) ** 2).mean(axis=0)
    lost = np.isnan(errors) | np.isnan(betas[-1]).any(axis=0)
    best = int(np.argmin(np.where(lost, np.inf, errors)))
    return betas[-1][:, best], mean, scale, y.mean(), float(alphas[best]), "path ends early" if lost.any() else None


def fold_rmse(fit, x, y, k=5):
    """Mean RMSE over expanding folds of ``fit(x, y) -> (coef, mean, scale, level, ...)``."""
    scores = []
    for a, b in time_folds(len(y), k):
        coef, mean, scale, level = fit(x[:a], y[:a])[:4]
        pred = (x[a : a + b] - mean) / scale @ coef + level
        scores.append(np.sqrt(np.mean((y[a : a + b] - pred) ** 2)))
    return float(np.mean(scores))


def fold_residuals(fit, x, y, k=5):
    """Out-of-fold residuals over expanding folds, with the row positions."""
    place, resid = [], []
    for a, b in time_folds(len(y), k):
        coef, mean, scale, level = fit(x[:a], y[:a])[:4]
        place.extend(range(a, a + b))
        resid.extend(y[a : a + b] - ((x[a : a + b] - mean) / scale @ coef + level))
    return np.asarray(place, dtype=int), np.asarray(resid, dtype=float)
