"""Small dense solvers used inside tasks, on one account's product sums at a time.

Spark partitions the accounts and brings the rows of one together; nothing here knows about Spark.  The calendar
bounds an account's rows.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# ship these functions with the tasks, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The ridge penalties, the length and depth of the lasso path.
RIDGE_ALPHAS = np.logspace(-3, 3, 25)
PATH_LENGTH, PATH_DEPTH = 100, 1e-3


def standardise(x):
    """Column means and population standard deviations (1 where a column is constant)."""
    mean = x.mean(axis=0)
    scale = x.std(axis=0)
    # a column whose spread is rounding noise counts as constant
    scale[scale <= 1e-12 * np.maximum(np.abs(mean), 1.0)] = 1.0
    return mean, scale


def raw_weights(coef, mean, scale, level):
    """Weights and intercept on unscaled features."""
    weights = coef / scale
    return weights, level - weights @ mean


def ridge(x, y, alphas=RIDGE_ALPHAS):
    """Standardised ridge; the penalty with the least leave-one-out squared error wins.

    One decomposition serves every penalty: with z = U diag(s) V' the fit shrinks direction j by
    s_j^2 / (s_j^2 + alpha), and a row's left-out error is its residual over one minus its leverage.
    """
    mean, scale = standardise(x)
    level = y.mean()
    u, s, vt = np.linalg.svd((x - mean) / scale, full_matrices=False)
    uy = u.T @ (y - level)
    alphas = np.atleast_1d(np.asarray(alphas, dtype=float))
    best = 0
    if len(alphas) > 1:
        shrink = (s**2)[:, None] / ((s**2)[:, None] + alphas)
        fit = u @ (shrink * uy[:, None])
        free = 1.0 - 1.0 / len(y) - (u**2) @ shrink
        left_out = ((y - level)[:, None] - fit) / np.maximum(free, 1e-12)
        best = int(np.argmin((left_out**2).mean(axis=0)))
    coef = vt.T @ (s / (s**2 + alphas[best]) * uy)
    return coef, mean, scale, level, float(alphas[best])


def time_folds(n, k=5):
    """(train rows, test rows) of each expanding fold."""
    size = n // (k + 1)
    return [(n - (k - f) * size, size) for f in range(k)]


def alone(gram):
    """Features (per problem of a stack) that vary and are no multiple of an earlier one that varies."""
    diag = np.diagonal(gram, axis1=1, axis2=2)
    usable = diag > 1e-12
    with np.errstate(invalid="ignore"):
        same = np.abs(gram) >= (1 - 1e-10) * np.sqrt(diag[:, :, None] * diag[:, None, :])
    for j in range(1, gram.shape[1]):
        usable[:, j] &= ~(same[:, j, :j] & usable[:, :j]).any(axis=1)
    return usable


def _inverse(gram, active):
    """Inverse of the active block of every problem, zeros elsewhere; infinite where a block is singular."""
    both = active[:, :, None] & active[:, None, :]
    block = np.where(both, gram, 0.0)
    block[:, np.arange(gram.shape[1]), np.arange(gram.shape[1])] += ~active
    out = np.empty_like(block)
    for i, one in enumerate(block):
        try:
            out[i] = np.linalg.inv(one)
        except np.linalg.LinAlgError:
            out[i] = np.inf
    return np.where(both, out, 0.0)


def _times(matrices, vectors):
    return np.matmul(matrices, vectors[:, :, None])[:, :, 0]


def lasso_knots(gram, cross, floor):
    """Exact lasso paths of a stack of problems by homotopy: for each the penalties (falling) and coefficients at its kinks.

    ``gram`` (problems, p, p) and ``cross`` (problems, p) are per-row averages, ``floor`` the penalty where a path ends.
    Between kinks the active coefficients move along one direction that lowers all active correlations together; a kink is a
    feature joining or leaving.  All problems take a step at a time, and the inverse of a problem's active block is
    updated by the feature that joins or leaves: a path alone spends most of its time calling small operations.
    """
    count, p = cross.shape
    usable = alone(gram)
    corr, beta = np.where(usable, cross, 0.0), np.zeros((count, p))
    alpha, left = np.abs(corr).max(axis=1), np.full(count, -1)
    active = np.zeros((count, p), dtype=bool)
    first = np.argmax(np.abs(corr), axis=1)
    active[np.arange(count), first] = True
    inverse, floor = _inverse(gram, active), np.broadcast_to(np.asarray(floor, dtype=float), (count,))
    paths = [([alpha[i]], [beta[i].copy()]) for i in range(count)]
    number, going = np.arange(count), np.ones(count, dtype=bool)
    for _ in range(8 * p):
        if not going.all():
            if not going.any():
                break
            gram, corr, beta, alpha, left, active, inverse, floor, usable, number = (
                v[going] for v in (gram, corr, beta, alpha, left, active, inverse, floor, usable, number))
        every = np.arange(len(number))
        with np.errstate(all="ignore"):
            sign = np.where(active, np.sign(corr), 0.0)
            move = _times(inverse, sign)
            off = np.where(active, sign - _times(gram, move), 0.0)
            worn = np.flatnonzero(~(np.abs(off).max(axis=1) < 1e-6))
            if len(worn):  # the updates have lost digits
                inverse[worn] = _inverse(gram[worn], active[worn])
                move[worn] = _times(inverse[worn], sign[worn])
                off[worn] = np.where(active[worn], sign[worn] - _times(gram[worn], move[worn]), 0.0)
            move = move + _times(inverse, off)
            going = np.isfinite(move).all(axis=1) & (np.abs(move).max(axis=1) <= 1e10)
            rate = _times(gram, move)
            idle = usable & ~active
            idle[every[left >= 0], left[left >= 0]] = False
            level = alpha[:, None]
            join = np.minimum(np.where(rate < 1, (level - corr) / (1 - rate), np.inf), np.where(rate > -1, (level + corr) / (1 + rate), np.inf))
            leave = np.where(active, -beta / move, np.inf)
            join = np.where(idle, np.maximum(join, 0.0), np.inf)
            leave = np.where(leave > 1e-15, leave, np.inf)
            comes, goes = np.argmin(join, axis=1), np.argmin(leave, axis=1)
            soonest, next_gone = join[every, comes], leave[every, goes]
            step = np.minimum(np.minimum(soonest, next_gone), alpha - floor)
            beta = np.where(going[:, None], beta + step[:, None] * move, beta)
            corr = corr - step[:, None] * np.where(usable, rate, 0.0)
        alpha = np.where(going, alpha - step, alpha)
        gone = going & (next_gone <= step) & (next_gone <= soonest)
        beta[every[gone], goes[gone]] = 0.0
        for i in every[going]:
            paths[number[i]][0].append(alpha[i])
            paths[number[i]][1].append(beta[i].copy())
        going = going & (alpha > floor * (1 + 1e-12))
        left = np.where(gone, goes, -1)
        out, new = every[going & gone], every[going & ~gone]
        if len(out):
            j = goes[out]
            column = inverse[out, :, j]
            inverse[out] -= column[:, :, None] * (column / column[np.arange(len(out)), j][:, None])[:, None, :]
            inverse[out, j, :] = inverse[out, :, j] = 0.0
            active[out, j] = False
            going[out] = active[out].any(axis=1)
        if len(new):
            j = comes[new]
            toward = np.where(active[new], gram[new, :, j], 0.0)
            column = _times(inverse[new], toward)
            with np.errstate(all="ignore"):
                rest = gram[new, j, j] - (column * toward).sum(axis=1)
                column[np.arange(len(new)), j] = -1.0
                inverse[new] += column[:, :, None] * (column / rest[:, None])[:, None, :]
            active[new, j] = True
    return [(np.asarray(a), np.asarray(b)) for a, b in paths]


def lasso_each(problems):
    """Coefficients (p, len(wanted)) of every (gram, cross, wanted) for its falling penalties; NaN below the end of a path."""
    out = [np.zeros((len(cross), len(wanted))) for _, cross, wanted in problems]
    some = [i for i, (_, cross, wanted) in enumerate(problems) if np.abs(cross).max() > wanted[-1]]
    if not some:
        return out
    gram, cross, floor = (np.stack([part(problems[i]) for i in some]) for part in (lambda q: q[0], lambda q: q[1], lambda q: q[2][-1]))
    for i, (alphas, betas) in zip(some, lasso_knots(gram, cross, floor)):
        wanted = problems[i][2]
        rising, values = alphas[::-1], betas[::-1]
        at = np.clip(np.searchsorted(rising, wanted, side="right") - 1, 0, max(len(rising) - 2, 0))
        after = np.minimum(at + 1, len(rising) - 1)
        width = rising[after] - rising[at]
        share = np.clip(np.where(width > 0, (wanted - rising[at]) / np.where(width > 0, width, 1.0), 0.0), 0.0, 1.0)
        out[i] = (values[at] + share[:, None] * (values[after] - values[at])).T
        out[i][:, wanted < alphas[-1] * (1 - 1e-9)] = np.nan
    return out


def lasso_at(gram, cross, wanted):
    """``lasso_each`` of one problem."""
    return lasso_each([(gram, cross, wanted)])[0]


def prequential(x, y, alphas=RIDGE_ALPHAS, first=8, share=0.5):
    """Residual of each row in the later part under the ridge fitted on all rows before it.

    The sums of products grow by one row a refit and are decomposed all at once.  They are taken off the means of the
    rows of the first refit: those are in every refit, so no spread is lost to a later level.
    """
    n, p = x.shape
    start = max(first, int(n * share))
    if start >= n:
        return np.empty(0, dtype=int), np.empty(0)
    alphas = np.atleast_1d(np.asarray(alphas, dtype=float))
    z = np.column_stack([x, y])
    shift = z[:start].mean(axis=0)
    z = z - shift
    total, prod = z[:start].sum(axis=0), z[:start].T @ z[:start]
    parts = []
    for i in range(start, n):
        parts.append((total / i, *correlations(total, prod, i, p, shift)[1:]))
        total, prod = total + z[i], prod + np.outer(z[i], z[i])
    found = np.linalg.eigh(np.stack([corr for _, _, corr, _ in parts]))
    resid = np.empty(n - start)
    for j, (mean, scale, _, cross) in enumerate(parts):
        i = start + j
        # components kept as far down as the decomposition is exact
        keep = found[0][j] > 1e-13 * max(found[0][j].max(initial=0.0), 1e-300)
        vals, vecs = found[0][j][keep], found[1][j][:, keep]
        rows = z[: i + 1] - mean
        alpha = alphas[0] if len(alphas) == 1 else alphas[least_left_out(rows[:i], scale, vals, vecs, cross, alphas)]
        coef = vecs @ ((vecs.T @ cross) / (vals + alpha / i))
        resid[j] = rows[i, p] - rows[i, :p] / scale @ coef
    return np.arange(start, n), resid


def centred_sums(z):
    """Means, and the sums and product sums of the rows ``z`` less their means."""
    means = z.mean(axis=0)
    z = z - means
    return means, z.sum(axis=0), z.T @ z


def row_ridge(z, p, alphas):
    """Ridge on rows z = [x, y] from their product sums: raw weights, intercept, standardised coefficients and the
    penalty with the least leave-one-out squared error."""
    means, total, prod = centred_sums(z)
    alpha = alphas[0]
    if len(alphas) > 1:
        alpha = left_out_penalty(z - means, total, prod, len(z), p, alphas)
    coef, mean, scale, level = sums_ridge(total, prod, len(z), p, alpha, means)
    weights, intercept = raw_weights(coef, mean, scale, level)
    return weights, float(intercept), coef, float(alpha)


def fold_ridge_residuals(z, folds, p, k, alphas):
    """Rows tested by a fold 0 .. k - 1 of ``folds`` (-1: only trained on), and their residuals under the ridge on the
    rows of the folds before."""
    place, resid = [], []
    for f in range(k):
        seen, held = z[folds < f], np.flatnonzero(folds == f)
        if len(seen) and len(held):
            weights, intercept, *_ = row_ridge(seen, p, alphas)
            place.append(held)
            resid.append(z[held, p] - (z[held, :p] @ weights + intercept))
    return (np.concatenate(place), np.concatenate(resid)) if place else (np.empty(0, dtype=int), np.empty(0))


def unpacked(sums, p):
    """Sums of z = [x, y] and the matrix of product sums, from a list that has for each variable i in turn the sum of
    z_i and then of z_j z_i for j <= i."""
    total = np.empty(p + 1)
    prod = np.empty((p + 1, p + 1))
    at = 0
    for i in range(p + 1):
        total[i] = sums[at]
        prod[i, : i + 1] = prod[: i + 1, i] = sums[at + 1 : at + 2 + i]
        at += i + 2
    return total, prod


def correlations(total, prod, n, p, shift=None):
    """Means, population deviations (1 where constant), correlations of the features, and their cross terms with the
    target, from sums of variables that ``shift`` was taken off."""
    mean = total / n
    cov = prod / n - np.outer(mean, mean)
    var = np.diag(cov)[:p].copy()
    mean = mean if shift is None else mean + np.asarray(shift, dtype=float)
    # what rounding of the mean leaves of a constant column
    flat = var <= 1e-24 * np.maximum(mean[:p] ** 2, 1.0)
    scale = np.where(flat, 1.0, np.sqrt(np.maximum(var, 0.0)))
    corr = cov[:p, :p] / np.outer(scale, scale)
    corr[flat, :] = corr[:, flat] = 0.0
    cross = np.where(flat, 0.0, cov[:p, p] / scale)
    return mean, scale, corr, cross


def components(corr):
    """Eigenvalues and vectors, and which of them are more than rounding noise."""
    vals, vecs = np.linalg.eigh(corr)
    return vals, vecs, vals > 1e-9 * max(vals.max(initial=0.0), 1e-300)


def gram_ridge(sums, n, p, alpha, shift=None):
    """Standardised ridge (alpha 0: least squares) from the sums of z = [x, y] and its products (see ``unpacked``)."""
    return sums_ridge(*unpacked(sums, p), n, p, alpha, shift)


def sums_ridge(total, prod, n, p, alpha, shift=None):
    mean, scale, corr, cross = correlations(total, prod, n, p, shift)
    vals, vecs, keep = components(corr)
    inverse = np.where(keep, 1.0 / np.where(keep, vals + alpha / n, 1.0), 0.0)
    coef = vecs @ (inverse * (vecs.T @ cross))
    return coef, mean[:p], scale, mean[p]


def least_left_out(centred, scale, vals, vecs, cross, alphas):
    """Place of the penalty with the least leave-one-out squared error, ties to the first, from the centred rows [x, y]
    and the components of the correlations of x.

    ``at`` has a row's place on the components, with unit length over all rows: its fitted value and its leverage
    (less 1/n) at a penalty are that and its squares, weighed by how far the penalty shrinks each component.
    """
    n, p = len(centred), len(scale)
    length = np.sqrt(n * vals)
    at = centred[:, :p] @ (vecs / scale[:, None] / length)
    shrink = (n * vals)[:, None] / ((n * vals)[:, None] + np.asarray(alphas))
    toward = n * (vecs.T @ cross) / length
    free = 1.0 - 1.0 / n - (at**2) @ shrink
    errors = (centred[:, p][:, None] - at @ (shrink * toward[:, None])) / np.maximum(free, 1e-12)
    return int(np.argmin((errors**2).mean(axis=0)))


def left_out_penalty(centred, total, prod, n, p, alphas):
    """The penalty of ``least_left_out`` from the centred rows [x, y] and the sums of their products."""
    _, scale, corr, cross = correlations(total, prod, n, p)
    vals, vecs, keep = components(corr)
    return float(alphas[least_left_out(centred, scale, vals[keep], vecs[:, keep], cross, alphas)])


def fold_error(total, prod, n, weights, intercept):
    """Mean squared error of fits (one a column of ``weights``) over rows of which only the sums are known."""
    v = np.vstack([-weights, np.ones((1, weights.shape[1]))])
    return np.maximum((v * (prod @ v)).sum(axis=0) - 2 * intercept * (v.T @ total) + n * intercept**2, 0.0) / n


def running(blocks, p):
    """Sums of all rows up to each end, from (end, rows, sums) of the blocks between ends in order."""
    total, prod, out = np.zeros(p + 1), np.zeros((p + 1, p + 1)), {0: (np.zeros(p + 1), np.zeros((p + 1, p + 1)))}
    for end, _, sums in blocks:
        t, m = unpacked(sums, p)
        total, prod = total + t, prod + m
        out[end] = total, prod
    return out


def running_rows(z, n, k, nested=False):
    """``running`` over the ordered, centred rows z = [x, y]: at the ends of ``k`` expanding folds and their test rows,
    with ``nested`` also at those of the folds that each fold's own training rows are cut into."""
    ends = {n, *[e for a, b in time_folds(n, k) for e in (a, a + b)]}
    if nested:
        ends |= {e for a, _ in time_folds(n, k) for c, d in time_folds(a, k) for e in (c, c + d)}
    total, prod = np.zeros(z.shape[1]), np.zeros((z.shape[1], z.shape[1]))
    out, last = {0: (total, prod)}, 0
    for end in sorted(e for e in ends if e > 0):
        block = z[last:end]
        total, prod, last = total + block.sum(axis=0), prod + block.T @ block, end
        out[end] = total, prod
    return out


def later_error(upto, start, rows, weights, intercept):
    """``fold_error`` over the ``rows`` rows after the first ``start``."""
    before, after = upto[start], upto[start + rows]
    return fold_error(after[0] - before[0], after[1] - before[1], rows, weights, intercept)


def ols_from_sums(upto, n, p):
    """Standardised least squares on the first ``n`` rows: (coef, mean, scale, alpha, reason)."""
    mean, scale, corr, cross = correlations(*upto[n], n, p)
    vals, vecs, keep = components(corr)
    return vecs @ (np.where(keep, 1.0 / np.where(keep, vals, 1.0), 0.0) * (vecs.T @ cross)), mean, scale, 0.0, None


def lassos_from_sums(upto, sizes, p, k=5):
    """Standardised lasso on the first n rows for every n of ``sizes``, penalty by mean squared error over expanding folds
    of those rows.  All paths are followed together.

    Penalties that a path does not reach are out of the choice.  The last value says why a fit is not the full one:
    "too few rows" for folds, "constant target" or "path ends early"; else None.
    """
    fits, problems = [], []
    for n in sizes:
        folds = [(a, b) for a, b in time_folds(n, k) if a >= 2 and b >= 1]
        mean, scale, corr, cross = correlations(*upto[n], n, p)
        top = np.abs(cross).max(initial=0.0)
        alphas = np.geomspace(top, top * PATH_DEPTH, PATH_LENGTH) if top > 0 and folds else None
        fits.append((folds, mean, scale, alphas, len(problems)))
        if alphas is None:
            continue
        for a, _ in folds:
            total, prod = upto[a]
            middle = total / a
            cov = prod / a - np.outer(middle, middle)
            problems.append((cov[:p, :p] / np.outer(scale, scale), cov[:p, p] / scale, alphas))
        problems.append((corr, cross, alphas))
    paths = lasso_each(problems)
    out = []
    for folds, mean, scale, alphas, at in fits:
        if alphas is None:
            out.append((np.zeros(p), mean, scale, 0.0, "too few rows" if not folds else "constant target"))
            continue
        errors = np.zeros(PATH_LENGTH)
        for (a, b), betas in zip(folds, paths[at:]):
            middle, w = upto[a][0] / a, betas / scale[:, None]
            errors += later_error(upto, a, b, w, middle[p] - middle[:p] @ w)
        betas = paths[at + len(folds)]
        lost = np.isnan(errors) | np.isnan(betas).any(axis=0)
        best = int(np.argmin(np.where(lost, np.inf, errors)))
        out.append((betas[:, best], mean, scale, float(alphas[best]), "path ends early" if lost.any() else None))
    return out


def lasso_from_sums(upto, n, p, k=5):
    """``lassos_from_sums`` on the first ``n`` rows."""
    return lassos_from_sums(upto, [n], p, k)[0]


def fold_rmse(fit, upto, n, p, k=5):
    """Mean RMSE over expanding folds of a fit from sums, made anew on the rows before each fold."""
    scores = []
    for a, b in time_folds(n, k):
        coef, mean, scale, *_ = fit(upto, a, p)
        w = (coef / scale)[:, None]
        scores.append(np.sqrt(later_error(upto, a, b, w, mean[p] - mean[:p] @ w)[0]) if b else np.nan)
    return float(np.mean(scores))
