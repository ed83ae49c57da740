"""Linear and seasonal forecasters per account."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import linear as LN
from tidemark.operators import metrics as M
from tidemark.operators import seasonal as SE
from tidemark.session import cut
from workload import panels
from workload import sqltext as Q
from workload.registry import num, nums, query

ONE, TWO = ["nf_lag_1"], ["nf_lag_1", "nf_roll_mean_4"]


def split_rows(spark, sf, used=None):
    """Weekly rows with holdout marks, written once: several fits read them.  All features are written, or those ``used``."""
    rows, names = panels.weekly_split(spark, sf)
    return cut(panels.narrowed(rows, names, used)), names


def _weights(df, k):
    w = [num(F.col("weights")[i], f"w{i}", 6) for i in range(k)]
    s = [num(F.col("std_coef")[i], f"s{i}", 2) for i in range(k)]
    return df.select("account_id", "n", *w, *s, num("intercept", digits=2), num("max_abs_coef", digits=2))


@query("m3_ols_one_feature", "with " + Q.WSPLIT + """
select account_id, count(*) n, round(regr_slope(y, nf_lag_1), 6) w0, round(regr_slope(y, nf_lag_1) * stddev_pop(nf_lag_1), 2) s0,
       round(regr_intercept(y, nf_lag_1), 2) intercept, round(abs(regr_slope(y, nf_lag_1) * stddev_pop(nf_lag_1)), 2) max_abs_coef
from spl where not is_test group by 1""")
def m3_one(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    return _weights(LN.least_squares(rows, ONE), 1)


TWO_OLS = Q.WSPLIT + """,
mom as (select account_id, count(*) n, avg(y) my, avg(nf_lag_1) m0, avg(nf_roll_mean_4) m1,
               var_pop(nf_lag_1) v0, var_pop(nf_roll_mean_4) v1, covar_pop(nf_lag_1, nf_roll_mean_4) c,
               covar_pop(nf_lag_1, y) c0, covar_pop(nf_roll_mean_4, y) c1 from spl where not is_test group by 1),
beta as (select *, (v1 * c0 - c * c1) / (v0 * v1 - c * c) b0, (v0 * c1 - c * c0) / (v0 * v1 - c * c) b1 from mom)"""


@query("m3_ols_two_features", "with " + TWO_OLS + """
select account_id, n, round(b0, 6) w0, round(b1, 6) w1, round(b0 * sqrt(v0), 2) s0, round(b1 * sqrt(v1), 2) s1,
       round(my - b0 * m0 - b1 * m1, 2) intercept, round(greatest(abs(b0 * sqrt(v0)), abs(b1 * sqrt(v1))), 2) max_abs_coef from beta""")
def m3_two(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    return _weights(LN.least_squares(rows, TWO), 2)


@query("m3_standardised_ols")
def m3(spark, sf):
    rows, names = split_rows(spark, sf)
    fits = cut(LN.least_squares(rows, names))
    return M.flow_metrics(LN.holdout(rows, fits, names, "ols")).join(
        fits.select("account_id", "max_abs_coef"), "account_id")


@query("m4_lasso")
def m4(spark, sf):
    rows, names = split_rows(spark, sf)
    fits = cut(LN.lasso_cv(rows, names))
    scores = M.flow_metrics(LN.holdout(rows, fits, names, "lasso"))
    kept = F.size(F.filter("weights", lambda w: w != 0)).alias("n_features")
    return scores.join(fits.select("account_id", "alpha", kept), "account_id")


# one feature: the lasso is a soft threshold; penalties by expanding folds as in the fit itself
SOFT = Q.WSPLIT + """,
tr as (select account_id, rn, n_train n, y, nf_lag_1 x, n_train // 6 sz from spl where not is_test),
st as (select account_id, any_value(n) n, any_value(sz) sz, avg(x) mx, stddev_pop(x) sx, avg(y) my, covar_pop(x, y) / stddev_pop(x) zy from tr group by 1),
z as (select t.account_id, rn, y, (x - mx) / sx z, t.n, t.sz from tr t join st using (account_id)),
ends as (select account_id, f, n - (5 - f) * sz a, sz from st, (select unnest(range(5)) f)),
fits as (select e.account_id, f, any_value(a) a, any_value(e.sz) sz, avg(z) cz, avg(y) cy, var_pop(z) g, covar_pop(z, y) c
         from ends e join z on z.account_id = e.account_id and rn <= a group by 1, 2),
pen as (select account_id, i, abs(zy) * power(0.001, i / 99.0) alpha from st, (select unnest(range(100)) i)),
err as (select f.account_id, f.f, p.i, any_value(alpha) alpha,
               avg(power(y - cy - sign(c) * greatest(abs(c) - alpha, 0) / g * (z - cz), 2)) e
        from fits f join pen p on p.account_id = f.account_id join z on z.account_id = f.account_id and rn > a and rn <= a + f.sz group by 1, 2, 3),
tot as (select account_id, i, any_value(alpha) alpha, sum(e) e from err group by 1, 2),
pick as (select account_id, min_by(alpha, (e, i)) alpha from tot group by 1)"""


@query("m4_lasso_one_feature", "with " + SOFT + """
select account_id, round(alpha, 2) alpha, round(sign(zy) * greatest(abs(zy) - alpha, 0) / sx, 5) w0,
       round(my - sign(zy) * greatest(abs(zy) - alpha, 0) / sx * mx, 1) intercept from pick join st using (account_id)""")
def m4_one(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    fits = LN.lasso_cv(rows, ONE)
    return fits.select("account_id", num("alpha", digits=2), num(F.col("weights")[0], "w0", 5), num("intercept", digits=1))


LOO = Q.WSPLIT + """,
tr as (select account_id, period, y, nf_lag_1 x from spl where not is_test),
st as (select account_id, count(*) n, avg(x) mx, stddev_pop(x) sx, avg(y) my, covar_pop(x, y) / stddev_pop(x) zy from tr group by 1),
al as (select i, power(10, -3 + 0.25 * i) alpha from (select unnest(range(25)) i)),
loo as (select t.account_id, i, any_value(alpha) alpha,
               avg(power((y - my - n * zy / (n + alpha) * (x - mx) / sx) / (1 - 1.0 / n - power((x - mx) / sx, 2) / (n + alpha)), 2)) e
        from tr t join st using (account_id), al group by 1, 2),
pick as (select account_id, min_by(alpha, (e, i)) alpha from loo group by 1)"""


@query("m5_ridge_one_feature", "with " + LOO + """
select account_id, round(alpha, 6) alpha, round(n * zy / (n + alpha) / sx, 6) w0,
       round(my - n * zy / (n + alpha) / sx * mx, 2) intercept from pick join st using (account_id)""")
def m5_one(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    fits = LN.ridge_cv(rows, ONE)
    return fits.select("account_id", num("alpha", digits=6), num(F.col("weights")[0], "w0", 6), num("intercept", digits=2))


@query("m5_ridge")
def m5(spark, sf):
    rows, names = split_rows(spark, sf)
    fits = cut(LN.ridge_cv(rows, names))
    scores = M.flow_metrics(LN.holdout(rows, fits, names, "ridge"))
    return scores.join(fits.select("account_id", "alpha"), "account_id")


@query("m6_regularisation_workflow")
def m6(spark, sf):
    rows, names = split_rows(spark, sf)
    chosen = cut(LN.choose_regularised(cut(LN.linear_family(rows, names))))
    scores = M.flow_metrics(LN.holdout(rows, chosen, names, "linear"))
    return scores.join(
        chosen.select("account_id", F.col("model").alias("chosen"), "alpha", "cv_rmse", "ols_max_abs_coef", "regularise"),
        "account_id")


def _seasonal(spark, sf, **options):
    series = cut(panels.weekly_panel(spark, sf))
    first = series.groupBy("account_id").agg(F.date_sub(F.max("period"), 7 * (panels.N_TEST - 1)).alias("first_period"))
    return SE.one_step(series, first, "W", **options)


@query("m10_seasonal_forecast")
def m10(spark, sf):
    return _seasonal(spark, sf)


# one long lag and the last shock: both rounds are regressions on one column
SHOCKS = Q.WSPLIT + """,
ch as (select account_id, period, cast(net_flow as double) x, lag(cast(net_flow as double)) over w before,
              cast(net_flow as double) - lag(cast(net_flow as double)) over w d, period < max(period) over (partition by account_id) - 77 train
       from weekly window w as (partition by account_id order by period)),
lg as (select *, lag(d) over (partition by account_id order by period) a1 from ch),
one as (select account_id, regr_slope(d, a1) b, regr_intercept(d, a1) c from lg where train and a1 is not null group by 1),
sh as (select lg.*, d - c - b * a1 e from lg join one using (account_id)),
sl as (select *, lag(e) over (partition by account_id order by period) e1 from sh),
two as (select account_id, regr_slope(d, e1) b2, regr_intercept(d, e1) c2 from sl where train and e1 is not null group by 1)"""


@query("m10_one_lag", "with " + SHOCKS + """
select account_id, period, round(x, 4) y_true, round(before + c2 + b2 * e1, 1) y_pred from sl join two using (account_id) where not train""")
def m10_one(spark, sf):
    out = _seasonal(spark, sf, long=1, changes=())
    return out.select("account_id", "period", num("y_true", digits=4), num("y_pred", digits=1))


RIDGE10 = """
select account_id, count(*) n, round(covar_pop(nf_lag_1, y) * count(*) / (count(*) + 10) / var_pop(nf_lag_1), 6) w0,
       round(covar_pop(nf_lag_1, y) * count(*) / (count(*) + 10) / stddev_pop(nf_lag_1), 2) s0,
       round(avg(y) - covar_pop(nf_lag_1, y) * count(*) / (count(*) + 10) / var_pop(nf_lag_1) * avg(nf_lag_1), 2) intercept,
       round(abs(covar_pop(nf_lag_1, y) * count(*) / (count(*) + 10) / stddev_pop(nf_lag_1)), 2) max_abs_coef
from spl where not is_test group by 1"""


@query("m14_client_ridge_one_feature", "with " + Q.WSPLIT + RIDGE10)
def m14_one(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    return _weights(LN.client_ridge(rows, ONE), 1)


@query("m14_client_ridge")
def m14(spark, sf):
    rows, names = split_rows(spark, sf)
    return M.flow_metrics(LN.holdout(rows, LN.client_ridge(rows, names), names, "client_only"))


BLEND = Q.WSPLIT + """,
tr as (select account_id, rn, n_train n, least(3, greatest(2, n_train // 12)) k, y, nf_lag_1 x, nf_roll_mean_8 g from spl where not is_test),
fo as (select *, rn - 1 - (n - k * (n // (k + 1))) place, n // (k + 1) sz from tr),
fl as (select *, case when place >= 0 then place // sz else -1 end fold from fo),
fits as (select account_id, f, count(*) c, avg(x) mx, avg(y) my, var_pop(x) vx, covar_pop(x, y) cxy
         from fl, (select unnest(range(3)) f) where f < k and fold < f group by 1, 2),
sc as (select l.account_id, y, g, my + cxy * c / (c + 10) / vx * (x - mx) own from fl l join fits on fits.account_id = l.account_id and f = fold),
mae as (select account_id, i / 10.0 w, avg(abs(y - (i / 10.0 * g + (1 - i / 10.0) * own))) mae from sc, (select unnest(range(11)) i) group by 1, 2)"""


@query("m16_blend_weight", "with " + BLEND + " select account_id, cast(min_by(w, (mae, w)) as double) w from mae group by 1")
def m16(spark, sf):
    rows, _ = split_rows(spark, sf, [*ONE, "nf_roll_mean_8"])
    return LN.blend_weights(rows, ONE, "nf_roll_mean_8")


# ---- attribution of linear fits -----------------------------------------------------------------

RANKED = TWO_OLS + """,
co as (select account_id, 'nf_lag_1' feature, b0 * sqrt(v0) c from beta union all
       select account_id, 'nf_roll_mean_4', b1 * sqrt(v1) from beta)"""


@query("x1_linear_contributions", "with " + RANKED + """
select account_id, feature, round(c, 2) coefficient, round(abs(c), 2) abs_coef,
       row_number() over (partition by account_id order by abs(c) desc, feature) rank from co""")
def x1(spark, sf):
    from tidemark.operators import attribution as AT

    rows, _ = panels.weekly_split(spark, sf)
    return nums(AT.linear_contributions(LN.least_squares(rows, TWO), TWO), 2)


@query("x2_linear_attribution", "with " + TWO_OLS + """
select account_id, feature, round(avg(abs(phi)), 2) mean_abs
from (select s.account_id, 'nf_lag_1' feature, b0 * (nf_lag_1 - m0) phi from spl s join beta using (account_id) where is_test
      union all select s.account_id, 'nf_roll_mean_4', b1 * (nf_roll_mean_4 - m1) from spl s join beta using (account_id) where is_test)
group by 1, 2""")
def x2_linear(spark, sf):
    from tidemark.operators import attribution as AT

    rows, _ = split_rows(spark, sf, TWO)
    return nums(AT.linear_attribution(rows, LN.least_squares(rows, TWO), TWO), 2)


@query("x3_top_features", "with " + RANKED + """
select account_id, feature, round(abs(c), 2) abs_coef
from (select *, row_number() over (partition by account_id order by abs(c) desc, feature) rank from co) where rank <= 1""")
def x3(spark, sf):
    from tidemark.operators import attribution as AT

    rows, _ = panels.weekly_split(spark, sf)
    ranked = AT.linear_contributions(LN.least_squares(rows, TWO), TWO)
    return nums(AT.top_features(ranked, 1).select("account_id", "feature", "abs_coef"), 2)
