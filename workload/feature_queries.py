"""Features, splits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import baseline as B
from tidemark.operators import features as X
from tidemark.operators import folds as O
from tidemark.operators import metrics as M
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import cut
from workload import adapters as A
from workload import panels
from workload import sqltext as Q
from workload.recurring_queries import GATED_DET
from workload.registry import num, nums, query

WEEK_ALL = Q.WEEKLY + "," + Q.features("weekly", "W").replace("feat as (select *, total_next", "featx as (select *, total_next")

EVENT_DAYS = Q.EVENTS + """,
edays as (select account_id, txn_date period, sum(amount) net_flow, count(*) txn_count,
                 coalesce(sum(case when amount > 0 then amount end), 0) grp_income,
                 coalesce(sum(case when not amount > 0 then amount end), 0) grp_shopping from evl group by 1, 2),
espine as (select account_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) period
           from (select account_id, min(period) lo, max(period) hi from edays group by 1)),
eser as (select s.account_id, s.period, coalesce(net_flow, 0) net_flow, coalesce(txn_count, 0) txn_count,
                coalesce(grp_income, 0) grp_income, coalesce(grp_shopping, 0) grp_shopping,
                sum(coalesce(net_flow, 0)) over (partition by s.account_id order by s.period rows unbounded preceding) end_balance
         from espine s left join edays d on s.account_id = d.account_id and s.period = d.period)"""
EVENT_FEAT = EVENT_DAYS + "," + Q.features("eser", "D", groups=("shopping", "income"))
EVENT_COLS = ("income", "shopping")


def _sql(cols, digits=None, source="allfeat"):
    shown = ", ".join(f'round("{c}", {digits}) "{c}"' if digits else f'"{c}"' for c in cols)
    return f" select account_id, period, {shown} from {source}"


def _matrix(spark, sf):
    return X.feature_matrix(panels.weekly_panel(spark, sf), "W")


def _pick(df, cols, digits=None):
    return df.select("account_id", "period", *[num(c, digits=digits) for c in cols])


W_NAMES = X.feature_names([f"grp_{g}" for g in X.SPEND_GROUPS], "W")
D_NAMES = X.feature_names([f"grp_{g}" for g in EVENT_COLS], "D")
LAG_COLS = [c for c in W_NAMES if c.startswith("nf_lag")]
ROLL_COLS = [c for c in W_NAMES if c.startswith(("nf_roll_mean", "nf_roll_sum"))]
STD_COLS = [c for c in W_NAMES if c.startswith("nf_roll_std")]
GROUP_COLS = [f"{g}_roll{k}" for g in X.SPEND_GROUPS for k in (4, 12)]
FOURIER = [c for c in W_NAMES if c.startswith("fourier")]


@query("f1_calendar", "with " + EVENT_FEAT + _sql(["dow", "is_weekend", "month"]))
def f1(spark, sf):
    return _pick(X.feature_matrix(panels.event_daily(spark, sf), "D"), ["dow", "is_weekend", "month"])


@query("f2_fourier", "with " + WEEK_ALL + _sql(FOURIER, 6))
def f2(spark, sf):
    return _pick(_matrix(spark, sf), FOURIER, 6)


@query("f3_flow_lags", "with " + WEEK_ALL + _sql(LAG_COLS))
def f3(spark, sf):
    return _pick(_matrix(spark, sf), LAG_COLS)


@query("f4_rolling_flow", "with " + WEEK_ALL + " select account_id, period, " + ", ".join(
    [f'"{c}"' for c in ROLL_COLS] + [f'round("{c}", 1) "{c}"' for c in STD_COLS]) + " from allfeat")
def f4(spark, sf):
    return _matrix(spark, sf).select("account_id", "period", *ROLL_COLS, *[num(c, digits=1) for c in STD_COLS])


@query("f5_intensity", "with " + WEEK_ALL + _sql(["txn_roll_mean"]))
def f5(spark, sf):
    return _pick(_matrix(spark, sf), ["txn_roll_mean"])


@query("f6_group_sums", "with " + WEEK_ALL + _sql(GROUP_COLS))
def f6(spark, sf):
    return _pick(_matrix(spark, sf), GROUP_COLS)


@query("f7_since_income", "with " + WEEK_ALL + _sql(["periods_since_income"]))
def f7(spark, sf):
    return _pick(_matrix(spark, sf), ["periods_since_income"])


@query("f8_lagged_balance", "with " + WEEK_ALL + _sql(["balance_lag_1"]))
def f8(spark, sf):
    return _pick(_matrix(spark, sf), ["balance_lag_1"])


DET_ALL = Q.WEEKLY + GATED_DET + "," + Q.features("weekly", "W", det=True)


def _decomposed(spark, sf):
    tx, daily, series = A.ledger_flows(spark, sf), panels.daily_panel(spark, sf), panels.weekly_panel(spark, sf)
    return series, panels.gated_backbone(tx, daily, series, "W")


@query("f9_backbone_signals", "with " + DET_ALL + _sql(["expected_flow", "expected_flow_next"], 6))
def f9(spark, sf):
    series, det = _decomposed(spark, sf)
    return _pick(X.feature_matrix(series, "W", det), ["expected_flow", "expected_flow_next"], 6)


@query("f10_targets", "with " + DET_ALL + _sql(["total_next", "det_next", "y"], 6, "(select *, total_next - det_next y from allfeat)"))
def f10(spark, sf):
    series, det = _decomposed(spark, sf)
    rows = X.with_target(X.feature_matrix(series, "W", det), "residual")
    return _pick(rows, ["total_next", "det_next", "y"], 6)


@query("f11_complete_cases", "with " + DET_ALL + """
select account_id, period, t, n_rows, net_flow, end_balance, round(y, 6) y from feat""")
def f11(spark, sf):
    series, det = _decomposed(spark, sf)
    rows, _ = X.model_rows(series, "W", "residual", det)
    return rows.select("account_id", "period", F.col("t").cast("long").alias("t"), "n_rows", "net_flow",
                       "end_balance", num("y", digits=6))


@query("f11_daily_matrix", "with " + EVENT_FEAT + " select account_id, period, " + ", ".join(
    f'round("{c}", 4) "{c}"' if "std" in c or "mean" in c or "fourier" in c else f'"{c}"' for c in [*D_NAMES, "y"])
    + " from (select *, total_next - det_next y from allfeat)")
def f11_daily(spark, sf):
    rows = X.with_target(X.feature_matrix(panels.event_daily(spark, sf), "D"))
    return rows.select("account_id", "period", *[
        num(c, digits=4 if "std" in c or "mean" in c or "fourier" in c else None) for c in [*D_NAMES, "y"]])


@query("f12_length_gates", "with " + Q.WFEAT + """
select account_id, n_periods, n_rows, count(*) kept from feat where n_periods >= 57 and n_rows >= 37 group by all""")
def f12(spark, sf):
    rows, _ = panels.weekly_rows(spark, sf)
    return X.length_gate(rows, 12 + 45, 12 + 25).groupBy("account_id", "n_periods", "n_rows").agg(
        F.count(F.lit(1)).alias("kept"))


@query("f13_pooling", "with " + Q.WEEKLY + "," + Q.features("weekly", "W") + """
select account_id group_id, account_id, period, coalesce(nf_lag_8, 0) nf_lag_8, coalesce(nf_roll_mean_12, 0) nf_roll_mean_12
from allfeat""")
def f13(spark, sf):
    rows = X.pooled(_matrix(spark, sf), W_NAMES)
    return rows.select("group_id", "account_id", "period", "nf_lag_8", "nf_roll_mean_12")


# ---- splits -------------------------------------------------------------------------------------

@query("e1_temporal_holdout", "with " + Q.WSPLIT + " select account_id, period, rn, n_train, is_test from spl")
def e1(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    return rows.select("account_id", "period", F.col("rn").cast("long").alias("rn"), "n_train", "is_test")


@query("e2_account_holdout", "with " + Q.PLANTED + """,
acc as (select account_id, row_number() over (order by account_id) rank, count(*) over () c from (select distinct account_id from planted))
select account_id, rank, case when rank > c * 5 // 6 then 'unseen' when rank > c * 5 // 6 - c // 7 then 'calibration' else 'train' end "role" from acc""")
def e2(spark, sf):
    accounts = A.ledger_planted(spark, sf).select("account_id").distinct()
    n = accounts.count()
    return O.account_holdout(accounts, n * 5 // 6, n // 7).select("account_id", "rank", "role")


@query("e3_time_folds", "with " + Q.WSPLIT + """,
tr as (select *, rn - 1 - (n_train - 5 * (n_train // 6)) place, n_train // 6 sz from spl where not is_test)
select account_id, period, case when place >= 0 then place // sz end fold,
       case when place >= 0 then n_train - (5 - place // sz) * sz end train_end from tr""")
def e3(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    fold = O.expanding_fold(F.col("rn"), F.col("n_train"), 5)
    return (rows.where(~F.col("is_test")).withColumn("fold", fold)
            .select("account_id", "period", F.col("fold").cast("long").alias("fold"),
                    O.fold_train_end(F.col("fold"), F.col("n_train"), 5).alias("train_end")))


@query("e4_group_folds", "with recursive " + Q.EVENTS + "," + Q.lightest_folds("evl", 5) + """
select account_id, fold_rows, fold from dealt where i > 0""")
def e4(spark, sf):
    return nums(O.group_folds(A.ledger_events(spark, sf), 5))


# ---- scores -------------------------------------------------------------------------------------

NAIVE = Q.WSPLIT + "," + Q.NAIVE
BASE_PREDS = Q.WSPLIT + "," + Q.BEST_WINDOW + """,
preds as (select s.account_id, period, 'baseline' model, total_next y_true,
                 case win when 4 then nf_roll_mean_4 when 8 then nf_roll_mean_8 else nf_roll_mean_12 end y_pred, end_balance anchor
          from spl s join bw using (account_id) where is_test)"""


def _naive(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    return B.naive(rows)


@query("e5_flow_metrics", "with " + NAIVE + f""" select account_id, model, round(sqrt(avg((y_true - y_pred) ** 2)), 4) rmse,
round(avg(abs(y_true - y_pred)), 4) mae, round({Q.R2}, 6) r2 from preds group by 1, 2""")
def e5(spark, sf):
    out = M.flow_metrics(_naive(spark, sf))
    return out.select("account_id", "model", num("rmse", digits=4), num("mae", digits=4), num("r2", digits=6))


@query("e6_mase", "with " + NAIVE + "," + Q.SCALE + """ select account_id, model, round(avg(abs(y_true - y_pred)) / any_value(scale), 6) mase
from preds join scl using (account_id) group by 1, 2""")
def e6(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    return nums(M.mase(B.naive(rows), M.naive_scale(rows)), 6)


@query("e7_pinball", "with " + NAIVE + " select account_id, " + ", ".join(
    f"round(avg(greatest({a} * (y_true - y_pred), ({a} - 1) * (y_true - y_pred))), 4) p{int(a * 100)}" for a in (0.1, 0.5, 0.9))
    + " from preds group by 1")
def e7(spark, sf):
    y, q = F.col("y_true"), F.col("y_pred")
    return _naive(spark, sf).groupBy("account_id").agg(
        *[F.round(M.pinball(y, q, a), 4).alias(f"p{int(a * 100)}") for a in (0.1, 0.5, 0.9)])


@query("e8_coverage", "with " + NAIVE + """ select account_id,
round(avg(case when y_true between y_pred - 50000 and y_pred + 50000 then 1.0 else 0.0 end), 6) coverage from preds group by 1""")
def e8(spark, sf):
    return _naive(spark, sf).groupBy("account_id").agg(
        F.round(M.coverage(F.col("y_true"), F.col("y_pred") - 50000, F.col("y_pred") + 50000), 6).alias("coverage"))


@query("e9_balance_backtest", "with " + NAIVE + """ select account_id, model,
round(sqrt(avg(((anchor + y_true) - (anchor + y_pred)) ** 2)), 4) balance_rmse,
round(avg(abs((anchor + y_true) - (anchor + y_pred))), 4) balance_mae from preds group by 1, 2""")
def e9(spark, sf):
    return nums(M.balance_metrics(_naive(spark, sf)), 4)


SCORED = NAIVE + "," + Q.SCALE + f""",
scores as (select account_id, model, avg(abs(y_true - y_pred)) / any_value(scale) mase, {Q.R2} r2
           from preds join scl using (account_id) group by 1, 2)"""


@query("e10_account_distribution", "with " + SCORED + """ select model, count(*) n_accounts, round(100 * avg((r2 > 0)::int), 6) pct_positive,
round(quantile_cont(r2, 0.25), 6) q25, round(quantile_cont(r2, 0.5), 6) median, round(quantile_cont(r2, 0.75), 6) q75 from scores group by 1""")
def e10(spark, sf):
    return nums(M.account_distribution(M.flow_metrics(_naive(spark, sf)), ["model"], "r2"), 6)


TWO_MODELS = Q.WSPLIT + "," + Q.BEST_WINDOW + "," + Q.SCALE + f""",
preds as (select account_id, 'baseline' model, total_next y_true, net_flow y_pred from spl where is_test
          union all select account_id, 'average', total_next,
                 case win when 4 then nf_roll_mean_4 when 8 then nf_roll_mean_8 else nf_roll_mean_12 end
          from spl s join bw using (account_id) where is_test),
scores as (select account_id, model, avg(abs(y_true - y_pred)) / any_value(scale) mase, {Q.R2} r2
           from preds join scl using (account_id) group by 1, 2)"""


def _two_models(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    preds = B.naive(rows).unionByName(B.moving_average(rows, "W", "average"))
    return rows, preds


@query("e11_benchmark_summary", "with " + TWO_MODELS + """ select model, count(*) n_clients, round(100 * avg((mase < 1)::int), 6) pct_beats_naive,
round(median(mase), 6) median_mase, round(median(r2), 6) median_r2, model = 'average' is_best from scores group by 1""")
def e11(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    rows = rows.join(B.choose_window(rows, "W"), "account_id")
    scores = M.holdout_scores(rows, {"baseline": F.col("net_flow"), "average": B.window_mean("W")})
    return nums(M.benchmark_summary(scores), 6)


@query("e12_pooled_r2", "with " + NAIVE + f" select model, round({Q.R2}, 6) r2 from preds group by 1")
def e12(spark, sf):
    return M.flow_metrics(_naive(spark, sf), ["model"]).select("model", num("r2", digits=6))


@query("e13_track_comparison", "with " + TWO_MODELS + """ select model, round(median(r2) filter (where account_id % 2 = 0), 6) even,
round(median(r2) filter (where account_id % 2 = 1), 6) odd from scores group by 1""")
def e13(spark, sf):
    _, preds = _two_models(spark, sf)
    scores = M.flow_metrics(preds).withColumn("track", F.when(F.col("account_id") % 2 == 0, "even").otherwise("odd"))
    return nums(M.track_comparison(scores, ["even", "odd"]), 6)


@query("e14_flat_accounts", "with " + NAIVE + """ select account_id, round(var_pop(y_true), 0) variance, var_pop(y_true) >= 1e-6 is_scored,
case when var_pop(y_true) < 1e-6 then 'flat holdout' end skip_reason from preds group by 1""")
def e14(spark, sf):
    return nums(M.drop_flat_accounts(_naive(spark, sf)), 0)


# ---- forecasters without weights ----------------------------------------------------------------

@query("m1_moving_average", "with " + BASE_PREDS + " select account_id, period, model, y_true, y_pred, anchor from preds")
def m1(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    return B.moving_average(rows, "W")


@query("m1_window_choice", "with " + BASE_PREDS + " select account_id, cast(win as bigint) \"window\", round(cv, 4) cv_rmse from bw")
def m1_window(spark, sf):
    rows, _ = panels.weekly_split(spark, sf)
    return nums(B.choose_window(rows, "W"), 4)


@query("m2_naive", "with " + NAIVE + " select * from preds")
def m2(spark, sf):
    return _naive(spark, sf)


@query("flagship_naive_mase", "with " + SCORED + " select model, round(median(mase), 6) median_mase, count(*) n_accounts from scores group by 1")
def flagship(spark, sf):
    """Ledger to labels to daily to weekly to features to holdout to the panel's median MASE."""
    rows, _ = panels.weekly_split(spark, sf)
    scores = cut(M.holdout_scores(rows, {"baseline": F.col("net_flow")}).select("model", "mase"))
    middle = exact_quantiles(scores, ["model"], "mase", {"median_mase": 0.5})
    counts = scores.groupBy("model").agg(F.count(F.lit(1)).alias("n_accounts"))
    return middle.join(counts, "model").select("model", num("median_mase", digits=6), "n_accounts")
