"""Pooled models and end-to-end workflows.

Forests, boosting and the tuning grids have their published sizes; fits of folds and settings run together.  All
models see every row of every account.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import attribution as AT
from tidemark.operators import linear as LN
from tidemark.operators import metrics as M
from tidemark.operators import trees as T
from tidemark.plans import generalization as G
from tidemark.plans import newclient as NC
from tidemark.plans import tracks as TR
from tidemark.session import cut
from workload import adapters as A
from workload import panels
from workload import sqltext as Q
from workload.forecast_queries import split_rows
from workload.registry import num, nums, query

FOREST = T.FOREST
SETTINGS = NC.SETTINGS


def _pooled_scores(spark, sf, fit, config, name):
    rows, names = split_rows(spark, sf)
    model = fit(LN.train_only(rows), names, "y", config)
    scored = T.predict(rows, model, names)
    return M.holdout_scores(scored, {name: F.col("prediction"), "baseline": F.col("net_flow")})


@query("m7_random_forest")
def m7(spark, sf):
    return _pooled_scores(spark, sf, T.fit_forest, FOREST, "random_forest")


@query("m8_gradient_boosting")
def m8(spark, sf):
    return _pooled_scores(spark, sf, T.fit_boosting, T.BOOSTING, "gradient_boosting")


# one split of the pooled training rows on the month: the cut with the least squared error (ties: the first)
STUMP = Q.WSPLIT + """,
tr as (select "month" m, y from spl where not is_test),
cuts as (select (m + lead(m) over (order by m)) / 2 cut from (select distinct m from tr)),
parts as (select cut, avg(y) filter (where m <= cut) lo, avg(y) filter (where m > cut) hi,
                 var_pop(y) filter (where m <= cut) * count(*) filter (where m <= cut) + var_pop(y) filter (where m > cut) * count(*) filter (where m > cut) sse
          from tr, cuts where cut is not null group by cut),
best as (select min_by(cut, (sse, cut)) cut, min_by(lo, (sse, cut)) lo, min_by(hi, (sse, cut)) hi from parts)"""


@query("m7_one_split", "with " + STUMP + """
select account_id, period, round(case when "month" <= cut then lo else hi end, 4) prediction from spl, best where is_test""")
def m7_one(spark, sf):
    rows, _ = split_rows(spark, sf, ["month"])
    model = T.fit_forest(LN.train_only(rows), ["month"], "y", {"trees": 1, "depth": 1, "leaf": 1, "features": "all", "bootstrap": False})
    return nums(T.predict(rows.where("is_test"), model, ["month"]).select("account_id", "period", "prediction"), 4)


@query("m8_two_rounds", "with " + STUMP + """,
left_over as (select m, 2 * (y - case when m <= cut then lo else hi end) r from tr, best),
parts2 as (select cut, avg(r) filter (where m <= cut) lo, avg(r) filter (where m > cut) hi,
                  var_pop(r) filter (where m <= cut) * count(*) filter (where m <= cut) + var_pop(r) filter (where m > cut) * count(*) filter (where m > cut) sse
           from left_over, cuts where cut is not null group by cut),
best2 as (select min_by(cut, (sse, cut)) cut2, min_by(lo, (sse, cut)) lo2, min_by(hi, (sse, cut)) hi2 from parts2)
select account_id, period, round(case when "month" <= cut then lo else hi end + 0.1 * case when "month" <= cut2 then lo2 else hi2 end, 4) prediction
from spl, best, best2 where is_test""")
def m8_two(spark, sf):
    rows, _ = split_rows(spark, sf, ["month"])
    config = {"rounds": 2, "depth": 1, "rate": 0.1, "subsample": 1.0, "leaf": 1}
    model = T.fit_boosting(LN.train_only(rows), ["month"], "y", config)
    return nums(T.predict(rows.where("is_test"), model, ["month"]).select("account_id", "period", "prediction"), 4)


@query("m9_tree_choice")
def m9(spark, sf):
    rows, names = split_rows(spark, sf)
    return T.choose_tree(rows, names)


def _bench(spark, sf, settings=SETTINGS, features=None):
    weekly = cut(panels.weekly_panel(spark, sf))
    n = weekly.select("account_id").distinct().count()
    return NC.benchmark(weekly, n * 5 // 6, n // 7, settings, features)


# roles and gates of the new-client benchmark, and account folds, over the weekly rows
ROLES = Q.WSPLIT + """,
acc as (select account_id, row_number() over (order by account_id) place, count(*) over () n from (select distinct account_id from weekly)),
gated as (select s.*, case when place > n * 5 // 6 then 'unseen' when place > n * 5 // 6 - n // 7 then 'calibration' else 'train' end role
          from spl s join acc using (account_id) where n_periods >= 57 and n_rows >= 37)"""


def _folds(src: str, k: int) -> str:
    return Q.lightest_folds(src, k) + f""",
folded as (select r.*, fold from {src} r join dealt using (account_id))"""


# slope and intercept of MLlib's standardised ridge with one feature
def _ridge(alpha: str, where: str = "true") -> str:
    return (f"covar_samp(nf_lag_1, y) / var_samp(nf_lag_1) * (count(*) - 1) / (count(*) - 1 + {alpha}) b, avg(nf_lag_1) mx, avg(y) my")


@query("m11_global_zero_shot")
def m11(spark, sf):
    return NC.zero_shot(_bench(spark, sf))


@query("m11_benchmark_summary")
def m11_summary(spark, sf):
    return M.benchmark_summary(NC.zero_shot(_bench(spark, sf)))


ZERO_SHOT = ROLES + """,
fit as (select """ + _ridge("10") + """ from gated where role = 'train'),
scl as (select account_id, case when coalesce(step, 0) < 1e-9 then case when lev = 0 then 1.0 else lev end else step end scale
        from (select account_id, avg(ch) step, avg(abs(net_flow)) lev
              from (select account_id, net_flow, abs(net_flow - lag(net_flow) over (partition by account_id order by period)) ch
                    from gated where not is_test) group by 1)),
preds as (select account_id, 'linear' model, total_next y_true, my + b * (nf_lag_1 - mx) y_pred from gated, fit where role = 'unseen' and is_test
          union all select account_id, 'baseline', total_next, net_flow from gated where role = 'unseen' and is_test)"""


@query("m11_linear_one_feature", "with " + ZERO_SHOT + f"""
select account_id, model, round(sqrt(avg((y_true - y_pred) ** 2)), 3) rmse, round(avg(abs(y_true - y_pred)) / any_value(scale), 6) mase, round({Q.R2}, 6) r2
from preds join scl using (account_id) group by 1, 2""")
def m11_one(spark, sf):
    scores = NC.zero_shot(_bench(spark, sf, {"linear": {"alpha": 10.0}}, ["nf_lag_1"])).where("model <> 'seasonal'")
    return scores.select("account_id", "model", num("rmse", digits=3), num("mase", digits=6), num("r2", digits=6))


CLIENT = ZERO_SHOT + """,
own as (select account_id, covar_pop(nf_lag_1, y) * count(*) / (count(*) + 10) / var_pop(nf_lag_1) b, avg(nf_lag_1) mx, avg(y) my
        from gated where role = 'unseen' and not is_test group by 1),
strat as (select account_id, 'cold' model, y_true, y_pred from preds where model = 'linear'
          union all select g.account_id, 'client_only', total_next, my + b * (nf_lag_1 - mx)
          from gated g join own using (account_id) where role = 'unseen' and is_test),
sc as (select account_id, model, avg(abs(y_true - y_pred)) / any_value(scale) mase from strat join scl using (account_id) group by 1, 2)"""


@query("m17_linear_one_feature", "with " + CLIENT + """
select model, round(median(mase), 6) median_mase, round(100 * avg((mase < 1)::int), 6) pct_beats_naive, count(*) n_clients from sc group by 1""")
def m17_one(spark, sf):
    bench = _bench(spark, sf, {"linear": {"alpha": 10.0}}, ["nf_lag_1"])
    out = NC.warm_start(bench, shared="linear", repeats=1).where("model in ('cold', 'client_only')")
    return out.select("model", num("median_mase", digits=6), num("pct_beats_naive", digits=6), "n_clients")


@query("m11_global_bands")
def m11_bands(spark, sf):
    return NC.band_scores(_bench(spark, sf, {"linear": {"alpha": 10.0}}), "linear")


def _tuning_rows(spark, sf):
    weekly = cut(panels.weekly_panel(spark, sf))
    n = weekly.select("account_id").distinct().count()
    _, rows, names = NC.with_roles(weekly, n * 5 // 6, n // 7)
    return NC.tuning_rows(rows), names


@query("m12_linear_one_feature", "with recursive " + ROLES + ",\ntr as (select * from gated where role = 'train' and not is_test)," + _folds("tr", 3) + """,
steps as (select avg(abs(c)) scale from (select y - lag(y) over (partition by account_id order by period) c from tr)),
grid as (select unnest([1.0, 10.0, 100.0]) alpha, unnest(range(3)) i),
fits as (select alpha, f, """ + _ridge("alpha") + """ from folded, grid, (select unnest(range(3)) f) where fold <> f group by alpha, f),
errs as (select alpha, f, avg(abs(y - my - b * (nf_lag_1 - mx))) e from folded join fits on fold = f group by 1, 2)
select 'linear' family, '{''alpha'': ' || cast(cast(alpha as decimal(6,1)) as varchar) || '}' config, round(avg(e) / any_value(scale), 6) mase
from errs, steps group by alpha""")
def m12_one(spark, sf):
    rows, _ = _tuning_rows(spark, sf)
    return nums(T.tune(rows, ["nf_lag_1"], "linear").select("family", "config", "mase"), 6)


@query("m12_capacity_tuning")
def m12(spark, sf):
    """The published grids of pooled ridge and boosting over account folds, with the knee of each."""
    rows, names = _tuning_rows(spark, sf)
    return T.tune(rows, names, "linear").unionByName(T.tune(rows, names, "boosted_trees"))


@query("m12_forest_tuning")
def m12_forest(spark, sf):
    """The published grid of the forest, a query of its own for its time."""
    return T.tune(*_tuning_rows(spark, sf), "random_forest")


@query("m11_tuned_linear")
def m11_tuned(spark, sf):
    """Tuned first, then fitted at the knee, then scored on unseen clients (the family that is quick to sweep)."""
    weekly = cut(panels.weekly_panel(spark, sf))
    n = weekly.select("account_id").distinct().count()
    _, bench = NC.tuned_benchmark(weekly, n * 5 // 6, n // 7, ["linear"])
    return NC.zero_shot(bench)


@query("m13_per_account_decomposed")
def m13(spark, sf):
    return G.per_account(A.ledger_flows(spark, sf), cut(panels.daily_panel(spark, sf)), FOREST)


@query("m13_unseen_linear_one_feature", "with recursive " + Q.WSPLIT + "," + _folds("spl", 3) + """,
fits as (select f, """ + _ridge("10") + """ from folded, (select unnest(range(3)) f) where fold <> f group by f),
preds as (select y y_true, my + b * (nf_lag_1 - mx) y_pred from folded join fits on fold = f)
select 'linear' model, round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 6) r2, count(*) n from preds""")
def m13_one(spark, sf):
    rows, _ = split_rows(spark, sf, ["nf_lag_1"])
    return nums(T.pooled_r2(T.out_of_fold(rows, ["nf_lag_1"], "linear", {"alpha": 10.0}, 3)), 6)


@query("m13_leave_accounts_out")
def m13_unseen(spark, sf):
    rows, names = split_rows(spark, sf)
    return G.leave_accounts_out(rows, names)


@query("m15_warm_forest")
def m15(spark, sf):
    bench = _bench(spark, sf, {"random_forest": SETTINGS["random_forest"]})
    return NC.strategies(bench)["warm_forest"]().select(
        "account_id", "period", "total_next", "random_forest", "warm_forest")


@query("m17_warm_start_cost")
def m17(spark, sf):
    return NC.warm_start(_bench(spark, sf, {"random_forest": SETTINGS["random_forest"]}))


def _track(spark, sf, freq, mode, tree):
    tx, daily = cut(A.ledger_flows(spark, sf)), cut(panels.daily_panel(spark, sf))
    return TR.run_grid(tx, daily, freqs=(freq,), modes=(mode,), tree=tree)


@query("m18_weekly_direct_track")
def m18_direct(spark, sf):
    return _track(spark, sf, "W", "direct", "choose")


@query("m18_weekly_decomposed_track")
def m18_decomposed(spark, sf):
    return _track(spark, sf, "W", "decomposed", "choose")


@query("m18_weekly_agnostic_track")
def m18_agnostic(spark, sf):
    return _track(spark, sf, "W", "decomp_agnostic", "choose")


@query("m18_daily_direct_track")
def m18_daily_direct(spark, sf):
    return _track(spark, sf, "D", "direct", "forest")


@query("m18_daily_decomposed_track")
def m18_daily_decomposed(spark, sf):
    return _track(spark, sf, "D", "decomposed", "forest")


@query("m18_daily_agnostic_track")
def m18_daily_agnostic(spark, sf):
    return _track(spark, sf, "D", "decomp_agnostic", "forest")


def _grid(spark, sf, **options):
    tx, daily = cut(A.ledger_flows(spark, sf)), cut(panels.daily_panel(spark, sf))
    return TR.run_grid(tx, daily, tree="forest", **options)


@query("e13_weekly_tracks")
def e13_tracks(spark, sf):
    """Median R2 of each model by weekly track: direct against both decompositions."""
    return M.track_comparison(_grid(spark, sf, freqs=("W",)), [f"W-{m}" for m in TR.MODES])


@query("e13_best_per_frequency")
def e13_best(spark, sf):
    """Of the six tracks, the best track and learned model of each frequency."""
    return TR.best_per_frequency(_grid(spark, sf))


@query("x2_tree_attribution")
def x2(spark, sf):
    rows, names = split_rows(spark, sf)
    model = T.fit_forest(LN.train_only(rows), names, "y", FOREST)
    phi = AT.tree_attribution(rows.where("is_test"), model, names, average=True)
    return AT.mean_attribution(phi, names)
