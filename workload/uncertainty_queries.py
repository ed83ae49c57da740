"""Bands, conformal calibration and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import baseline as B
from tidemark.operators import conformal as C
from tidemark.operators import folds as O
from tidemark.operators import linear as LN
from tidemark.operators import projection as PJ
from tidemark.operators import recurring as N
from tidemark.operators import trees as T
from tidemark.session import cut
from workload import adapters as A
from workload import panels
from workload import sqltext as Q
from workload.forecast_queries import ONE, split_rows
from workload.model_queries import STUMP
from workload.registry import num, nums, query

LEVELS = "(select unnest([0.5::double, 0.7, 0.8, 0.9, 0.95]) level)"
REL = "least(greatest(abs(coalesce(nf_roll_std_4, 0)) / greatest(ref, 1), 0.6::double), 1.6::double)"

FOLD_RESID = Q.WSPLIT + """,
tr as (select account_id, period, rn, n_train n, y, nf_lag_1 x, rn - 1 - (n_train - 5 * (n_train // 6)) place, n_train // 6 sz from spl where not is_test),
fl as (select *, case when place >= 0 then place // sz else -1 end fold from tr),
fits as (select account_id, f, count(*) c, avg(x) mx, avg(y) my, var_pop(x) vx, covar_pop(x, y) cxy
         from fl, (select unnest(range(5)) f) where fold < f group by 1, 2),
oof as (select l.account_id, period, y - (my + cxy * c / (c + 10) / vx * (x - mx)) residual
        from fl l join fits on fits.account_id = l.account_id and f = fold)"""


@query("u1_marginal_band", "with " + FOLD_RESID + """
select account_id, round(quantile_cont(residual, 0.1), 2) off10, round(quantile_cont(residual, 0.9), 2) off90 from oof group by 1""")
def u1(spark, sf):
    rows, _ = split_rows(spark, sf, ONE)
    return nums(C.marginal_offsets(LN.fold_residuals(rows, ONE, alphas=[10.0])), 2)


@query("u2_prequential_one_feature", "with " + Q.WSPLIT + """,
tr as (select account_id, period, rn, n_train, y, nf_lag_1 x from spl where not is_test),
pre as (select account_id, period, rn, n_train, y, x, count(*) over w c, avg(x) over w mx, avg(y) over w my,
               var_pop(x) over w vx, covar_pop(x, y) over w cxy
        from tr window w as (partition by account_id order by rn rows between unbounded preceding and 1 preceding))
select account_id, period, round(y - (my + cxy * c / (c + 10) / vx * (x - mx)), 1) residual
from pre where rn - 1 >= greatest(8, floor(n_train * 0.5))""")
def u2_one(spark, sf):
    rows, _ = split_rows(spark, sf, ONE)
    return nums(LN.prequential_residuals(rows, ONE, alphas=[10.0]), 1)


@query("u2_prequential_ridge")
def u2(spark, sf):
    rows, names = split_rows(spark, sf)
    return LN.prequential_residuals(rows, names)


REFS = Q.WSPLIT + """,
refs as (select account_id, median(abs(nf_roll_std_4)) ref from spl where not is_test group by 1)"""
SPEC = REFS + f""",
resid as (select account_id, period, total_next - net_flow residual, nf_roll_std_4 from spl
          where not is_test and rn - 1 >= greatest(8, floor(n_train * 0.5))),
scores as (select account_id, ref, abs(residual) / {REL} score from resid join refs using (account_id)),
sorted as (select account_id, any_value(ref) ref, list_sort(list(score)) s, count(*) n from scores group by 1),
pos as (select *, (n - 1) * least(1.0::double, ceil((n + 1) * level) / n) p from sorted, {LEVELS}),
spec as (select account_id, ref, level, s[cast(floor(p) as int) + 1] + (s[cast(ceil(p) as int) + 1] - s[cast(floor(p) as int) + 1]) * (p - floor(p)) margin
         from pos)"""
BANDS = SPEC + f""",
bands as (select s.account_id, period, level, total_next y_true, net_flow y_pred, end_balance anchor,
                 net_flow - margin * {REL} lo, net_flow + margin * {REL} hi
          from spl s join spec using (account_id) where is_test)"""


def naive_residuals(rows):
    late = F.col("rn") - 1 >= F.greatest(F.lit(8), F.floor(F.col("n_train") * 0.5))
    return LN.train_only(rows).where(late).select(
        "account_id", "period", (F.col("total_next") - F.col("net_flow")).alias("residual"))


def _naive_bands(spark, sf):
    rows, _ = split_rows(spark, sf, [C.SIGMA])
    spec = C.prequential_spec(rows, naive_residuals(rows))
    scored = B.naive(rows).join(rows.select("account_id", "period", C.SIGMA), ["account_id", "period"])
    return C.intervals(scored, spec)


@query("u3_volatility_multiplier", "with " + REFS + f"""
select account_id, period, round({REL}, 6) rel from spl join refs using (account_id)""")
def u3(spark, sf):
    rows, _ = split_rows(spark, sf, [C.SIGMA])
    joined = rows.join(C.reference_volatility(rows), "account_id")
    return joined.select("account_id", "period", F.round(C.volatility(F.col("ref"), F.col(C.SIGMA)), 6).alias("rel"))


@query("u4_conformal_margins", "with " + SPEC + " select account_id, level, round(ref, 1) \"ref\", round(margin, 1) margin from spec")
def u4(spark, sf):
    rows, _ = split_rows(spark, sf, [C.SIGMA])
    spec = C.prequential_spec(rows, naive_residuals(rows))
    return spec.select("account_id", "level", num("ref", digits=1), num("margin", digits=1))


@query("u5_adaptive_interval", "with " + BANDS + """
select account_id, period, level, round(lo, 1) lo, round(hi, 1) hi from bands""")
def u5(spark, sf):
    return _naive_bands(spark, sf).select("account_id", "period", "level", num("lo", digits=1), num("hi", digits=1))


GLOBAL = Q.WSPLIT + f""",
ranked as (select account_id, row_number() over (order by account_id) rank from (select distinct account_id from spl)),
cal as (select abs(nf_roll_std_4) nf_roll_std_4, abs(total_next - net_flow) err from spl join ranked using (account_id) where rank between 70 and 83),
gref as (select median(nf_roll_std_4) ref from cal),
sorted as (select any_value(ref) ref, list_sort(list(err / {REL})) s, count(*) n from cal, gref),
pos as (select *, (n - 1) * least(1.0::double, ceil((n + 1) * level) / n) p from sorted, {LEVELS}),
spec as (select ref, level, s[cast(floor(p) as int) + 1] + (s[cast(ceil(p) as int) + 1] - s[cast(floor(p) as int) + 1]) * (p - floor(p)) margin from pos)"""


@query("u6_global_conformal", "with " + GLOBAL + f""",
bands as (select account_id, level, total_next between net_flow - margin * {REL} and net_flow + margin * {REL} inside
          from spl join ranked using (account_id), spec where rank > 83 and is_test)
select level, round(any_value(margin), 1) margin, round(avg(inside::int), 6) coverage from bands join spec using (level) group by 1""")
def u6(spark, sf):
    rows, _ = split_rows(spark, sf, [C.SIGMA])
    roles = O.account_holdout(rows.select("account_id").distinct(), 83, 14)
    marked = cut(rows.join(roles, "account_id").withColumn("prediction", F.col("net_flow")))
    spec = cut(C.global_spec(marked.where("role = 'calibration'")))
    unseen = marked.where("role = 'unseen' and is_test")
    bands = C.global_intervals(unseen, spec, point="prediction")
    scores = bands.groupBy("level").agg(
        F.round(F.avg(F.col("total_next").between(F.col("lo"), F.col("hi")).cast("double")), 6).alias("coverage"))
    return scores.join(spec.select("level", num("margin", digits=1)), "level")


@query("u7_balance_fan", "with " + BANDS + """
select account_id, period, level, round(anchor + lo, 1) lo, round(anchor + hi, 1) hi, round(anchor + y_pred, 1) p50, 'holdout' kind from bands""")
def u7(spark, sf):
    return _rounded_bands(C.balance_fan(_naive_bands(spark, sf)))


@query("u8_width_statistics", "with " + BANDS + """
select account_id, round(quantile_cont(hi - lo, 0.25), 1) width_calm, round(median(hi - lo), 1) width_median, round(max(hi - lo), 1) width_max,
       round(avg((y_true between lo and hi)::int), 1) coverage from bands where level = 0.8 group by 1""")
def u8(spark, sf):
    return nums(C.width_statistics(_naive_bands(spark, sf)), 1)


@query("u8_before_after", "with " + BANDS + """,
off as (select account_id, quantile_cont(residual, 0.1) o1, quantile_cont(residual, 0.9) o9 from resid group by 1),
old as (select s.account_id, avg((total_next between net_flow + o1 and net_flow + o9)::int) coverage_before, max(o9 - o1) width_before
        from spl s join off using (account_id) where is_test group by 1)
select account_id, round(any_value(coverage_before), 6) coverage_before, round(any_value(width_before), 1) width_before,
       round(avg((y_true between lo and hi)::int), 6) coverage_after, round(median(hi - lo), 1) width_median
from bands join old using (account_id) where level = 0.8 group by 1""")
def u8_pair(spark, sf):
    rows, _ = split_rows(spark, sf, [C.SIGMA])
    out = C.before_after(B.naive(rows), C.marginal_offsets(naive_residuals(rows)), _naive_bands(spark, sf))
    return out.select("account_id", num("coverage_before", digits=6), num("width_before", digits=1),
                      num("coverage_after", digits=6), num("width_median", digits=1))


@query("headline_quality")
def headline_quality(spark, sf):
    """Weekly decomposed track: bands of the chosen linear model before and after conformal scaling."""
    return _headline(spark, sf).quality


@query("headline_fan")
def headline_fan(spark, sf):
    """Balances of the holdout and the projection with the backbone, all levels."""
    return _headline(spark, sf).fan


def _headline(spark, sf):
    from tidemark.plans import headline as H

    return H.headline(cut(A.ledger_flows(spark, sf)), cut(panels.daily_panel(spark, sf)))


# pooled trees with one split on the month, one for each block of the later halves of the training rows
BLOCK_STUMPS = Q.WSPLIT + """,
tr as (select account_id, period, "month" m, y, n_train, rn - 1 - greatest(8, floor(n_train * 0.5)) place,
              n_train - greatest(8, floor(n_train * 0.5)) later from spl where not is_test),
st as (select *, case when place >= 0 then floor(place * 5 / later) else -1 end stage from tr),
seen as (select b, m, y from st join (select unnest(range(5)) b) on stage < b),
cuts as (select b, (m + lead(m) over (partition by b order by m)) / 2 cut from (select distinct b, m from seen)),
parts as (select b, cut, avg(y) filter (where m <= cut) lo, avg(y) filter (where m > cut) hi,
                 var_pop(y) filter (where m <= cut) * count(*) filter (where m <= cut) + var_pop(y) filter (where m > cut) * count(*) filter (where m > cut) sse
          from seen join cuts using (b) where cut is not null group by b, cut),
best as (select b, min_by(cut, (sse, cut)) cut, min_by(lo, (sse, cut)) lo, min_by(hi, (sse, cut)) hi from parts group by b),
resid as (select account_id, period, y - case when m <= cut then lo else hi end residual from st join best on b = stage)"""


@query("u2_blocks_one_split", "with " + BLOCK_STUMPS + " select account_id, period, round(residual, 2) residual from resid")
def u2_blocks(spark, sf):
    rows, _ = split_rows(spark, sf, ["month"])
    return nums(_block_residuals(rows), 2)


def _block_residuals(rows):
    config = {"trees": 1, "depth": 1, "leaf": 1, "features": "all", "bootstrap": False}
    return T.staged_residuals(rows, ["month"], T.fit_forest, config, T.later_block(5), 5)


@query("u4_tree_margins", "with " + BLOCK_STUMPS + f""",
refs as (select account_id, median(abs(nf_roll_std_4)) ref from spl where not is_test group by 1),
scores as (select account_id, ref, abs(residual) / {REL} score from resid join spl using (account_id, period) join refs using (account_id)),
sorted as (select account_id, list_sort(list(score)) s, count(*) n from scores group by 1),
pos as (select *, (n - 1) * least(1.0::double, ceil((n + 1) * level) / n) p from sorted, {LEVELS})
select account_id, level, round(s[cast(floor(p) as int) + 1] + (s[cast(ceil(p) as int) + 1] - s[cast(floor(p) as int) + 1]) * (p - floor(p)), 1) margin from pos""")
def u4_tree(spark, sf):
    rows, _ = split_rows(spark, sf, ["month", C.SIGMA])
    return C.prequential_spec(rows, _block_residuals(rows)).select("account_id", "level", num("margin", digits=1))


def _weekly_rows(spark, sf, features=None):
    series = cut(panels.weekly_panel(spark, sf))
    from tidemark.operators import features as X

    rows, names = X.model_rows(series, "W")
    used = features and [*features, C.SIGMA]
    return series, cut(panels.narrowed(O.temporal_split(rows, panels.N_TEST), names, used)), features or names


def _projection_inputs(spark, sf, features=None):
    series, rows, used = _weekly_rows(spark, sf, features)
    fits = LN.client_ridge(rows, used) if features is None else LN.least_squares(rows, used)
    return series, rows, used, fits


@query("u9_monte_carlo_fan")
def u9(spark, sf):
    series, rows, names, fits = _projection_inputs(spark, sf)
    spec = C.prequential_spec(rows, naive_residuals(rows), [0.8]).select("account_id", "ref", "margin")
    start = cut(PJ.seeds(series, "W", N.HORIZON["W"]).join(fits, "account_id").join(spec, "account_id"))
    return PJ.fan(PJ.simulate(start, "W", N.HORIZON["W"], PJ.linear_point(names)))


LAST = Q.WSPLIT + """,
fit as (select account_id, regr_slope(y, nf_lag_1) w, regr_intercept(y, nf_lag_1) i from spl where not is_test group by 1),
lastp as (select account_id, max(period) p0 from weekly group by 1),
seed as (select k.account_id, p0, max(case when period = p0 then cast(net_flow as double) end) f0,
                max(case when period = p0 - 7 then cast(net_flow as double) end) fm,
                max(case when period = p0 then cast(end_balance as double) end) b0
         from weekly k join lastp using (account_id) group by 1, 2),
ch as (select s.account_id, p0, b0, f0, fm, i, w, i + w * fm g1, i + w * f0 g2 from seed s join fit using (account_id)),
ch2 as (select *, i + w * g1 g3, i + w * g2 g4 from ch),
ch3 as (select *, i + w * g3 g5, i + w * g4 g6 from ch2),
ch4 as (select *, i + w * g5 g7, i + w * g6 g8 from ch3),
proj as (select account_id, p0 + cast(7 * k as int) period, k step, b0 + case k when 1 then g1 when 2 then g1+g2 when 3 then g1+g2+g3 when 4 then g1+g2+g3+g4
              when 5 then g1+g2+g3+g4+g5 when 6 then g1+g2+g3+g4+g5+g6 when 7 then g1+g2+g3+g4+g5+g6+g7 else g1+g2+g3+g4+g5+g6+g7+g8 end p50
         from ch4, (select unnest(range(1, 9)) k))"""


@query("u10_recursive_projection", "with " + LAST + " select account_id, period, step, round(p50, 1) p50 from proj")
def u10(spark, sf):
    series, _, names, fits = _projection_inputs(spark, sf, ONE)
    start = PJ.seeds(series, "W", N.HORIZON["W"]).join(fits, "account_id")
    return nums(PJ.recursive(start, "W", N.HORIZON["W"], PJ.linear_point(names)), 1)


# the fan drawn again in SQL: the last four flows go from step to step, noise is the md5 of account, path and step
FLAT = f"2 * pi() * ((cast('0x' || substr(digest, 14, 13) as bigint) + 0.5) / {float(2**52)!r})"
DRAWN = "with recursive " + SPEC + LAST[len(Q.WSPLIT):] + f""",
tail as (select k.account_id, list(cast(net_flow as double) order by period) f from weekly k join lastp using (account_id) where period > p0 - 28 group by 1),
seeded as (select c.account_id, p0, b0, i, w, f, s.ref, margin from ch c join tail using (account_id)
           join spec s on s.account_id = c.account_id and level between 0.79 and 0.81),
sim as (select account_id, p0, i, w, ref, margin, path, 0 as h, f, b0 as b from seeded, (select unnest(range({PJ.PATHS})) path)
        union all
        select account_id, p0, i, w, ref, margin, path, h + 1, list_append(f[2:4], g), b + g from (
          select *, i + w * f[3] + greatest(margin * least(greatest(sd / greatest(ref, 1), 0.6::double), 1.6::double) / {PJ.Z80}, 1)
                    * sqrt(-2 * ln((cast('0x' || substr(digest, 1, 13) as bigint) + 0.5) / {float(2**52)!r})) * cos({FLAT}) g
          from (select *, sqrt(list_sum(list_transform(f, lambda v: power(v - list_sum(f) / 4, 2))) / 3) sd,
                       md5(account_id || ':' || path || ':' || h || ':{PJ.SEED}') digest from sim where h < 8))),
marks as (select account_id, p0 + cast(7 * h as int) period, quantile_cont(b, 0.5) p50,
                 quantile_cont(b, [0.25, 0.15, 0.1, 0.05, 0.025]) lows, quantile_cont(b, [0.75, 0.85, 0.9, 0.95, 0.975]) highs
          from sim where h > 0 group by account_id, p0, h)
select account_id, period, [0.5::double, 0.7, 0.8, 0.9, 0.95][x] "level", round(p50, 1) p50, round(lows[x], 1) lo, round(highs[x], 1) hi, 'projection' kind
from marks, (select unnest(range(1, 6)) x)"""


@query("u9_fan_one_feature", DRAWN)
def u9_one(spark, sf):
    series, rows, names, fits = _projection_inputs(spark, sf, ONE)
    spec = C.prequential_spec(rows, naive_residuals(rows), [0.8]).select("account_id", "ref", "margin")
    start = cut(PJ.seeds(series, "W", N.HORIZON["W"]).join(fits, "account_id").join(spec, "account_id"))
    return _rounded_bands(PJ.fan(PJ.simulate(start, "W", N.HORIZON["W"], PJ.linear_point(names))))


# a pooled tree with one split on the month: a step's forecast depends on the month of the row it starts from
@query("u9_tree_one_split", "with " + STUMP + """,
lastp as (select account_id, max(period) p0, max_by(cast(end_balance as double), period) b0 from weekly group by 1),
stepped as (select account_id, p0, b0, h, case when month(p0 + cast(7 * h as int)) <= cut then lo else hi end g
          from lastp, best, (select unnest(range(8)) h))
select account_id, cast(h + 1 as int) step, p0 + cast(7 * (h + 1) as int) period,
       round(b0 + sum(g) over (partition by account_id order by h), 1) p50 from stepped""")
def u9_tree_one(spark, sf):
    config = {"trees": 1, "depth": 1, "leaf": 1, "features": "all", "bootstrap": False}
    start, model, used = _tree_start(spark, sf, ["month"], config)
    return nums(PJ.recursive(start, "W", N.HORIZON["W"], PJ.model_point(model, used)), 1)


def _tree_start(spark, sf, features, config):
    series, rows, used = _weekly_rows(spark, sf, features)
    model = T.fit_forest(LN.train_only(rows), used, "y", config)
    spec = C.prequential_spec(rows, naive_residuals(rows), [0.8]).select("account_id", "ref", "margin")
    return cut(PJ.seeds(series, "W", N.HORIZON["W"]).join(spec, "account_id")), model, used


SIG = LAST + """,
sig as (select account_id, stddev_samp(total_next - net_flow) sigma from spl where not is_test group by 1),
zt as (select * from (values (0.5::double, 0.674::double), (0.7, 1.036), (0.8, 1.282), (0.9, 1.645), (0.95, 1.960)) t(level, z)),
gb as (select account_id, period, level, p50, p50 - z * sigma * sqrt(step) lo, p50 + z * sigma * sqrt(step) hi, 'projection' kind
       from proj join sig using (account_id), zt)"""


def _gaussian(spark, sf):
    series, rows, names, fits = _projection_inputs(spark, sf, ONE)
    start = PJ.seeds(series, "W", N.HORIZON["W"]).join(fits, "account_id")
    p50 = PJ.recursive(start, "W", N.HORIZON["W"], PJ.linear_point(names))
    sigma = LN.train_only(rows).groupBy("account_id").agg(
        F.stddev_samp(F.col("total_next") - F.col("net_flow")).alias("sigma"))
    return series, PJ.gaussian_bands(p50, sigma)


def _rounded_bands(df):
    return df.select("account_id", "period", "level", num("p50", digits=1), num("lo", digits=1), num("hi", digits=1), "kind")


@query("u11_gaussian_bands", "with " + SIG + """
select account_id, period, level, round(p50, 1) p50, round(lo, 1) lo, round(hi, 1) hi, kind from gb""")
def u11(spark, sf):
    return _rounded_bands(_gaussian(spark, sf)[1])


@query("u12_anchor_row", "with " + SIG + """
select account_id, period, level, round(p50, 1) p50, round(lo, 1) lo, round(hi, 1) hi, kind from gb
union all select account_id, p0, level, round(b0, 1), round(b0, 1), round(b0, 1), 'anchor' from seed, zt""")
def u12(spark, sf):
    series, bands = _gaussian(spark, sf)
    return _rounded_bands(PJ.with_anchor(bands, series))


@query("u13_history_tail", "with " + Q.WEEKLY + """
select account_id, period, cast(end_balance as double) end_balance
from (select *, row_number() over (partition by account_id order by period desc) k from weekly) where k <= 38""")
def u13(spark, sf):
    return nums(PJ.history_tail(panels.weekly_panel(spark, sf), 12))
