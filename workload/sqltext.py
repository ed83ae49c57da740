"""Common table expressions shared by the SQL twins (DuckDB dialect)."""

from __future__ import annotations

GROUPS = ("cash dining groceries health income leisure other savings shopping subscriptions "
          "transfer transport travel utilities").split()

BASE = """
accounts as (select greatest(100, count(*) // 15) n from customer),
base as (
  select * from (
    select o_custkey % (select n from accounts) account_id, cast(o_orderdate as date) txn_date, 0 kind, o_orderkey k1, 0 k2,
           o_orderpriority counterparty, 'order ' || o_orderstatus details,
           cast(cast(o_totalprice as decimal(18,2)) as decimal(18,4)) amount, '' ptype, '' flag
    from orders
    union all
    select o_custkey % (select n from accounts), cast(l_shipdate as date), 1, l_orderkey, l_linenumber,
           p_name, p_type || '|' || l_returnflag,
           cast(-cast(l_extendedprice as decimal(14,2)) * (1 - cast(l_discount as decimal(3,2))) as decimal(18,4)),
           p_type, l_returnflag
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  ) u
)"""

ORDER = "txn_date, kind, k1, k2, counterparty, details, amount"
_NOUNS = {"RING": "shopping", "WIDGET": "subscriptions", "BOLT": "transport", "GEAR": "groceries",
          "GIZMO": "dining", "ROD": "utilities", "ANVIL": "leisure"}


def fallback(cp: str = "counterparty", details: str = "details") -> str:
    return (f"when amount > 0 then 'income' when trim(coalesce({cp},'')) <> '' and not "
            f"starts_with(trim(coalesce({details},'')), '''') and not contains(coalesce({details},''), '516737') "
            f"and not regexp_matches({cp}, '\\p{{Nd}}') then 'transfer' else 'other' end")


LABEL = ("case " + " ".join(
    f"when contains(upper(counterparty || ' || ' || details), '{w}') then '{g}'" for w, g in _NOUNS.items())
    + " " + fallback())

LEDGER = BASE + f""",
ledger as (
  select *, row_number() over (partition by account_id order by {ORDER}) id,
         sum(amount) over (partition by account_id order by {ORDER} rows unbounded preceding) balance,
         {LABEL} spending_group
  from base
)"""

FLOWS = BASE + f""",
flows as (select *, {LABEL} spending_group from base)"""

_GRP = ",\n".join(
    f"coalesce(sum(case when spending_group = '{g}' then amount end), 0) grp_{g}" for g in GROUPS)
GRP_COLS = [f"grp_{g}" for g in GROUPS]
SUMMED = ["net_flow", "txn_count", "debit_sum", "credit_sum", *GRP_COLS]

# daily table of the labelled ledger, gap-filled, balance carried forward
DAILY = FLOWS + f""",
days as (
  select account_id, txn_date period, sum(amount) net_flow, count(*) txn_count,
         coalesce(sum(case when amount < 0 then -amount end), 0) debit_sum,
         coalesce(sum(case when amount >= 0 then amount end), 0) credit_sum,
         {_GRP}
  from flows group by 1, 2
),
spine as (
  select account_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) period
  from (select account_id, min(period) lo, max(period) hi from days group by 1)
),
daily as (
  select s.account_id, s.period, {", ".join(f"coalesce({c}, 0) {c}" for c in SUMMED)},
         sum(coalesce(net_flow, 0)) over (partition by s.account_id order by s.period rows unbounded preceding) end_balance
  from spine s left join days d on s.account_id = d.account_id and s.period = d.period
)"""

WEEKLY = DAILY + f""",
weekly as (
  select account_id, cast(date_trunc('week', period) as date) + 6 period,
         {", ".join(f"cast(sum({c}) as {'bigint' if c == 'txn_count' else 'decimal(38,4)'}) {c}" for c in SUMMED)},
         max_by(end_balance, period) end_balance
  from daily group by 1, 2
)"""

PLANTED = """
planted as (
  select c_custkey account_id,
         make_date(1999 + m // 12, m % 12 + 1, 1) + cast(c_custkey % 25 + (m*7 + c_custkey) % 3 as int) txn_date,
         'MONTHLY ' || c_mktsegment counterparty, 'plan' details,
         cast(cast(abs(c_acctbal) as decimal(16,2)) + 5 as decimal(18,2)) amount, 'income' spending_group
  from customer, (select unnest(range(24)) m)
  union all
  select c_custkey, date '1999-01-01' + cast(c_custkey % 7 + 7*k as int),
         'WEEKLY ' || c_mktsegment, 'plan', cast(-(10 + c_custkey % 50) as decimal(18,2)), 'groceries'
  from customer, (select unnest(range(104)) k)
)"""

EVENTS = """
evl as (
  select user_id account_id, cast(ts as date) txn_date, event_id id, event_type counterparty, props details,
         case when event_type in ('signup', 'purchase') then cast(value as decimal(18,2))
              else -cast(value as decimal(18,2)) end amount
  from events
)"""


def dbl(cols) -> str:
    return ", ".join(f"cast({c} as double) {c}" for c in cols)


def merchant(cp: str = "counterparty", de: str = "details") -> str:
    return (f"substring(trim(regexp_replace(upper(regexp_replace(case when trim(coalesce({cp}, '')) <> '' "
            f"then trim({cp}) else coalesce({de}, '') end, '\\p{{Nd}}', '', 'g')), '[\\s\\p{{Z}}]+', ' ', 'g')), 1, 24)")


def week(day: str) -> str:
    return f"(cast(date_trunc('week', {day}) as date) + 6)"


def rules(src: str, kind: str, n_test: int = 12) -> str:
    """CTEs cuts, keyed, gaps and rules over a labelled ledger ``src``."""
    gated = kind == "gated"
    where = " and spending_group in ('income', 'subscriptions', 'utilities')" if gated else ""
    head = f"""
cuts as (select account_id, {week("max(txn_date)")} - 7 * {n_test - 1} cutoff from {src} group by 1),
keyed as (select s.*, cutoff, {merchant()} "key" from {src} s join cuts using (account_id)
          where txn_date < cutoff{where}),
gaps as (select *, txn_date - lag(txn_date) over (partition by account_id, "key" order by txn_date) gap from keyed),
stats as (select account_id, "key", count(*) n, median(gap) mg, stddev_samp(gap) sg,
                 cast(trunc(median(day(txn_date))) as bigint) md, cast(trunc(median(isodow(txn_date) - 1)) as bigint) mw,
                 median(cast(amount as double)) amount, min(spending_group) first_group
          from gaps group by 1, 2),"""
    if gated:
        return head + """
rules as (select account_id, "key", first_group "group", amount, md day_of_month, n, 'monthly' cadence,
                 cast(0 as bigint) weekday
          from stats where n >= 3 and mg between 20 and 40 and abs(amount) >= 1)"""
    return head + """
votes as (select account_id, "key", min_by(spending_group, (-c, spending_group)) "group"
          from (select account_id, "key", spending_group, count(*) c from keyed group by all) group by all),
rules as (select s.account_id, s."key", v."group", amount, case when mg between 24 and 35 then md else 0 end day_of_month, n,
                 case when mg between 24 and 35 then 'monthly' else 'weekly' end cadence,
                 case when mg between 24 and 35 then 0 else mw end weekday
          from stats s join votes v on s.account_id = v.account_id and s."key" = v."key"
          where s."key" <> '' and n >= 4 and mg > 0 and sg / mg < 0.6 and abs(amount) >= 2
            and (mg between 24 and 35 or mg between 5 and 9))"""


def limits(src: str, horizon: int) -> str:
    return f"""
lim as (select account_id, min({week("txn_date")}) lo, max({week("txn_date")}) + 7 * {horizon} hi from {src} group by 1)"""


OCC = """
monthly as (
  select account_id, "key", cadence, amount, lo, hi, make_date(year(m), month(m), least(day_of_month, day(last_day(m)))) d
  from (select r.*, lo, hi, unnest(generate_series(date_trunc('month', lo), cast(hi as timestamp), interval 1 month)) m
        from rules r join lim using (account_id) where cadence = 'monthly')),
weeklyocc as (
  select account_id, "key", cadence, amount, lo, hi, cast(d as date) d
  from (select r.*, lo, hi,
               unnest(generate_series(cast(lo + cast((weekday - (isodow(lo) - 1) + 7) % 7 as int) as timestamp), cast(hi as timestamp), interval 7 day)) d
        from rules r join lim using (account_id) where cadence = 'weekly')),
occ as (select account_id, "key", cadence, amount, d from monthly where d between lo and hi
        union all select account_id, "key", cadence, amount, d from weeklyocc where d between lo and hi)"""

# backbone over the spine; needs rules, lim, occ and habit(account_id, rate)
DET = """
wspine as (select account_id, cast(unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 7 day)) as date) period from lim),
sched as (select account_id, d + cast(7 - isodow(d) % 7 as int) period, sum(amount) s from occ group by 1, 2),
det as (select w.account_id, w.period, coalesce(h.rate, 0) + coalesce(s.s, 0) det
        from wspine w left join sched s on w.account_id = s.account_id and w.period = s.period
        left join habit h on w.account_id = h.account_id)"""

HABIT = """
hweeks as (select d.account_id, """ + week("period") + """ p, cast(sum(grp_groceries) as double) g, cast(sum(grp_dining) as double) di,
                  cast(sum(grp_transport) as double) tr
           from daily d join cuts using (account_id) where period < cutoff group by 1, 2),
hrates as (select account_id, median(g) groceries, median(di) dining, median(tr) transport from hweeks group by 1),
habit as (select account_id, groceries + dining + transport rate from hrates)"""

LAGS = {"D": (1, 2, 3, 7, 14), "W": (1, 2, 3, 4, 8)}
ROLLS = {"D": (3, 7, 14, 30), "W": (4, 8, 12)}
GROLLS = {"D": (7, 30), "W": (4, 12)}
SPEND = ("groceries", "dining", "transport", "shopping", "subscriptions", "utilities", "savings", "income")


def _run(c: str, k: int) -> str:
    """Sum of the last k values in row order, null until there are k."""
    terms = [f"lag({c}, {i}) over w" for i in range(k - 1, 0, -1)] + [c]
    out = "0.0::double"
    for term in terms:
        out = f"({out} + {term})"
    return out


def features(src: str, freq: str, det: bool = False, groups=SPEND) -> str:
    """CTE feat: every feature, the frame and the target over the series ``src`` (plus det)."""
    period, k = (30.44, 3) if freq == "D" else (4.345, 2)
    cols = []
    if freq == "D":
        cols += ["cast(isodow(period) - 1 as double) dow", "cast(isodow(period) >= 6 as int)::double is_weekend"]
    cols.append("cast(month(period) as double) \"month\"")
    for h in range(1, k + 1):
        arg = f"2 * pi() * {h} / {period} * t"
        cols += [f"sin({arg}) fourier_sin_{h}", f"cos({arg}) fourier_cos_{h}"]
    cols += [f"lag(net_flow, {i}) over w nf_lag_{i}" for i in LAGS[freq]]
    for i in ROLLS[freq]:
        cols += [f"{_run('net_flow', i)} / {i} nf_roll_mean_{i}",
                 f"case when t >= {i - 1} then stddev_samp(net_flow) over (partition by account_id order by period rows between {i - 1} preceding and current row) end nf_roll_std_{i}",
                 f"{_run('net_flow', i)} nf_roll_sum_{i}"]
    r0 = ROLLS[freq][0]
    cols.append(f"{_run('txn_count', r0)} / {r0} txn_roll_mean")
    cols += [f"{_run('grp_' + g, i)} {g}_roll{i}" for g in groups for i in GROLLS[freq]]
    income = "case when grp_income > 0 then t end" if "income" in groups else "null::bigint"
    cols.append(f"cast(t - coalesce(last_value({income} ignore nulls) over "
                "(partition by account_id order by period rows unbounded preceding), -1) as double) periods_since_income")
    cols.append("lag(end_balance) over w balance_lag_1")
    names = [c.split(" ")[-1].strip('"') for c in cols]
    if det:
        cols += ["det expected_flow", "lead(det) over w expected_flow_next"]
        names += ["expected_flow", "expected_flow_next"]
    detcol, join = (", det", " left join det using (account_id, period)") if det else ("", "")
    need = names + ["net_flow", "end_balance", "total_next", "det_next"]
    return f"""
ser as (select account_id, period, cast(net_flow as double) net_flow, cast(end_balance as double) end_balance,
               cast(txn_count as double) txn_count, {", ".join(f"cast(grp_{g} as double) grp_{g}" for g in groups)}{detcol},
               row_number() over (partition by account_id order by period) - 1 t,
               count(*) over (partition by account_id) n_periods
        from {src}{join}),
allfeat as (select account_id, period, t, n_periods, net_flow, end_balance, {", ".join(cols)},
                   lead(net_flow) over w total_next, {"lead(det) over w" if det else "0.0::double"} det_next
            from ser window w as (partition by account_id order by period)),
feat as (select *, total_next - det_next y, count(*) over (partition by account_id) n_rows from allfeat
         where {" and ".join(f'"{c}" is not null' for c in need)})"""


def split(n_test: int = 12) -> str:
    return f"""
spl as (select *, rn > n_train is_test from (
  select *, row_number() over (partition by account_id order by period) rn,
         count(*) over (partition by account_id) - least({n_test}, count(*) over (partition by account_id) // 4) n_train
  from feat))"""


SCALE = """
scl as (select account_id, case when coalesce(step, 0) < 1e-9 then case when lev = 0 then 1.0 else lev end else step end scale
        from (select account_id, avg(ch) step, avg(abs(net_flow)) lev
              from (select account_id, net_flow, abs(net_flow - lag(net_flow) over (partition by account_id order by period)) ch
                    from spl where not is_test) group by 1))"""

# naive predictions of the weekly panel
NAIVE = """
preds as (select account_id, period, 'baseline' model, total_next y_true, net_flow y_pred, end_balance anchor from spl where is_test)"""

R2 = ("case when var_pop(y_true) * count(*) > 0 then 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) "
      "when sum((y_true - y_pred) * (y_true - y_pred)) = 0 then 1.0 else 0.0 end")

BEST_WINDOW = """
kk as (select *, least(5, greatest(2, n_train // 10)) k from spl where not is_test),
ff as (select *, (rn - 1 - (n_train - k * (n_train // (k + 1)))) place, n_train // (k + 1) sz from kk),
fr as (select account_id, place // sz fold, sqrt(avg((total_next - nf_roll_mean_4) ** 2)) w4,
              sqrt(avg((total_next - nf_roll_mean_8) ** 2)) w8, sqrt(avg((total_next - nf_roll_mean_12) ** 2)) w12
       from ff where place >= 0 group by 1, 2),
fw as (select account_id, avg(w4) w4, avg(w8) w8, avg(w12) w12 from fr group by 1),
bw as (select account_id, case when w4 <= w8 and w4 <= w12 then 4 when w8 <= w12 then 8 else 12 end win, least(w4, w8, w12) cv from fw)"""

WFEAT = WEEKLY + "," + features("weekly", "W")
WSPLIT = WFEAT + "," + split()


def lightest_folds(src: str, k: int) -> str:
    """Accounts of ``src`` in falling order of rows, each to the fold with the fewest rows (recursive: dealt)."""
    lightest = "list_position(load, list_min(load))"
    return f"""
sized as materialized (select account_id, count(*) fold_rows, row_number() over (order by count(*) desc, account_id) i from {src} group by 1),
dealt as (select 0::bigint i, null::bigint account_id, 0::bigint fold_rows, -1::bigint fold, {[0] * k}::bigint[] load
          union all
          select sized.i, sized.account_id, sized.fold_rows, {lightest} - 1,
                 list_transform(load, lambda x, j: x + case when j = {lightest} then sized.fold_rows else 0 end)
          from dealt join sized on sized.i = dealt.i + 1)"""
