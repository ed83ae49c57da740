"""Sources, labels and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import rollup as R
from tidemark.session import cut, fresh_path
from tidemark.sources import panel as P
from tidemark.sources import sinks as K
from tidemark.sources import statements as S
from workload import adapters as A
from workload import sqltext as Q
from workload.registry import num, nums, query

SHEET_SQL = Q.LEDGER + """,
cents as (select *, cast(round(amount, 2) as decimal(18,2)) cents from ledger),
runs as (select *, sum(cents) over (partition by account_id order by id rows unbounded preceding) run,
                year(txn_date) file_seq from cents),
files as (select account_id, file_seq, min_by(run - cents, id) opening, max_by(run, id) closing
          from runs group by 1, 2)"""
PARSED = """
select account_id, cast(file_seq as bigint) file_seq, cast({rowid} as bigint) {rowname}, txn_date,
       trim(counterparty) counterparty, details,
       cast(cents as double) amount, case when id % 10 = 0 then null else cast(run as double) end balance
from runs"""


@query("s1_parse_statements", "with " + SHEET_SQL + PARSED.format(rowid="id", rowname="row_seq"))
def s1(spark, sf):
    return nums(S.parse_rows(A.sheet_rows(spark, sf)))


@query("s2_continuity_audit", "with " + SHEET_SQL + """,
shifted as (select account_id, file_seq, opening + case when file_seq = 1998 then 1 else 0 end opening, closing from files),
lagged as (select *, lag(closing) over (partition by account_id order by file_seq) previous_closing from shifted)
select account_id, cast(file_seq as bigint) file_seq, cast(opening as double) opening, cast(closing as double) closing,
       cast(previous_closing as double) previous_closing,
       coalesce(abs(previous_closing - opening) >= 0.01, false) is_break
from lagged""")
def s2(spark, sf):
    return nums(S.continuity(A.sheet_rows(spark, sf, shifted_year=1998)))


@query("s3_statement_union", "with " + SHEET_SQL + """
select account_id, cast(id as bigint) id, txn_date, trim(counterparty) counterparty, details,
       cast(cents as double) amount, case when id % 10 = 0 then null else cast(run as double) end balance
from runs""")
def s3(spark, sf):
    sheet = A.sheet_rows(spark, sf)
    early, late = sheet.where("file_seq <= 1998"), sheet.where("file_seq > 1998")
    return nums(S.ledger(late, early))


PANEL_SQL = Q.LEDGER + """,
raw as (
  select id trans_id, account_id, txn_date, amount, balance, case when amount > 0 then 'C' else 'D' end typ,
         case flag when 'A' then 'WIC' when 'N' then 'ROB' when 'R' then 'CCW' else '' end op,
         case ptype when 'ECONOMY' then 'HH' when 'SMALL' then 'IC' when 'MEDIUM' then 'ST' when 'LARGE' then 'LO' else '' end sym,
         case when k1 % 3 <> 0 then counterparty else '' end partner
  from ledger
),
panel as (
  select account_id, trans_id id, txn_date,
         case when partner <> '' then partner when sym <> '' then sym else op end counterparty,
         op || '|' || sym details, amount, balance,
         case when sym in ('IC','PE') then 'income' when sym in ('HH','IN','ST') then 'utilities'
              when sym = 'LO' then 'transfer' when sym = 'IO' then 'other' when typ = 'C' then 'income'
              when op in ('WIC','CCW') then 'cash' when op = 'ROB' then 'transfer' else 'other' end spending_group,
         amount > 0 is_credit
  from raw
)"""


@query("s4_panel_scan", "with " + PANEL_SQL + """
select account_id, cast(id as bigint) id, txn_date, counterparty, details, cast(amount as double) amount,
       cast(balance as double) balance, spending_group, is_credit from panel""")
def s4(spark, sf):
    path = fresh_path(spark, "panel-tsv")
    raw = A.panel_raw(spark, sf)
    raw.write.options(sep="\t", header=False, compression="gzip", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                      emptyValue="").csv(path)
    return nums(P.read_panel(spark, path))


@query("s5_table_sinks", "with " + Q.DAILY + """
select 'daily_balance' tbl, count(*) n, cast(sum(net_flow) as double) total from daily
union all select 'transactions', count(*), cast(sum(amount) as double) from flows
union all select 'spending_groups', 14, 0.0""")
def s5(spark, sf):
    tx = cut(A.ledger_panel(spark, sf))  # two of the stored tables are made from it
    paths = K.write_ledger(tx, R.daily_series(tx), L.group_dimension(spark), fresh_path(spark, "ledger"))
    totals = {"transactions": "amount", "daily_balance": "net_flow", "spending_groups": None}
    out = None
    for name, column in totals.items():
        total = F.sum(column).cast("double") if column else F.lit(0.0)
        part = spark.read.parquet(paths[name]).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))
        part = part.select(F.lit(name).alias("tbl"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("s6_constraint_checks", "with " + Q.FLOWS + """,
dup as (select coalesce(sum(c), 0) n from (select count(*) c from flows group by account_id, txn_date, counterparty having count(*) > 1)),
dim as (select distinct spending_group name from flows where spending_group not in ('transfer', 'dining'))
select 'primary key' "constraint", 'account_id,txn_date,counterparty' "column", cast(n as bigint) n from dup
union all select 'not null', 'txn_date', count(*) filter (where txn_date is null) from flows
union all select 'not null', 'amount', count(*) filter (where amount is null) from flows
union all select 'foreign key', 'spending_group', count(*) from flows
  where spending_group not in (select name from dim)""")
def s6(spark, sf):
    tx = A.ledger_flows(spark, sf)
    dimension = L.group_dimension(spark).where("name not in ('transfer', 'dining')")
    return K.violations(tx, ["account_id", "txn_date", "counterparty"], ["txn_date", "amount"],
                        {"spending_group": (dimension, "name")})


@query("s7_detection_columns", "with " + Q.FLOWS + """
select account_id, txn_date, counterparty, details, cast(amount as double) amount, spending_group from flows""")
def s7(spark, sf):
    return nums(P.detection_columns(A.ledger_flows(spark, sf)))


@query("s8_daily_scan", "with " + Q.DAILY + """
select account_id, period, cast(net_flow as double) net_flow, cast(txn_count as bigint) txn_count from daily""")
def s8(spark, sf):
    path = K.write_table(R.daily_series(A.ledger_flows(spark, sf)), fresh_path(spark, "daily"))
    return P.read_daily(spark, path).select("account_id", "period", num("net_flow"), "txn_count")


@query("s9_metric_sinks", "with " + Q.FLOWS + """
select sink, spending_group, n, round(m, 3) mean_amount
from (select spending_group, count(*) n, cast(sum(amount) as double) / count(*) m from flows group by 1),
     (select unnest(['json', 'csv']) sink)""")
def s9(spark, sf):
    tx = A.ledger_flows(spark, sf)
    metrics = tx.groupBy("spending_group").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("amount").cast("double") / F.count(F.lit(1))).alias("mean_amount"))
    paths = K.write_metrics(metrics, fresh_path(spark, "metrics"))
    schema = "spending_group string, n bigint, mean_amount double"
    back = spark.read.schema(schema).json(paths["json"]).withColumn("sink", F.lit("json"))
    return back.unionByName(
        spark.read.schema(schema).option("header", True).csv(paths["csv"]).withColumn("sink", F.lit("csv")))


@query("s10_account_frame", "with " + PANEL_SQL + """
select account_id, cast(id as bigint) id, txn_date, cast(amount as double) amount, spending_group, is_credit from panel""")
def s10(spark, sf):
    tx = P.ordered_transactions(P.panel_transactions(A.panel_raw(spark, sf)))
    return tx.select("account_id", "id", "txn_date", num("amount"), "spending_group", "is_credit")


@query("s11_select_accounts", "with " + Q.FLOWS + """
select account_id, count(*) n_rows, min(txn_date) first_date, max(txn_date) last_date from flows group by 1
having count(*) >= 120 and (max(txn_date) - min(txn_date)) / 7.0 >= 80""")
def s11(spark, sf):
    return P.select_accounts(A.ledger_flows(spark, sf))


@query("s11_sampled_accounts")
def s11_sample(spark, sf):
    return P.select_accounts(A.ledger_flows(spark, sf), min_weeks=10, min_rows=10, n=60, seed=7)


@query("s12_reconciliation", "with " + Q.LEDGER + """,
d as (select account_id, txn_date, sum(amount) s, max_by(balance, id) b from ledger group by 1, 2)
select account_id, (max(txn_date) - min(txn_date)) + 1 n_days, cast(max_by(b, txn_date) as double) final_balance,
       cast(0 as double) max_gap from d group by 1""")
def s12(spark, sf):
    tx = cut(A.ledger_panel(spark, sf).drop("counterparty", "details"))  # read for the days and for the opening
    daily = R.panel_daily(tx, L.PANEL_GROUPS)
    return nums(P.reconcile(daily, R.opening_balance(tx)))


@query("s13_ledger_summary", "with " + Q.LEDGER + """
select account_id, count(*) n_transactions, cast(max(txn_date) - min(txn_date) + 1 as bigint) n_days, min(txn_date) first_date,
       max(txn_date) last_date, cast(max_by(balance, id) as double) final_balance,
       count(*) filter (where spending_group = 'other') n_other from ledger group by 1""")
def s13(spark, sf):
    return nums(P.ledger_summary(A.ledger_panel(spark, sf)))


# ---- labels -------------------------------------------------------------------------------------

@query("c1_keyword_labels", "with " + Q.FLOWS + """
select account_id, txn_date, counterparty, details, spending_group, count(*) n from flows group by all""")
def c1(spark, sf):
    return A.ledger_flows(spark, sf).groupBy(
        "account_id", "txn_date", "counterparty", "details", "spending_group").agg(F.count(F.lit(1)).alias("n"))


def _rules_sql(rules) -> str:
    out = []
    for rule in rules:
        hits = " or ".join(f"contains(t, '{w}')" for w in rule.keywords)
        out.append(f"when {'amount > 0 and ' if rule.credits_only else ''}({hits}) then '{rule.group}'")
    return "case " + " ".join(out) + " " + Q.fallback()


DOC_LEDGER = """docs as (
  select doc_id, source counterparty, text details,
         cast(case when doc_id % 3 = 0 then n_chars else -n_chars end as decimal(18,2)) amount from documents),
texts as (select *, upper(counterparty || ' || ' || details) t from docs)"""


@query("c1_default_rules_on_texts", f"with {DOC_LEDGER} select doc_id, {_rules_sql(L.DEFAULT_RULES)} spending_group from texts")
def c1_default(spark, sf):
    docs = A.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("counterparty"), F.col("text").alias("details"),
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(-F.col("n_chars"))
        .cast("decimal(18,2)").alias("amount"))
    return L.add_labels(docs).select("doc_id", "spending_group")


PAYER_RULES = (L.Rule("income", ("RED ",), credits_only=True), L.Rule("transfer", ("RED", "1-URGENT")),
               L.Rule("income", ("2-HIGH",), credits_only=True), L.Rule("cash", ("HIGH",)))


@query("c2_credit_rule_first", "with " + Q.BASE + f""",
texts as (select *, upper(counterparty || ' || ' || details) t from base)
select account_id, counterparty, {_rules_sql(PAYER_RULES)} spending_group, count(*) n from texts group by all""")
def c2(spark, sf):
    return L.add_labels(A.ledger_base(spark, sf), PAYER_RULES).groupBy(
        "account_id", "counterparty", "spending_group").agg(F.count(F.lit(1)).alias("n"))


@query("c3_credit_fallback", "with " + Q.EVENTS + f"""
select account_id, id, case {Q.fallback()} spending_group from evl""")
def c3(spark, sf):
    return L.add_labels(A.ledger_events(spark, sf), ()).select("account_id", "id", "spending_group")


ODD_EVENTS = Q.EVENTS + """,
odd as (
  select account_id, id, amount, case when id % 5 = 0 then null when id % 5 = 1 then '  ' when id % 5 = 2 then counterparty || ' 7'
                  else ' ' || counterparty end counterparty,
         case when id % 7 = 0 then null when id % 7 = 1 then ' ''' || details when id % 7 = 2 then 'x516737' else details end details
  from evl)"""


def _odd_events(spark, sf):
    i, cp, de = F.col("id"), F.col("counterparty"), F.col("details")
    return A.ledger_events(spark, sf).select(
        "account_id", "id", "txn_date", "amount",
        F.when(i % 5 == 0, None).when(i % 5 == 1, "  ").when(i % 5 == 2, F.concat(cp, F.lit(" 7")))
        .otherwise(F.concat(F.lit(" "), cp)).alias("counterparty"),
        F.when(i % 7 == 0, None).when(i % 7 == 1, F.concat(F.lit(" '"), de)).when(i % 7 == 2, "x516737")
        .otherwise(de).alias("details"))


@query("c4_name_fallback", f"with {ODD_EVENTS} select account_id, id, case {Q.fallback()} spending_group from odd")
def c4(spark, sf):
    return L.add_labels(_odd_events(spark, sf), ()).select("account_id", "id", "spending_group")


@query("c5_code_labels", "with " + PANEL_SQL + """
select account_id, details, is_credit, spending_group, count(*) n from panel group by all""")
def c5(spark, sf):
    return P.panel_transactions(A.panel_raw(spark, sf)).groupBy(
        "account_id", "details", "is_credit", "spending_group").agg(F.count(F.lit(1)).alias("n"))


_DIM = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in L.SPENDING_GROUPS.items())


@query("c6_group_dimension", "with " + Q.FLOWS + f"""
select name, description, count(account_id) n from (values {_DIM}) d(name, description)
left join flows on name = spending_group group by all""")
def c6(spark, sf):
    counts = A.ledger_flows(spark, sf).groupBy("spending_group").agg(F.count(F.lit(1)).alias("n"))
    return (L.group_dimension(spark).join(counts, F.col("name") == F.col("spending_group"), "left")
            .select("name", "description", F.coalesce("n", F.lit(0).cast("long")).alias("n")))


@query("c7_group_breakdown", "with " + Q.FLOWS + """
select spending_group, count(*) n, cast(cast(round(sum(amount), 2) as decimal(38,2)) as double) total from flows group by 1""")
def c7(spark, sf):
    return nums(L.group_breakdown(A.ledger_flows(spark, sf)))


@query("c8_first_non_blank", "with " + PANEL_SQL + """
select account_id, counterparty, count(*) n from panel group by all""")
def c8(spark, sf):
    return P.panel_transactions(A.panel_raw(spark, sf)).groupBy("account_id", "counterparty").agg(
        F.count(F.lit(1)).alias("n"))


@query("c9_operation_details", "with " + PANEL_SQL + """
select account_id, details, count(*) n from panel group by all""")
def c9(spark, sf):
    return P.panel_transactions(A.panel_raw(spark, sf)).groupBy("account_id", "details").agg(
        F.count(F.lit(1)).alias("n"))


@query("c10_merchant_key", f"with {ODD_EVENTS} select account_id, id, {Q.merchant()} merchant from odd")
def c10(spark, sf):
    return _odd_events(spark, sf).select(
        "account_id", "id", L.merchant_key(F.col("counterparty"), F.col("details")).alias("merchant"))


# ---- roll-ups -----------------------------------------------------------------------------------

@query("d1_daily_flow", "with " + Q.FLOWS + """
select account_id, txn_date period, cast(sum(amount) as double) net_flow, count(*) txn_count from flows group by 1, 2""")
def d1(spark, sf):
    return R.daily_flows(A.ledger_flows(spark, sf)).select("account_id", "period", num("net_flow"), "txn_count")


@query("d2_debit_credit", "with " + Q.FLOWS + """
select account_id, txn_date period, cast(coalesce(sum(case when amount < 0 then -amount end), 0) as double) debit_sum,
       cast(coalesce(sum(case when amount >= 0 then amount end), 0) as double) credit_sum from flows group by 1, 2""")
def d2(spark, sf):
    return R.daily_flows(A.ledger_flows(spark, sf)).select("account_id", "period", num("debit_sum"), num("credit_sum"))


@query("d3_group_pivot", "with " + Q.DAILY + f" select account_id, period, {Q.dbl(Q.GRP_COLS)} from days")
def d3(spark, sf):
    return R.daily_flows(A.ledger_flows(spark, sf)).select("account_id", "period", *[num(c) for c in Q.GRP_COLS])


@query("d4_panel_groups", "with " + PANEL_SQL + """
select account_id, txn_date period, cast(coalesce(sum(case when is_credit then amount end), 0) as double) grp_income,
""" + ", ".join(f"cast(coalesce(sum(case when spending_group = '{g}' then amount end), 0) as double) grp_{g}"
                for g in L.PANEL_GROUPS if g != "income") + " from panel group by 1, 2")
def d4(spark, sf):
    tx = P.panel_transactions(A.panel_raw(spark, sf))
    daily = R.daily_flows(tx, L.PANEL_GROUPS, income_is_credits=True)
    return daily.select("account_id", "period", *[num(f"grp_{g}") for g in L.PANEL_GROUPS])


SPARSE = """,
sparse as (select account_id, id, txn_date, amount, case when id % 3 <> 0 then balance end balance from ledger),
sday as (select account_id, txn_date period, sum(amount) net_flow,
                max_by(balance, id) filter (where balance is not null) end_balance from sparse group by 1, 2)"""


def _sparse(spark, sf):
    return A.ledger_panel(spark, sf).withColumn("balance", F.when(F.col("id") % 3 != 0, F.col("balance")))


def _with_opening(spark, sf):
    """Every account opens with 10 times its number."""
    return A.ledger_panel(spark, sf).withColumn("balance", F.expr("balance + cast(10 * account_id as decimal(18,4))"))


@query("d5_end_of_day_balance", "with " + Q.LEDGER + SPARSE + """
select account_id, period, cast(end_balance as double) end_balance from sday""")
def d5(spark, sf):
    return R.daily_flows(_sparse(spark, sf)).select("account_id", "period", num("end_balance"))


@query("d6_calendar_fill", "with " + Q.DAILY + f" select account_id, period, {Q.dbl(Q.SUMMED)} from daily".replace(
    "cast(txn_count as double) txn_count", "cast(txn_count as bigint) txn_count"))
def d6(spark, sf):
    return nums(R.fill_calendar(R.daily_flows(A.ledger_flows(spark, sf))))


@query("d7_forward_fill", "with " + Q.LEDGER + SPARSE + """,
sp as (select account_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) period
       from (select account_id, min(period) lo, max(period) hi from sday group by 1))
select sp.account_id, sp.period, cast(coalesce(net_flow, 0) as double) net_flow,
       cast(last_value(end_balance ignore nulls) over (partition by sp.account_id order by sp.period rows unbounded preceding) as double) end_balance
from sp left join sday on sp.account_id = sday.account_id and sp.period = sday.period""")
def d7(spark, sf):
    return R.daily_series(_sparse(spark, sf)).select("account_id", "period", num("net_flow"), num("end_balance"))


@query("d8_opening_balance", "with " + Q.LEDGER + """
select account_id, cast(min_by(balance - amount, id) + 10 * account_id as double) opening from ledger group by 1""")
def d8(spark, sf):
    return nums(R.opening_balance(_with_opening(spark, sf)))


@query("d9_balance_flow", "with " + Q.LEDGER + """,
late as (select * replace (balance + 10 * account_id as balance) from ledger),
op as (select account_id, min_by(balance - amount, id) opening from late group by 1),
dd as (select account_id, txn_date period, max_by(balance, id) b from late group by 1, 2),
sp as (select account_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) period
       from (select account_id, min(period) lo, max(period) hi from dd group by 1)),
f as (select sp.account_id, sp.period, last_value(b ignore nulls) over (partition by sp.account_id order by sp.period rows unbounded preceding) end_balance
      from sp left join dd on sp.account_id = dd.account_id and sp.period = dd.period)
select f.account_id, period, cast(end_balance - coalesce(lag(end_balance) over (partition by f.account_id order by period), opening) as double) net_flow,
       cast(end_balance as double) end_balance from f join op on f.account_id = op.account_id""")
def d9(spark, sf):
    daily = R.panel_daily(_with_opening(spark, sf), L.PANEL_GROUPS)
    return daily.select("account_id", "period", num("net_flow"), num("end_balance"))


WEEK_COLS = [*Q.SUMMED, "end_balance"]


@query("d10_weekly_resample", "with " + Q.WEEKLY + f" select account_id, period, {Q.dbl(WEEK_COLS)} from weekly".replace(
    "cast(txn_count as double) txn_count", "txn_count"))
def d10(spark, sf):
    return nums(R.weekly_series(A.ledger_flows(spark, sf)))


@query("d11_core_view", "with " + Q.DAILY.replace("grp_utilities\n", "grp_utilities") + """,
core as (select account_id, period, net_flow - grp_leisure net_flow,
                first_value(end_balance - net_flow) over (partition by account_id order by period) opening from daily)
select account_id, period, cast(net_flow as double) net_flow, cast(0 as double) grp_savings,
       cast(opening + sum(net_flow) over (partition by account_id order by period rows unbounded preceding) as double) end_balance
from core""")
def d11(spark, sf):
    # the fixture has no savings label, so leisure stands in for it
    daily = R.daily_series(A.ledger_flows(spark, sf)).withColumn("grp_savings", F.col("grp_leisure"))
    return R.core_view(daily).select("account_id", "period", num("net_flow"), num("grp_savings"), num("end_balance"))


@query("d12_reconstruct_balance", "with " + Q.DAILY + """
select account_id, period, cast(100 + end_balance as double) end_balance from daily""")
def d12(spark, sf):
    filled = R.fill_calendar(R.daily_flows(A.ledger_flows(spark, sf)))
    return R.reconstruct_balance(filled, 100.0).select("account_id", "period", num("end_balance"))
