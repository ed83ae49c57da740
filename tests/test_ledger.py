import datetime as dt
from decimal import Decimal as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import ordering, quantiles
from tidemark.operators import rollup as R
from tidemark.sources import sinks, statements


def day(text):
    return dt.date.fromisoformat(text)


def test_running_totals_match_a_plain_order(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.6, 1, rng.integers(2, 6, 3000)), "k": rng.permutation(3000)})
    pdf["v"] = rng.integers(-5, 5, 3000)
    df = spark.createDataFrame(pdf)
    levels = [[("a", F.floor(F.col("k") / 1000))], [("b", F.floor(F.col("k") / 100))]]
    out = ordering.running_totals(df, ["g"], levels, ["k"], {"run": "v"}, "id").toPandas()
    want = pdf.sort_values(["g", "k"]).reset_index(drop=True)
    got = out.sort_values(["g", "k"]).reset_index(drop=True)
    assert (got["run"] == want.groupby("g")["v"].cumsum()).all()
    assert (got["id"] == want.groupby("g").cumcount() + 1).all()
    whole = ordering.running_totals(df, [], levels, ["k"], row_number="id")
    assert [r.id for r in whole.orderBy("k").collect()] == list(range(1, 3001))


def test_ranks_over_range_borders(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("account_id"))
    out = ordering.ranked(df, ["account_id"])
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["rank"] for r in out.orderBy("account_id").collect()] == list(range(1, 5001))
    assert ordering.ranked(df.limit(0), ["account_id"]).collect() == []


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [-3.5, -3.5, 0.0, 1e9, 7.25, 7.25], list(np.linspace(-50, 900, 777))])
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": values}))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    row = quantiles.exact_quantiles(df, ["g"], "v", {f"q{i}": p for i, p in enumerate(probs)}).first()
    assert np.allclose([row[f"q{i}"] for i in range(5)], np.quantile(values, probs))
    alone = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert np.isclose(alone.m, np.median(values))


def test_exact_quantiles_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("b", 2.0, 2)], "g string, v double, n int")
    got = {r.g: r.m for r in quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5}, freq="n").collect()}
    assert got == {"a": 1.0, "b": 2.0}


@pytest.mark.parametrize("cp, details, amount, group", [
    ("Wise Payments", "x", 5, "income"), ("Wise Payments", "x", -5, "transfer"),
    (None, "RAHAKOGUJASSE", -1, "savings"), ("Rimi", None, -9, "groceries"), ("Jane Doe", "", -9, "transfer"),
    ("Jane 2", "", -9, "other"), ("Jane", "' 12 card", -9, "other"), ("Jane", "516737 x", -9, "other"),
    (None, None, -9, "other"), (None, None, 9, "income"), ("Hotel Cafe", "", -9, "travel"),
    ("R-Kiosk Apteek", "", -1, "groceries"), ("Südameapteek", "", -1, "health"),
])
def test_default_labels(spark, cp, details, amount, group):
    df = spark.createDataFrame([(cp, details, D(amount))], "counterparty string, details string, amount decimal(18,2)")
    assert L.add_labels(df).first().spending_group == group


def test_merchant_key(spark):
    df = spark.createDataFrame([(" Rent  12 May ", "x"), ("  ", "gym 77"), (None, None), ("a" * 30, "")], "c string, d string")
    keys = [r.k for r in df.select(L.merchant_key(F.col("c"), F.col("d")).alias("k")).collect()]
    assert keys == ["RENT MAY", "GYM", "", "A" * 24]


def ledger(spark, rows):
    return spark.createDataFrame(
        [(a, i, day(d), D(str(m)), None if b is None else D(str(b)), g) for a, i, d, m, b, g in rows],
        "account_id long, id long, txn_date date, amount decimal(18,2), balance decimal(18,2), spending_group string")


def test_daily_and_weekly_series(spark):
    tx = ledger(spark, [
        (1, 1, "2024-01-05", 10, None, "income"), (1, 2, "2024-01-06", -4, 16, "cash"), (1, 3, "2024-01-06", 1, None, "income"),
        (1, 4, "2024-01-07", -2, 15, "cash"), (1, 5, "2024-01-23", 5, 20, "income"), (2, 1, "2024-02-29", 3, 3, "income")])
    daily = R.daily_series(tx)
    one = daily.where("account_id = 1").orderBy("period").collect()
    assert len(one) == 19 and one[0].end_balance is None and one[1].end_balance == 16 and one[10].end_balance == 15
    assert [one[1].net_flow, one[1].debit_sum, one[1].credit_sum, one[1].txn_count, one[1].grp_cash] == [-3, 4, 1, 2, -4]
    assert daily.where("account_id = 2").count() == 1
    weeks = R.weekly(daily).where("account_id = 1").orderBy("period").collect()
    # the Sunday closes its own week, empty weeks stay, labels are Sundays
    assert [str(w.period) for w in weeks] == ["2024-01-07", "2024-01-14", "2024-01-21", "2024-01-28"]
    assert [float(w.net_flow) for w in weeks] == [5, 0, 0, 5] and [float(w.end_balance) for w in weeks] == [15, 15, 15, 20]
    # summed by week without the days, with statement balances and with rebuilt ones
    for rows in (tx, tx.drop("balance")):
        want = R.weekly(R.daily_series(rows))
        names = sorted(want.columns)
        got = R.weekly_series(rows)
        assert sorted(got.columns) == names
        assert {tuple(r) for r in got.select(names).collect()} == {tuple(r) for r in want.select(names).collect()}


def test_sums_agree_with_the_ledger(spark):
    tx = ledger(spark, [(1, i, f"2024-03-{1 + i % 20:02d}", (i * 37 % 11) - 5, i, ["cash", "income", "other"][i % 3]) for i in range(1, 60)])
    daily = R.fill_calendar(R.daily_flows(tx))
    groups = sum(F.col(f"grp_{g}") for g in R.ALL_GROUPS)
    row = daily.agg(F.sum("net_flow").alias("a"), F.sum(groups).alias("b"), F.sum(F.col("credit_sum") - F.col("debit_sum")).alias("c")).first()
    assert row.a == row.b == row.c == tx.agg(F.sum("amount")).first()[0]


def test_core_view(spark):
    tx = ledger(spark, [(1, 1, "2024-01-01", 100, 150, "income"), (1, 2, "2024-01-02", -30, 120, "savings"), (1, 3, "2024-01-03", -5, 115, "cash")])
    rows = R.core_view(R.daily_series(tx)).orderBy("period").collect()
    assert [float(r.net_flow) for r in rows] == [100, 0, -5] and [float(r.end_balance) for r in rows] == [150, 150, 145]


def test_statement_rows(spark):
    schema = "account_id long, file_seq int, row_seq long, A string, B string, C string, D string, E string, F string"
    sheet = spark.createDataFrame([
        (1, 1, 0, "EUR opening balance", None, None, None, "10.00", None), (1, 1, 1, "1", "45292.9", " Shop ", None, "-2.005", ""),
        (1, 1, 2, "2", "45292", "B", "d", "7", "15.00"), (1, 1, 3, "x", "45292", "C", "d", "7", "1"), (1, 1, 4, "3", None, "C", "d", "7", "1"),
        (1, 1, 5, "EUR closing balance", None, None, None, "15.00", None), (1, 2, 0, "EUR opening balance", None, None, None, "15.01", None),
        (1, 2, 1, "1", "45291", "Early", "d", "1", "16.01")], schema)
    rows = statements.ledger(sheet).orderBy("id").collect()
    assert [(r.id, str(r.txn_date), r.counterparty) for r in rows] == [
        (1, "2023-12-31", "Early"), (2, "2024-01-01", "Shop"), (3, "2024-01-01", "B")]
    assert rows[1].balance is None and rows[1].details == ""
    assert [r.is_break for r in statements.continuity(sheet).orderBy("file_seq").collect()] == [False, True]


def test_constraints(spark):
    tx = ledger(spark, [(1, 1, "2024-01-01", 1, 1, "cash"), (1, 1, "2024-01-02", 1, None, "nope")])
    out = {(r.constraint, r.column): r.n for r in sinks.violations(
        tx, ["account_id", "id"], ["balance"], {"spending_group": (L.group_dimension(spark), "name")}).collect()}
    assert out == {("primary key", "account_id,id"): 2, ("not null", "balance"): 1, ("foreign key", "spending_group"): 1}


def test_owned_tables_go(spark):
    import os

    from tidemark.session import cut, fresh_path, owned, shared_dir

    kept = fresh_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with owned(spark):
        table = cut(spark.range(5))
        assert table.count() == 5
        inside = [f for f in os.listdir(shared_dir(spark)) if f.startswith("cut-")]
    left = os.listdir(shared_dir(spark))
    assert len(inside) >= 1 and os.path.basename(kept) in left
    assert os.path.basename(table.inputFiles()[0].split("/part-")[0]) not in left


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from tidemark import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)


def test_planted_payments_and_cadences_are_dealt_by_rows(spark, monkeypatch, tmp_path):
    """Tasks follow the number of customers and payments, not the bytes of a small file; rules stay the same."""
    from tidemark.operators import recurring as N
    from workload import adapters as A

    people = [(i, "S", float(i)) for i in range(1, 41)]
    spark.createDataFrame(people, "c_custkey long, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")

    def rules():
        tx = A.ledger_planted(spark, str(tmp_path))
        found = N.detect_agnostic(tx, N.cutoffs(tx, "W", 12))
        return tx, sorted(map(tuple, found.collect()))

    _, plain = rules()
    monkeypatch.setattr(A, "PLANTED_CUSTOMERS", 4)
    monkeypatch.setattr(N, "PAYMENTS_A_TASK", 100)
    tx, small = rules()
    assert tx.rdd.getNumPartitions() >= 10 and tx.count() == 40 * 128
    assert small == plain and len(plain) == 80


def test_sheets_read_the_tables_once(spark, tmp_path):
    """The plan of a union of statement files does not hold the ledger's joins again for each step and file."""
    from workload import adapters
    from workload.ledger_queries import s3

    day, n = dt.date(1998, 12, 30), 20
    tables = {
        "customer": [(i, "A", 1.0) for i in range(n)],
        "orders": [(i, i % 3, day + dt.timedelta(i % 4), 10.25 + i, "O", "1-URGENT") for i in range(n)],
        "lineitem": [(i, j, i % 2, day + dt.timedelta((i + j) % 5), 3.5 + j, 0.1, "N") for i in range(n) for j in (1, 2)],
        "part": [(0, "big RING", "LARGE"), (1, "PLATE", "SMALL")],
    }
    names = {"customer": "c_custkey long, c_mktsegment string, c_acctbal double",
             "orders": "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string, o_orderpriority string",
             "lineitem": "l_orderkey long, l_linenumber long, l_partkey long, l_shipdate date, l_extendedprice double, l_discount double, l_returnflag string",
             "part": "p_partkey long, p_name string, p_type string"}
    for name, rows in tables.items():
        spark.createDataFrame(rows, names[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    union = s3(spark, str(tmp_path))
    plan = union._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and plan.count("Scan parquet") <= 5
    got = union.orderBy("account_id", "id").toPandas()
    base = adapters.ledger_base(spark, str(tmp_path)).select("*").toPandas().sort_values(["account_id", "txn_date", "kind", "k1", "k2"])
    assert (got["id"].to_numpy() == base.groupby("account_id").cumcount().to_numpy() + 1).all()
    assert got["txn_date"].tolist() == base["txn_date"].tolist()
    cents = np.array([D(str(a)).quantize(D("0.01"), "ROUND_HALF_UP") for a in base["amount"]])
    run = pd.Series(cents.astype(float), index=base.index).groupby(base["account_id"]).cumsum().to_numpy()
    seen = got["id"].to_numpy() % 10 != 0
    assert np.allclose(got["amount"], cents.astype(float)) and np.allclose(got["balance"][seen], run[seen])
    assert got["balance"][~seen].isna().all()


def test_accounts_are_dealt_to_so_many_tasks(spark):
    """Filling days keeps the tasks it was dealt, however few bytes the rows have, and gives the same rows."""
    rows = [(a, day("2020-01-01") + dt.timedelta(3 * k), D(a + k), "dining") for a in range(40) for k in range(3)]
    tx = spark.createDataFrame(rows, "account_id long, txn_date date, amount decimal(18,2), spending_group string")
    dealt = R.daily_series(tx, ("dining",), tasks=13)
    assert dealt.rdd.getNumPartitions() == 13
    assert sorted(dealt.collect()) == sorted(R.daily_series(tx, ("dining",)).collect())


def test_accounts_of_weeks_are_dealt_and_unused_features_left_out(spark):
    """Filling weeks keeps the tasks it was dealt and gives the same rows; rows written for a query that uses one feature
    hold no other."""
    from workload import panels

    rows = [(a, day("2020-01-01") + dt.timedelta(17 * k), D(a + k), "dining") for a in range(40) for k in range(3)]
    tx = spark.createDataFrame(rows, "account_id long, txn_date date, amount decimal(18,2), spending_group string")
    dealt = R.weekly_series(tx, ("dining",), tasks=13)
    assert dealt.rdd.getNumPartitions() == 13
    assert sorted(dealt.collect()) == sorted(R.weekly_series(tx, ("dining",)).collect())
    wide = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "account_id long, a double, b double, y double")
    assert panels.narrowed(wide, ["a", "b"], ["b"]).columns == ["account_id", "b", "y"]
    assert panels.narrowed(wide, ["a", "b"], None).columns == wide.columns


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """Orders and lines of a few customers; days and order numbers repeat, so ids are decided by the whole order."""
    at = str(tmp_path_factory.mktemp("tables"))
    day = lambda i: dt.datetime(1997 + i % 3, 1 + i % 12, 1 + i % 5)
    spark.createDataFrame([(c, f"c{c}", c % 5, float(c), "BUILDING") for c in range(30)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(p, f"{n} {p}", "b", t, 1, 1.0) for p, (n, t) in enumerate([("RING", "ECONOMY"), ("BOLT", "SMALL"), ("PLATE", "LARGE")])],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(o // 2, o % 4, "O", 100.0 + o / 7, day(o) if o != 8 else None, "1-URGENT") for o in range(60)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
                          ).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(o % 30, o % 3, 1, o % 4, 1.0, 10.0 + o / 3, 0.05, 0.0, "ANR"[o % 3], "F", day(o + 1)) for o in range(150)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
                          " l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{at}/lineitem.parquet")
    return at


def test_joins_behind_a_numbered_ledger_run_once(spark, small_tables):
    """Totals of the levels and the rows read one written base; the tables themselves are not joined again for the rows."""
    from workload import adapters as A

    plan = A.ledger_panel(spark, small_tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "p_partkey" not in plan
    assert A.ledger_panel(spark, small_tables).count() == A.ledger_base(spark, small_tables).where("txn_date is not null").count()


def test_sheet_numbers_and_sums_rows_in_one_pass(spark, small_tables, monkeypatch):
    from workload import adapters as A

    calls, plain = [], A.running_totals
    monkeypatch.setattr(A, "running_totals", lambda *a, **k: calls.append(k["sums"]) or plain(*a, **k))
    got = statements.parse_rows(A.sheet_rows(spark, small_tables)).orderBy("account_id", "row_seq").collect()
    assert len(calls) == 1
    rows = A.ledger_base(spark, small_tables).withColumn("cents", F.round("amount", 2).cast("decimal(18,2)")).collect()
    rows.sort(key=lambda r: (r.account_id, r.txn_date or dt.date.min, *[r[c] for c in A.ORDER_KEYS[1:]]))
    rows = [r for r in rows if r.account_id is not None]
    missing = [r.account_id for r in rows if r.txn_date is None]
    assert missing == [0]  # counted by the ids of the account, as it comes first, but on no sheet and in no sum
    run, place, last = D(0), 0, None
    for r, g in zip([r for r in rows if r.txn_date is not None], got, strict=True):
        run, place, last = (r.cents, 1 + missing.count(r.account_id), r.account_id) if r.account_id != last else (run + r.cents, place + 1, last)
        assert (g.account_id, g.row_seq, g.file_seq, g.amount) == (r.account_id, place, r.txn_date.year, r.cents)
        assert g.balance == (None if place % 10 == 0 else run)


def test_stored_tables_and_reconciliation_number_the_ledger_once(spark, small_tables, monkeypatch):
    """Both derive two results from one numbered ledger, which is written before."""
    from workload import adapters as A
    from workload import ledger_queries as Q

    plans, read = [], Q.R.daily_series
    monkeypatch.setattr(Q.R, "daily_series", lambda tx: plans.append(tx) or read(tx))
    days = Q.R.panel_daily
    monkeypatch.setattr(Q.R, "panel_daily", lambda tx, groups: plans.append(tx) or days(tx, groups))
    stored = {r.tbl: r.n for r in Q.s5(spark, small_tables).collect()}
    assert stored["transactions"] == A.ledger_base(spark, small_tables).where("txn_date is not null").count()
    Q.s12(spark, small_tables).count()
    assert len(plans) == 2 and all("Window" not in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
