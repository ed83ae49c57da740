"""The given tables in the shape of a transaction ledger (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import Rule, add_labels
from tidemark.operators.ordering import running_totals
from tidemark.session import cut

# keyword rules on the noun of a part name; PLATE is left to the fallbacks
PART_RULES = (
    Rule("shopping", ("RING",)),
    Rule("subscriptions", ("WIDGET",)),
    Rule("transport", ("BOLT",)),
    Rule("groceries", ("GEAR",)),
    Rule("dining", ("GIZMO",)),
    Rule("utilities", ("ROD",)),
    Rule("leisure", ("ANVIL",)),
)
ORDER_KEYS = ["txn_date", "kind", "k1", "k2", "counterparty", "details", "amount"]
KEY_BLOCK = 4096  # order keys per ordering bucket
PLANTED_CUSTOMERS, MOST_TASKS = 5000, 20_000  # customers of a task that plants payments, and the most tasks
LEAST_ACCOUNTS, CUSTOMERS = 100, 15  # accounts at least, and customers that share one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> int:
    """Number of accounts: it grows with the customers, so accounts keep their size as tables grow."""
    return max(LEAST_ACCOUNTS, table(spark, sf_dir, "customer").count() // CUSTOMERS)


def ledger_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as inflows and all line items as outflows; customers are dealt to accounts by number.

    ``id`` is the full order key as a struct: it sorts like the dense id and costs nothing.
    """
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    account = F.col("o_custkey") % accounts(spark, sf_dir)
    inflow = orders.select(
        account.alias("account_id"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.lit(0).alias("kind"),
        F.col("o_orderkey").alias("k1"),
        F.lit(0).alias("k2"),
        F.col("o_orderpriority").alias("counterparty"),
        F.concat(F.lit("order "), "o_orderstatus").alias("details"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(18,4)").alias("amount"),
        F.lit("").alias("ptype"),
        F.lit("").alias("flag"),
    )
    outflow = (
        lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            account.alias("account_id"),
            F.col("l_shipdate").cast("date").alias("txn_date"),
            F.lit(1).alias("kind"),
            F.col("l_orderkey").alias("k1"),
            F.col("l_linenumber").alias("k2"),
            F.col("p_name").alias("counterparty"),
            F.concat_ws("|", "p_type", "l_returnflag").alias("details"),
            F.expr(
                "cast(-cast(l_extendedprice as decimal(14,2)) * (1 - cast(l_discount as decimal(3,2)))"
                " as decimal(18,4))"
            ).alias("amount"),
            F.col("p_type").alias("ptype"),
            F.col("l_returnflag").alias("flag"),
        )
    )
    return inflow.unionByName(outflow).withColumn(
        "id", F.struct("kind", "k1", "k2", "counterparty", "details", "amount")
    )


def ledger_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ledger without balances: enough for every roll-up and model."""
    return add_labels(ledger_base(spark, sf_dir), PART_RULES)


def numbered(base: DataFrame, sums: dict[str, str] | None = None) -> DataFrame:
    """Dense id and running ``sums`` (by default the balance) per account.

    The base is written once: the totals of the levels and the rows themselves both read it, and without that the joins
    behind it would be shuffled twice.
    """
    return running_totals(
        cut(base.drop("id")),
        group=["account_id"],
        levels=[
            [("__date", F.col("txn_date"))],
            [("__kind", F.col("kind")), ("__block", F.floor(F.col("k1") / KEY_BLOCK))],
        ],
        order=ORDER_KEYS,
        sums={"balance": "amount"} if sums is None else sums,
        row_number="id",
    )


def ledger_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ledger with dense ids and running balances."""
    return add_labels(numbered(ledger_base(spark, sf_dir)), PART_RULES).select(
        "account_id", "id", "txn_date", "counterparty", "details", "amount", "balance",
        "spending_group",
    )


def panel_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as panel-file columns (type, operation and k_symbol codes, partner account)."""
    tx = numbered(ledger_base(spark, sf_dir))
    op = F.when(F.col("flag") == "A", "WIC").when(F.col("flag") == "N", "ROB").when(
        F.col("flag") == "R", "CCW").otherwise("")
    symbol = (
        F.when(F.col("ptype") == "ECONOMY", " HH").when(F.col("ptype") == "SMALL", "IC")
        .when(F.col("ptype") == "MEDIUM", "ST ").when(F.col("ptype") == "LARGE", "LO").otherwise(" ")
    )
    return tx.select(
        F.col("id").alias("trans_id"), "account_id", "txn_date", "amount",
        F.col("balance").cast("decimal(18,4)").alias("balance"),
        F.when(F.col("amount") > 0, "C").otherwise("D").alias("type"),
        op.alias("operation"), symbol.alias("k_symbol"), F.lit("").alias("bank"),
        F.when(F.col("k1") % 3 != 0, F.col("counterparty")).otherwise("").alias("partner_account"),
    )


def sheet_rows(spark: SparkSession, sf_dir: str, shifted_year: int | None = None) -> DataFrame:
    """The ledger as statement cells: one file per account and year, with marker and junk rows.

    Ids and running sums follow one order, so one pass makes both.  Its rows and the sheet are written once each: every
    step reads the one before several times, so without that the work of the first doubles with each.  Rows without a
    date or an order key get no place on a sheet; ids count them, sums do not.
    """
    placed = F.col("txn_date").isNotNull() & F.col("k1").isNotNull()
    base = ledger_base(spark, sf_dir).withColumn("cents", F.when(placed, F.round("amount", 2).cast("decimal(18,2)")))
    tx = cut(numbered(base, sums={"run": "cents"}).select(
        "account_id", "txn_date", "id", "counterparty", "details", "cents", "run", F.year("txn_date").alias("file_seq")))
    data = tx.select(
        "account_id", "file_seq", F.col("id").alias("row_seq"),
        F.concat(F.lit(" "), F.col("id").cast("string")).alias("A"),
        F.concat(F.datediff("txn_date", F.lit("1899-12-30").cast("date")).cast("string"), F.lit(".25")).alias("B"),
        F.concat(F.lit(" "), "counterparty", F.lit(" ")).alias("C"), F.col("details").alias("D"),
        F.col("cents").cast("string").alias("E"),
        F.when(F.col("id") % 10 == 0, "").otherwise(F.col("run").cast("string")).alias("F"),
    )
    files = tx.groupBy("account_id", "file_seq").agg(
        F.min_by(F.col("run") - F.col("cents"), "id").alias("opening"),
        F.max_by("run", "id").alias("closing"),
    )
    if shifted_year:
        files = files.withColumn(
            "opening", F.when(F.col("file_seq") == shifted_year, F.col("opening") + 1).otherwise(F.col("opening"))
        )
    none = F.lit(None).cast("string")

    def marker(seq, a, b, e):
        return F.struct(F.lit(seq).cast("long").alias("row_seq"), a.alias("A"), b.alias("B"), none.alias("C"),
                        none.alias("D"), e.alias("E"), none.alias("F"))

    day = F.lit("35000")
    extra = F.array(
        marker(0, F.lit("EUR opening balance 01.01"), none, F.col("opening").cast("string")),
        marker(10**15, F.lit("EUR closing balance 31.12"), none, F.col("closing").cast("string")),
        marker(10**15 + 1, F.lit("Total"), day, F.lit("1.00")),
        marker(10**15 + 2, F.lit("7"), none, F.lit("1.00")),
        marker(10**15 + 3, F.lit("8"), day, none),
        marker(10**15 + 4, none, day, F.lit("1.00")),
    )
    return cut(data.unionByName(files.select("account_id", "file_seq", F.inline(extra))))


def ledger_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One monthly and one weekly merchant per customer.

    A customer becomes 128 payments, so customers are dealt to tasks by number: the file alone is one task.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    customer = customer.repartition(max(1, min(MOST_TASKS, -(-customer.count() // PLANTED_CUSTOMERS))), "c_custkey")
    customer.createOrReplaceTempView("tm_customer")
    tx = spark.sql(
        """
        select c_custkey account_id,
               date_add(make_date(1999 + m div 12, m % 12 + 1, 1),
                        cast(c_custkey % 25 + (m*7 + c_custkey) % 3 as int)) txn_date,
               'MONTHLY ' || c_mktsegment counterparty, 'plan' details,
               cast(cast(abs(c_acctbal) as decimal(16,2)) + 5 as decimal(18,2)) amount,
               'income' spending_group
        from tm_customer lateral view explode(sequence(0, 23)) x as m
        union all
        select c_custkey, date_add(date '1999-01-01', cast(c_custkey % 7 + 7*k as int)),
               'WEEKLY ' || c_mktsegment, 'plan', cast(-(10 + c_custkey % 50) as decimal(18,2)), 'groceries'
        from tm_customer lateral view explode(sequence(0, 103)) x as k
        """
    )
    return tx.withColumn("id", F.struct("counterparty", "details", "amount"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short dense ledger: one account per user."""
    value = F.col("value").cast("decimal(18,2)")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("account_id"),
        F.col("ts").cast("date").alias("txn_date"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("counterparty"),
        F.col("props").alias("details"),
        F.when(F.col("event_type").isin("signup", "purchase"), value).otherwise(-value)
        .cast("decimal(18,2)").alias("amount"),
    )
