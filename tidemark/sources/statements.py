"""Statement sheets (rows of text cells A..F) to one ordered ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import from_excel_serial
from tidemark.functions.labels import BLANKS
from tidemark.operators.ordering import running_totals

# The marker texts of a statement sheet.
OPENING_MARK = "EUR opening balance"
CLOSING_MARK = "EUR closing balance"
BLOCK = 65536  # sheet rows per ordering block


def _trimmed(name: str):
    return F.btrim(F.coalesce(F.col(name), F.lit("")), F.lit(BLANKS))


def parse_rows(sheet: DataFrame) -> DataFrame:
    """Transaction rows: numeric index in A, date in B and amount in E present."""
    keep = (
        F.expr("try_cast(A as double)").isNotNull() & F.col("B").isNotNull() & F.col("E").isNotNull()
    )
    return sheet.where(keep).select(
        "account_id",
        "file_seq",
        "row_seq",
        from_excel_serial(F.col("B")).alias("txn_date"),
        _trimmed("C").alias("counterparty"),
        _trimmed("D").alias("details"),
        F.round(F.col("E").cast("decimal(28,10)"), 2).cast("decimal(18,2)").alias("amount"),
        F.nullif(F.col("F"), F.lit("")).cast("decimal(18,2)").alias("balance"),
    )


def continuity(sheet: DataFrame) -> DataFrame:
    """Opening and closing balance per file, and whether it starts where the file before ended."""
    mark = _trimmed("A")
    value = F.col("E").cast("decimal(18,2)")
    files = sheet.groupBy("account_id", "file_seq").agg(
        F.max(F.when(F.startswith(mark, F.lit(OPENING_MARK)), value)).alias("opening"),
        F.max(F.when(F.startswith(mark, F.lit(CLOSING_MARK)), value)).alias("closing"),
    )
    before = F.lag("closing").over(Window.partitionBy("account_id").orderBy("file_seq"))
    return files.withColumn("previous_closing", before).withColumn(
        "is_break",
        F.coalesce(F.abs(F.col("previous_closing") - F.col("opening")) >= F.lit(0.01), F.lit(False)),
    )


def ledger(*sheets: DataFrame) -> DataFrame:
    """All files of all accounts in date order, original order within the day, dense id from 1."""
    rows = parse_rows(sheets[0])
    for sheet in sheets[1:]:
        rows = rows.unionByName(parse_rows(sheet))
    numbered = running_totals(
        rows,
        group=["account_id"],
        levels=[
            [("__date", F.col("txn_date"))],
            [("__file", F.col("file_seq")), ("__block", F.floor(F.col("row_seq") / BLOCK))],
        ],
        order=["txn_date", "file_seq", "row_seq"],
        row_number="id",
    )
    return numbered.select(
        "account_id", "id", "txn_date", "counterparty", "details", "amount", "balance"
    )
