"""Holdouts and folds as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import ranked
from tidemark.session import cut


def temporal_split(rows: DataFrame, n_test: int) -> DataFrame:
    """Mark the last min(n_test, rows / 4) rows of each account as test.

    Adds rn (1-based position), n_train and is_test.
    """
    by_period = Window.partitionBy("account_id").orderBy("period")
    n = F.count(F.lit(1)).over(Window.partitionBy("account_id"))
    held = F.least(F.lit(n_test).cast("long"), F.floor(n / 4))
    return (
        rows.withColumn("rn", F.row_number().over(by_period))
        .withColumn("n_train", n - held)
        .withColumn("is_test", F.col("rn") > F.col("n_train"))
    )


def expanding_fold(rn: Column, n: Column, k: Column | int) -> Column:
    """Test fold 0..k-1 of a row, null for rows that are only ever trained on.

    ``rn`` is 1-based among ``n`` rows; every fold tests n / (k+1) rows and fold f trains on all
    rows before its test block.
    """
    folds = k if isinstance(k, Column) else F.lit(k)
    size = F.floor(n / (folds + 1))
    place = rn - 1 - (n - folds * size)
    return F.when((place >= 0) & (size > 0), F.floor(place / size)).cast("int")


def fold_train_end(fold: Column, n: Column, k: Column | int) -> Column:
    """Number of leading rows that fold ``fold`` trains on."""
    folds = k if isinstance(k, Column) else F.lit(k)
    size = F.floor(n / (folds + 1))
    return n - (folds - fold) * size


def ranked_accounts(accounts: DataFrame, by: str | None = None) -> DataFrame:
    """Dense position ``rank`` of accounts by number, or by ``by`` descending and then number.

    One range sort over the accounts, so no task ranks the whole panel.
    """
    return ranked(accounts, ["account_id"] if by is None else [F.desc(by), "account_id"])


def account_holdout(accounts: DataFrame, n_train: int, n_calibration: int) -> DataFrame:
    """Role per account: the first ``n_train`` by number train (the last of them calibrate), the
    rest are unseen clients."""
    rank = F.col("rank")
    role = (
        F.when(rank > n_train, "unseen").when(rank > n_train - n_calibration, "calibration")
        .otherwise("train")
    )
    return ranked_accounts(accounts).withColumn("role", role)


def group_folds(rows: DataFrame, k: int) -> DataFrame:
    """Fold per account: accounts in falling order of size, each to the fold with the fewest rows so far.

    Equal sizes are dealt as a block.  Only the histogram of sizes (size, accounts) is needed for that, one row
    for each distinct size and so bounded by the calendar; the accounts of a size get the folds of their block by
    rank, ties in a fold's rows go to the lower fold.
    """
    sizes = rows.groupBy("account_id").agg(F.count(F.lit(1)).alias("fold_rows"))
    sizes = cut(sizes)
    histogram = sizes.groupBy("fold_rows").agg(F.count(F.lit(1)).alias("accounts")).orderBy(F.desc("fold_rows")).collect()
    turns = dealt([(r.fold_rows, r.accounts) for r in histogram], k)
    blocks = rows.sparkSession.createDataFrame(turns, "fold_rows long, before long, first array<int>")
    placed = ranked_accounts(sizes, by="fold_rows")
    place = F.col("rank") - 1 - F.col("before")
    last = F.size("first")
    # the first turns of a block level the folds, the rest go round
    fold = F.when(place < last, F.get("first", place.cast("int"))).otherwise(F.get("first", (last - k + (place - last) % k).cast("int")))
    return placed.join(F.broadcast(blocks), "fold_rows").select("account_id", "fold_rows", fold.cast("int").alias("fold"))


def dealt(histogram: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """For each block of accounts of one size (largest first): size, accounts before it, and the folds of its first
    accounts until they go round in turn.

    Once k different folds have been the lightest in a row, the same k folds repeat.  Folds never differ by more than
    the largest account, so a block needs about k times (largest size / its size) steps, however many accounts it
    has.
    """
    load, before, out = [0] * k, 0, []
    for size, accounts in histogram:
        first, left = [], accounts
        while left:
            if len(first) >= k and len(set(first[-k:])) == k:
                # a full round has been dealt in order of load: it repeats
                rounds, rest = divmod(left, k)
                for i, f in enumerate(first[-k:]):
                    load[f] += size * (rounds + (i < rest))
                break
            f = min(range(k), key=lambda i: (load[i], i))
            first.append(f)
            load[f] += size
            left -= 1
        out.append((size, before, first))
        before += accounts
    return out
