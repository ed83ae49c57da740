"""A spread of registered queries against their SQL twins on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402
from workload import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["s3_statement_union", "c1_default_rules_on_texts", "c10_merchant_key", "d7_forward_fill", "d9_balance_flow",
         "r2_agnostic_detector", "e4_group_folds", "f11_daily_matrix", "s6_constraint_checks"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    rel = con.execute(catalog.ORACLES[name])
    want = check.table_of([d[0] for d in rel.description], rel.fetchall())
    assert check.compare(check.table_of(df.columns, [tuple(r) for r in df.collect()]), want) is None


def test_every_sql_twin_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row.n_accounts > 0 and row.median_mase > 0
