"""Registered queries against their SQL in DuckDB at the smallest scale.

A representative set by default; TALLYBOOK_ALL=1 runs every query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [
    "g1_month_totals", "g5_cash_flow_summary", "h1_month_comparison", "h10_month_gaps", "c3_merchant_stem", "c6_display_merchant", "d13_fixed_or_variable",
    "e2_fingerprint_dedup", "e7_credit_matching_run", "e8_credit_cover", "e11_project_assignment", "g9_fixed_with_cover", "i4_insight_b4", "j2_purchase_affordability",
    "k1_apply_corrections", "k11_text_chunks", "a4_delimited_rows", "a10_amex_statement", "b9_mask_accounts", "l2_running_month_totals",
]
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = list(SQL) if os.environ.get("TALLYBOOK_ALL") else CHOSEN


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["user_id", "ym", "total", "flexible", "committed", "txn_count"]
