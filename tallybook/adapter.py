"""Star-schema test tables as a canonical ledger.

One SQL expression per ledger column, valid in any ANSI dialect, so the reference SQL of a query can use the same text.
`description` is the cleaned merchant text; `memo` is a noisy raw bank descriptor for the text and classification work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "(l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 20"
_SIGN = f"(case when {_K} in (0, 1, 2) or ({_K} = 3 and l_orderkey % 2 = 0) then 1 else -1 end)"
_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_shipdate as date)"

MEMO = """case (l_orderkey * 5 + l_linenumber * 11 + l_suppkey) % 32
 when 0 then 'SQ *' || upper(p_name) || ' ' || l_orderkey || ' SEATTLE WA'
 when 1 then 'TST* BIRYANI BISTRO ' || (l_suppkey % 10)
 when 2 then 'NETFLIX.COM 866-579-7172 CA'
 when 3 then 'SPOTIFY USA 877-778-1161'
 when 4 then 'UBER *EATS ' || upper(p_name)
 when 5 then 'AMZN MKTP US*' || l_orderkey || 'X'
 when 6 then 'COSTCO GAS #' || (l_suppkey % 1000)
 when 7 then 'POS PURCHASE ' || upper(p_name) || ' #' || l_suppkey || ' PORTLAND OR'
 when 8 then 'RECURRING DEBIT CARD PURCHASE PLANET FITNESS ' || l_orderkey
 when 9 then 'LAKEVIEW LN SRV DES:MTG PYMT ID:' || l_orderkey || ' INDN:HOLDER CO ID:77 WEB'
 when 10 then 'PAYPAL *' || upper(p_name)
 when 11 then 'firestone' || (28000 + l_suppkey)
 when 12 then 'WITHDRAWAL EFT ' || l_orderkey
 when 13 then 'CHASE CREDIT CRD DES:EPAY ' || (l_suppkey % 5)
 when 14 then 'ZELLE PAYMENT TO ' || upper(p_name)
 when 15 then 'PAYROLL DIRECT DEP ACME CO'
 when 16 then 'WHOLEFDS MKT ' || (10000 + l_partkey % 500)
 when 17 then 'APPLE.COM/BILL 866-712-7753 CA'
 when 18 then 'WM SUPERCENTER #' || l_suppkey
 when 19 then 'GOOGLE *YOUTUBE PREMIUM'
 when 20 then 'MyTarget Fitness Studio ' || (l_partkey % 7)
 when 21 then 'MACY S ' || upper(p_name) || ' JAN'
 when 22 then 'REFUND ' || upper(p_name) || ' 12/24'
 when 23 then 'HUDSON NEWS SEATAC ' || (l_suppkey % 3)
 when 24 then 'GEICO *AUTO 800-841-3000 DC'
 when 25 then 'PUGET SOUND ENERGY 2024'
 when 26 then 'KUSHKLUB - S-7 WITHDRWL KUSHKLUB - S-7690 TUKWILA'
 when 27 then 'STARBUCKS STORE 0' || (1000 + l_suppkey)
 when 28 then 'WALMART GROCERY Dy3g80Sk3'
 when 29 then 'OAK RIDGE HOA DUES'
 when 30 then 'VENMO ' || upper(p_name) || ' LLC'
 else 'Trader Joe s #' || (100 + l_suppkey % 50) || ' help.com' end"""

LEDGER_COLUMNS: dict[str, str] = {
    "user_id": "'u' || lpad('' || c_nationkey, 2, '0')",
    "transaction_id": _ID,
    "transaction_date": "cast(l_shipdate as date)",
    "ym": "substr('' || cast(l_shipdate as date), 1, 7)",
    "amount": f"cast({_SIGN} * (cast(l_quantity as bigint) * (1 + l_partkey % 9) * 100 + l_suppkey % 100) * 0.01"
    " as decimal(18,2))",
    "cents": f"{_SIGN} * (cast(l_quantity as bigint) * (1 + l_partkey % 9) * 100 + l_suppkey % 100)",
    "description": f"""case when {_K} = 2 then 'Platinum credit - ' || p_name
 else case l_suppkey % 16 when 0 then 'NETFLIX.COM' when 1 then 'SPOTIFY USA' when 2 then 'UBER *EATS'
 when 3 then 'AMZN MKTP US' when 4 then 'COSTCO GAS' else 'SQ *' || upper(p_name) end end""",
    "memo": MEMO,
    "category": """case p_type when 'ECONOMY' then 'Food & Dining' when 'SMALL' then 'Groceries'
 when 'MEDIUM' then 'Shopping' when 'PROMO' then 'Subscriptions' when 'STANDARD' then 'Travel'
 when 'LARGE' then 'Bills & Utilities' end""",
    "bank_source": "c_mktsegment",
    "account_name": "c_mktsegment || ' ' || (c_custkey % 3)",
    "transaction_type": f"""case {_K} when 0 then 'income' when 1 then 'refund' when 2 then 'card_credit'
 when 3 then 'transfer' when 4 then 'credit_card_payment' when 5 then 'cash' else 'expense' end""",
    "is_pending": "l_linenumber = 7",
    "is_fixed": "p_type in ('PROMO', 'LARGE')",
    "needs_review": "l_returnflag = 'R'",
    "exclusion_reason": "case when l_tax = 0.08 then 'credit_covered' end",
    "ext_id": f"case when l_suppkey % 4 = 0 then 'OFX-' || {_ID} end",
    "seq": f"cast(l_shipdate as date) || '|' || {_ID}",
}

SOURCE = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey"


def ledger_sql() -> str:
    """The adapter as a SQL select over the registered star-schema views."""
    cols = ",\n ".join(f"{expr} as {name}" for name, expr in LEDGER_COLUMNS.items())
    return f"select {cols}\nfrom {SOURCE}"


def star_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger over the parquet tables; only referenced columns reach the scans.

    Orders find their customers first, so that lines are moved once for both; the hint keeps lines from being the broadcast side
    of a small ledger, which one or two tasks would then work on.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    placed = read("orders").selectExpr("o_orderkey as l_orderkey", "o_custkey as c_custkey").join(read("customer"), "c_custkey")
    joined = read("lineitem").join(placed.hint("merge"), "l_orderkey").join(read("part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    return joined.selectExpr(*[f"{expr} as {name}" for name, expr in LEDGER_COLUMNS.items()])
