"""Side tables the operators need (budgets, incomes, manual items, request log), derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER = "'u' || lpad('' || c_nationkey, 2, '0')"

BUDGET_HISTORY_SQL = (
    f"select {USER} as user_id, substr('' || cast(o_orderdate as date), 1, 7) as ym,"
    " max(cast(floor(o_totalprice) as bigint)) * 10 as budget"
    " from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' group by 1, 2"
)
PROFILE_SQL = f"select {USER} as user_id, sum(abs(cast(floor(c_acctbal) as bigint))) * 5 as budget from customer group by 1"
INCOME_SQL = f"select {USER} as user_id, sum(abs(cast(floor(c_acctbal) as bigint))) * 20 as income from customer group by 1"
MANUAL_SQL = (
    "select 'u' || lpad('' || s_nationkey, 2, '0') as user_id, s_name as name,"
    " abs(cast(floor(s_acctbal) as bigint)) as amount_cents from supplier"
)


def views(t) -> None:
    for name in ("customer", "orders", "supplier"):
        getattr(t, name).createOrReplaceTempView(name)


def budget_history(t) -> DataFrame:
    views(t)
    return t.spark.sql(BUDGET_HISTORY_SQL)


def profile(t) -> DataFrame:
    views(t)
    return t.spark.sql(PROFILE_SQL)


def income(t) -> DataFrame:
    views(t)
    return t.spark.sql(INCOME_SQL)


def manual_items(t) -> DataFrame:
    views(t)
    return t.spark.sql(MANUAL_SQL)


def request_log(t) -> DataFrame:
    return t.events.select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("prompt_id"), F.col("ts").alias("created_at"))
