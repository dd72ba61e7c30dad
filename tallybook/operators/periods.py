"""Filters, projections and period selection over the ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.columns import cents, month_key

# Categories never counted as flexible spend, and the client's own fixed categories.
NON_SPEND_CATEGORIES = ["Transfer", "Payment", "Income"]


def is_spend() -> Column:
    return (F.col("transaction_type") == "expense") & (F.col("amount") < 0)


def is_flexible() -> Column:
    category = F.coalesce(F.col("category"), F.lit(""))
    return is_spend() & ~F.coalesce(F.col("is_fixed"), F.lit(False)) & ~category.isin(NON_SPEND_CATEGORIES)


def spend(ledger: DataFrame, include_excluded: bool = False) -> DataFrame:
    """Money-out expense rows; excluded rows are dropped unless asked for."""
    kept = ledger.filter(is_spend())
    return kept if include_excluded else kept.filter(F.col("exclusion_reason").isNull())


def flexible_spend(ledger: DataFrame) -> DataFrame:
    return ledger.filter(is_flexible())


def with_period(ledger: DataFrame) -> DataFrame:
    """Adds `ym` and `spent` (positive cents of a money-out row)."""
    return ledger.withColumn("ym", month_key()).withColumn("spent", F.abs(cents()))


def user_months(ledger: DataFrame) -> DataFrame:
    """Distinct months per user, any transaction type."""
    dated = ledger.filter(F.col("transaction_date").isNotNull())
    return dated.select("user_id", month_key().alias("ym")).distinct()


def select_period(ledger: DataFrame, period: str | None, start: str | None = None, end: str | None = None) -> DataFrame:
    """'all', 'latest', '3m', 'custom' (inclusive ISO dates) or one 'YYYY-MM', relative to each user's own months."""
    if period in (None, "all"):
        return ledger
    if period == "custom":
        return ledger.filter(F.col("transaction_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if period not in ("latest", "3m"):
        return ledger.filter(month_key() == period)
    newest = Window.partitionBy("user_id").orderBy(F.desc("ym"))
    keep = user_months(ledger).withColumn("n", F.row_number().over(newest))
    keep = keep.filter(F.col("n") <= (1 if period == "latest" else 3)).select("user_id", F.col("ym").alias("_ym"))
    dated = ledger.withColumn("_ym", month_key())
    return dated.join(keep, ["user_id", "_ym"], "left_semi").drop("_ym")


def month_set(ledger: DataFrame, months: Sequence[str], account: str | None = None) -> DataFrame:
    """Rows of the given months plus undated rows; optionally one account."""
    out = ledger
    if months:
        out = out.filter(month_key().isin(list(months)) | F.col("transaction_date").isNull())
    if account and account != "all":
        out = out.filter(F.col("bank_source") == account)
    return out


def search(
    ledger: DataFrame,
    category: str = "all",
    account: str = "all",
    month: str = "all",
    project: str | int = "all",
    text: str = "",
) -> DataFrame:
    """Ledger search; every criterion is a pushed-down conjunct."""
    out = ledger
    if category != "all":
        out = out.filter(F.col("category") == category)
    if account != "all":
        out = out.filter(F.col("bank_source") == account)
    if month != "all":
        out = out.filter(month_key() == month)
    if project == "tagged":
        out = out.filter(F.col("project_id").isNotNull())
    elif project == "untagged":
        out = out.filter(F.col("project_id").isNull())
    elif project != "all":
        out = out.filter(F.col("project_id") == int(project))
    if text:
        out = out.filter(F.lower("description").contains(text.lower()))
    return out


def posted(ledger: DataFrame) -> DataFrame:
    """Non-pending rows; `page` orders what is shown, newest first."""
    return ledger.filter(~F.col("is_pending"))


def review_queue(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("needs_review") & ~F.col("is_pending"))


def active_categories(categories: DataFrame) -> DataFrame:
    return categories.filter("is_active").orderBy("display_order")


def page(df: DataFrame, number: int, order: Sequence[Column], size: int = 25) -> DataFrame:
    """One page of an ordered listing."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def accounts(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("bank_source").isNotNull()).select("user_id", "bank_source").distinct()
