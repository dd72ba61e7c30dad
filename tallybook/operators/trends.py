"""Comparisons between months, trends, gaps and top-k listings.

Windows here run over one row per user and month (or category), never over raw ledger rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.columns import (
    money, month_from_index, month_index, month_long, month_short, percent, round_ratio, round_ratio_up, top_per_group,
)
from tallybook.operators import aggregates as agg
from tallybook.operators.periods import is_spend, spend, user_months, with_period

# What a previous month needs to be comparable.
COMPARABLE_ROWS = 10
COMPARABLE_FLEXIBLE = 20000  # cents


def dense_months(ledger: DataFrame) -> DataFrame:
    """Every user month of any type with its spend (0 where it has none) and the user's month count."""
    zero = F.lit(0).cast("long")
    m = user_months(ledger).join(agg.month_cents(ledger), ["user_id", "ym"], "left").fillna(0, ["flexible", "committed", "txn_count"])
    per_user = Window.partitionBy("user_id")
    return (
        m.withColumn("idx", month_index("ym"))
        .withColumn("n_months", F.count(F.lit(1)).over(per_user))
        .withColumn("position", F.row_number().over(per_user.orderBy("ym")))
        .withColumn("flexible", F.coalesce("flexible", zero))
    )


def month_comparison(ledger: DataFrame) -> DataFrame:
    """Flexible spend against the calendar previous month, or why no comparison is possible."""
    w = Window.partitionBy("user_id").orderBy("idx")
    m = dense_months(ledger)
    before = F.lag(F.struct("idx", "flexible", "txn_count")).over(w)
    m = m.withColumn("p", before)
    m = m.withColumn("p", F.when(F.col("p.idx") == F.col("idx") - 1, F.col("p")))
    reason = (
        F.when(F.col("n_months") <= 1, "not_enough_months")
        .when(F.col("p").isNull(), "no_previous_month")
        .when(F.col("p.flexible") <= 0, "zero_baseline")
        .when((F.col("p.txn_count") < COMPARABLE_ROWS) | (F.col("p.flexible") < COMPARABLE_FLEXIBLE), "prev_month_incomplete")
    )
    m = m.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    delta = F.when(ok, F.col("flexible") - F.col("p.flexible"))
    status = F.when(~ok, "unavailable").when(F.col("n_months") == 2, "absolute").otherwise("percentage")
    return m.withColumn("delta", delta).select(
        "user_id", "ym", F.coalesce("reason", F.lit("")).alias("reason"), status.alias("status"),
        money("delta").alias("delta_abs"),
        F.when(ok & (F.col("n_months") > 2), round_ratio("delta", "p.flexible", 1000) / 10).alias("delta_pct"),
        F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").when(ok, "flat").alias("direction"),
    )


def trend_chart(ledger: DataFrame, span: int = 6) -> DataFrame:
    """For every month as current: itself and up to five earlier data months."""
    m = dense_months(ledger).filter(F.col("n_months") > 1)
    last = m.groupBy("user_id").agg(F.max("position").alias("last"))
    current = m.select("user_id", F.col("ym").alias("current_ym"), F.col("position").alias("at"))
    shown = m.join(last, "user_id").withColumn(
        "at", F.explode(F.sequence("position", F.least(F.col("position") + span - 1, F.col("last")))))
    return shown.join(current, ["user_id", "at"]).select(
        "user_id", "current_ym", "ym", month_short("ym").alias("label"), money("flexible").alias("flexible"), money("committed").alias("committed"))


def spending_trend(ledger: DataFrame) -> DataFrame:
    """Variable/fixed/total per month with % change only between calendar-consecutive months above 50."""
    m = user_months(ledger).join(agg.client_month_cents(ledger), ["user_id", "ym"], "left").fillna(0, ["variable", "fixed"])
    m = m.withColumn("total", F.col("variable") + F.col("fixed")).withColumn("idx", month_index("ym"))
    p = F.lag(F.struct("idx", "total")).over(Window.partitionBy("user_id").orderBy("idx"))
    m = m.withColumn("p", p)
    fair = (F.col("p.idx") == F.col("idx") - 1) & (F.col("p.total") > 5000) & (F.col("total") > 5000)
    change = F.when(fair, round_ratio_up(F.col("total") - F.col("p.total"), F.col("p.total"), 100))
    return m.select(
        "user_id", "ym", month_short("ym").alias("label"), money("variable").alias("variable"), money("fixed").alias("fixed"),
        money("total").alias("total"), change.alias("pct_change"))


def dashboard_summary(ledger: DataFrame) -> DataFrame:
    """Tier, totals, previous month, comparison, top category and biggest charge of every user month."""
    m = dense_months(ledger)
    tier = F.least(F.col("n_months"), F.lit(3))
    base = m.select(
        "user_id", "ym", month_long("ym").alias("label"), tier.alias("data_tier"), F.col("n_months").alias("months_available"),
        month_from_index(F.col("idx") - 1).alias("previous_ym"), money(F.col("flexible") + F.col("committed")).alias("total"),
        money("flexible").alias("flexible"), money("committed").alias("committed"), "txn_count")
    keys = ["user_id", "ym"]
    top = agg.top_categories(ledger).select(*keys, "top_category", "top_amount", "top_pct")
    big = agg.biggest_charge(ledger).select(*keys, F.col("description").alias("biggest"), F.col("amount").alias("biggest_amount"))
    comparison = month_comparison(ledger)
    return base.join(comparison, keys).join(top, keys, "left").join(big, keys, "left")


def top_transactions(ledger: DataFrame, n: int = 5) -> DataFrame:
    """Largest flexible charges of each month and category."""
    rows = with_period(spend(ledger)).filter(~F.col("is_fixed")).withColumn("category", F.coalesce("category", F.lit("Other")))
    best = top_per_group(rows, ["user_id", "ym", "category"], [F.desc("spent"), F.col("seq")], n)
    return best.select("user_id", "ym", "category", "rank", F.col("transaction_date").alias("date"), "description", money("spent").alias("amount"))


def largest_expenses(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Ten largest expenses of each user."""
    best = top_per_group(with_period(spend(ledger)), ["user_id"], [F.desc("spent"), F.col("seq")], n)
    return best.select("user_id", "rank", "transaction_id", "description", money("spent").alias("amount"))


def month_gaps(ledger: DataFrame) -> DataFrame:
    """Holes in each user's months with the names of the missing months."""
    w = Window.partitionBy("user_id").orderBy("idx")
    m = user_months(ledger).withColumn("idx", month_index("ym")).withColumn("next", F.lead("idx").over(w))
    holes = m.filter(F.col("next") - F.col("idx") > 1)
    missing = F.transform(
        F.sequence(F.col("idx") + 1, F.col("next") - 1), lambda i: month_long(month_from_index(i)))
    return holes.select(
        "user_id", F.col("ym").alias("gap_after"), month_from_index(F.col("next")).alias("gap_before"),
        F.size(missing).alias("n_missing"), F.array_join(missing, ", ").alias("missing"))


def first_gap_note(ledger: DataFrame) -> DataFrame:
    """The earliest gap of each user as a sentence."""
    gaps = month_gaps(ledger)
    first = gaps.groupBy("user_id").agg(F.min_by(F.struct("gap_after", "gap_before", "missing"), F.col("gap_after")).alias("g"))
    names = F.split("g.missing", ", ")
    span = F.when(F.size(names) == 1, names[0]).otherwise(F.concat(names[0], F.lit("–"), F.element_at(names, -1)))
    text = F.concat(
        F.lit("Heads up: your history jumps from "), month_long("g.gap_after"), F.lit(" to "), month_long("g.gap_before"),
        F.lit(", so the months in between ("), span, F.lit(") are missing — uploading those will make this noticeably more accurate."))
    return first.select("user_id", text.alias("gap_note"))


def category_listing(ledger: DataFrame, category: str) -> DataFrame:
    """Money-out rows of one category with the user's category total; `periods.page` orders what is shown, largest first."""
    rows = with_period(ledger.filter((F.col("category") == category) & is_spend()))
    totals = rows.groupBy("user_id").agg(F.sum("spent").alias("sum"), F.count(F.lit(1)).alias("n"))
    return rows.join(totals, "user_id").select(
        "user_id", "transaction_id", "transaction_date", "description", "bank_source", money("spent").alias("amount"),
        money("sum").alias("category_total"), F.col("n").alias("category_count"))


def flexible_change(ledger: DataFrame, as_of: dt.date) -> DataFrame:
    """Flexible spend against the whole spend of the previous data month; hidden for partial or thin months."""
    m = user_months(ledger).join(agg.client_month_cents(ledger), ["user_id", "ym"], "left").fillna(0, ["variable", "fixed", "n_rows"])
    m = m.withColumn("before", F.lag(F.col("variable") + F.col("fixed")).over(Window.partitionBy("user_id").orderBy("ym")))
    part = agg.partial_month(ledger, as_of).filter("is_partial").select("user_id", "ym", F.lit(True).alias("partial"))
    m = m.join(part, ["user_id", "ym"], "left")
    change = F.when(F.col("before") > 0, round_ratio(F.col("variable") - F.col("before"), "before", 1000) / 10)
    m = m.withColumn("change_pct", change)
    shown = F.col("change_pct").isNotNull() & F.col("partial").isNull() & (F.col("n_rows") >= 10)
    return m.select("user_id", "ym", money("variable").alias("variable"), "change_pct", shown.alias("is_shown"))
