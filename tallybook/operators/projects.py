"""Projects: filter-driven assignment, progress and spend cards.

A project's filters become equi keys (account or any, category or any, a whole month or single days), reduced to the
earliest project per key; a row probes at most eight keys. No row-project pairs are built.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.columns import cents, money, month_key, round_ratio, round_ratio_up, top_per_group
from tallybook.operators.periods import is_spend, with_period

ASSIGNABLE = ["expense", "refund", "transfer", "cash"]
ANY = "*"


def _interval_keys(start: Column, end: Column) -> Column:
    """Whole months inside [start, end] as yyyy-MM, the remaining days as yyyy-MM-dd."""
    days = F.sequence(start, end)
    first_full = F.when(F.dayofmonth(start) == 1, start).otherwise(F.add_months(F.trunc(start, "month"), 1))
    last_full = F.when(end == F.last_day(end), F.trunc(end, "month")).otherwise(F.add_months(F.trunc(end, "month"), -1))
    inside = lambda d: (F.trunc(d, "month") >= first_full) & (F.trunc(d, "month") <= last_full)
    return F.array_distinct(F.transform(days, lambda d: F.when(inside(d), F.date_format(d, "yyyy-MM")).otherwise(d.cast("string"))))


def assign(ledger: DataFrame, projects: DataFrame) -> DataFrame:
    """(user_id, transaction_id, project_id): each unassigned eligible row goes to the earliest matching project."""
    rows = ledger.filter(~F.col("is_pending") & F.col("transaction_type").isin(ASSIGNABLE) & F.col("transaction_date").isNotNull())
    if "project_id" in ledger.columns:
        rows = rows.filter("project_id is null")
    span = rows.groupBy("user_id").agg(F.min("transaction_date").alias("lo"), F.max("transaction_date").alias("hi"))
    p = projects.join(span, "user_id")
    # An open bound means the user's own first or last day; bounds outside the data are cut to it.
    p = p.withColumn("lo", F.greatest("lo", "filter_start_date")).withColumn("hi", F.least("hi", "filter_end_date")).filter("lo <= hi")
    listed = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.col(c)).otherwise(F.array(F.lit(ANY)))
    p = p.withColumn("account", F.explode(listed("filter_accounts"))).withColumn("cat", F.explode(listed("filter_categories")))
    p = p.withColumn("when", F.explode(_interval_keys(F.col("lo"), F.col("hi"))))
    first = p.groupBy("user_id", "account", "cat", "when").agg(F.min(F.struct("created_at", F.col("id").alias("project_id"))).alias("p"))
    probe = [F.struct(a.alias("account"), c.alias("cat"), w.alias("when"))
             for a in (F.coalesce("bank_source", F.lit("")), F.lit(ANY)) for c in (F.coalesce("category", F.lit("")), F.lit(ANY)) for w in (month_key(), F.col("transaction_date").cast("string"))]
    # Rows sharing user, account, category and day share their answer.
    combos = rows.select("user_id", "bank_source", "category", "transaction_date").distinct()
    hits = combos.withColumn("k", F.explode(F.array(*probe))).select("user_id", "bank_source", "category", "transaction_date", "k.*").join(first, ["user_id", "account", "cat", "when"])
    best = hits.groupBy("user_id", "bank_source", "category", "transaction_date").agg(F.min("p").alias("p"))
    b = best.select(*[F.col(c).alias(f"_{c}") for c in best.columns])
    same = [rows[c].eqNullSafe(b[f"_{c}"]) for c in ("user_id", "bank_source", "category", "transaction_date")]
    return rows.join(b, same).select("user_id", "transaction_id", F.col("_p.project_id").alias("project_id"))


def progress(projects: DataFrame, tagged: DataFrame, as_of: dt.date) -> DataFrame:
    """Current amount, percentage, remaining and on-track flag. `tagged` is ledger rows with project_id."""
    c = cents()
    sums = tagged.groupBy("project_id").agg(
        F.coalesce(F.sum(F.when(c < 0, -c)), F.lit(0).cast("long")).alias("out"), F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0).cast("long")).alias("in"), F.count(F.lit(1)).alias("n"))
    p = projects.join(sums, projects.id == sums.project_id, "left").fillna(0, ["out", "in", "n"])
    p = p.withColumns({"current": F.when(F.col("type") == "debt", F.col("out")).otherwise(F.col("in")), "target": F.coalesce(cents("target_amount"), F.lit(0).cast("long"))})
    has = F.col("target") > 0
    created = F.col("created_at").cast("date")
    total_days, elapsed = F.datediff("target_date", created).cast("long"), F.datediff(F.lit(as_of), created).cast("long")
    track = F.when(has & (total_days > 0), F.col("current") * total_days * 10 >= elapsed * F.col("target") * 9)
    pct = F.when(has, F.least(round_ratio("current", "target", 1000), F.lit(1000)) / 10).otherwise(0.0)
    return p.select("id", "user_id", "type", money("target").alias("target_amount"), money("current").alias("current_amount"), pct.alias("percentage"),
                    F.when(has, money(F.greatest(F.col("target") - F.col("current"), F.lit(0).cast("long")))).alias("remaining"), track.alias("on_track"), F.col("n").alias("transaction_count"))


def listing(projects: DataFrame, tagged: DataFrame, as_of: dt.date, include_archived: bool = False) -> DataFrame:
    """Projects with their progress and when they were made, by which a shown page is ordered."""
    p = projects if include_archived else projects.filter(~F.col("is_archived"))
    return progress(p, tagged, as_of).join(p.select("id", "created_at"), "id")


def spend_cards(tagged: DataFrame) -> DataFrame:
    """Expense total, count and four largest categories of each project."""
    rows = with_period(tagged.filter(is_spend() & F.col("project_id").isNotNull()))
    cats = rows.groupBy("project_id", F.coalesce("category", F.lit("Other")).alias("category")).agg(F.sum("spent").alias("val"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("s"))
    totals = cats.groupBy("project_id").agg(F.sum("val").alias("total"), F.sum("n").alias("count"))
    best = top_per_group(cats, ["project_id"], [F.desc("val"), F.col("s")], 4)
    return best.join(totals, "project_id").select("project_id", money("total").alias("total"), "count", "rank", "category", money("val").alias("amount"), round_ratio_up("val", "total", 100).alias("pct"))
