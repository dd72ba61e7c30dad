"""One interpretive sentence per user, month and category.

Rows are pre-aggregated by raw description and by day before names are cleaned, so the display-name work and the burst
window run over a handful of rows per category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.columns import first_match, round_ratio, top_per_group
from tallybook.functions.merchants import display_merchant
from tallybook.operators.periods import spend, with_period

KEYS = ["user_id", "ym", "category"]


def flexible_rows(ledger: DataFrame) -> DataFrame:
    rows = with_period(spend(ledger)).filter(~F.coalesce(F.col("is_fixed"), F.lit(False)))
    return rows.withColumn("category", F.coalesce("category", F.lit("Other")))


def _shown(c: str):
    return F.coalesce(F.nullif(display_merchant(c), F.lit("")), F.lit("Unknown"))


def burst_windows(ledger: DataFrame) -> DataFrame:
    """Largest forward 48-hour sum of each category month with its first and last day (earliest on ties)."""
    days = flexible_rows(ledger).groupBy(*KEYS, F.col("transaction_date").alias("d")).agg(F.sum("spent").alias("spent"), F.count(F.lit(1)).alias("n"))
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    ahead = Window.partitionBy(*KEYS).orderBy("day").rangeBetween(0, 2)
    w = days.withColumn("day", day).withColumns({"window_sum": F.sum("spent").over(ahead), "window_end": F.max("d").over(ahead)})
    return w.groupBy(*KEYS).agg(
        F.min_by(F.struct(F.col("d").alias("start"), F.col("window_end").alias("end"), F.col("window_sum").alias("sum")), F.struct(-F.col("window_sum"), F.col("d"))).alias("b"),
        F.sum("n").alias("n"), F.sum("spent").alias("total"), F.coalesce(F.sum(F.when(F.weekday("d") >= 5, F.col("spent"))), F.lit(0).cast("long")).alias("weekend"),
    ).select(*KEYS, F.col("b.start").alias("burst_start"), F.col("b.end").alias("burst_end"), F.col("b.sum").alias("burst_sum"), "n", "total", "weekend")


def category_insights(ledger: DataFrame) -> DataFrame:
    """(template, text): first of seven templates that fits."""
    rows = flexible_rows(ledger)
    by_text = rows.groupBy(*KEYS, "description").agg(F.count(F.lit(1)).alias("n"), F.sum("spent").alias("spent"), F.min("seq").alias("s"), F.max("spent").alias("hi"), F.min("spent").alias("lo"), F.min(F.struct(-F.col("spent"), F.col("seq"))).alias("top"))
    named = by_text.withColumn("name", _shown("description"))
    m = named.groupBy(*KEYS, "name").agg(F.sum("n").alias("n"), F.sum("spent").alias("spent"), F.min("s").alias("s"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.min("top").alias("top"))
    by_spend = top_per_group(m, KEYS, [F.desc("spent"), F.col("s")], 2)
    leaders = by_spend.groupBy(*KEYS).agg(*[F.max(F.when(F.col("rank") == i, F.struct("name", "spent"))).alias(f"m{i}") for i in (1, 2)])
    g = m.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_merchants"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.min(F.struct("top", "name")).alias("t"),
        F.min(F.struct((-F.col("n")).alias("n"), -F.col("spent"), "s", "name")).alias("repeat"))
    x = g.join(leaders, KEYS).join(burst_windows(ledger), KEYS)
    total, c = F.col("total"), F.col("category")
    span = F.col("burst_start") != F.col("burst_end")
    phrase = F.concat(F.date_format("burst_start", "MMM d"), F.lit("–"), F.date_format("burst_end", "d"))
    usd = lambda n, d=None: F.concat(F.lit("$"), round_ratio(n, F.lit(100) if d is None else d * 100).cast("string"))
    say = lambda name, *parts: F.struct(F.lit(name).alias("template"), F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("text"))
    v = first_match(
        [
            (F.col("n_merchants") == 1, say("single_merchant", "All from one merchant: ", F.col("m1.name"), ".")),
            ((F.col("hi") * 2 > total) & (F.col("n") > 1), say("dominance", "One purchase made up most of this category: ", F.col("t.name"), " was ", round_ratio("hi", "total", 100).cast("string"), "% of ", c, " spend.")),
            ((F.col("n") >= 2) & (F.col("burst_sum") * 10 >= total * 4) & span, say("burst", "Most spend happened in a 2-day burst around ", phrase, ".")),
            (F.col("repeat.n") <= -3, say("repeat_merchant", "You visited ", F.col("repeat.name"), " ", (-F.col("repeat.n")).cast("string"), " times this month.")),
            (F.col("weekend") * 10 >= total * 7, say("weekend", "Most ", c, " spend happened on weekends.")),
            ((F.col("m1.spent") + F.col("m2.spent")) * 10 > total * 4, say("concentration", "Most spend was at ", F.col("m1.name"), " and ", F.col("m2.name"), ".")),
        ],
        say("fallback", "Purchases ranged from ", usd("lo"), " to ", usd("hi"), ", averaging ", usd("total", F.col("n")), "."),
    )
    return x.withColumn("v", v).select(*KEYS, "v.template", "v.text")
