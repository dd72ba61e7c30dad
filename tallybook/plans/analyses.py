"""Curated analyses: structured facts with the sentence a user reads, for every user and month.

Month summaries come from the cash-flow aggregate; category and merchant facts from small per-month aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.columns import all_of, cents, dollars, first_match, idiv, money, month_key, month_long, percent, round_ratio, top_per_group
from tallybook.functions import fixed_values as v
from tallybook.functions.merchants import ordinal, three_word_key
from tallybook.operators import aggregates as agg
from tallybook.operators.periods import user_months, with_period

# Verbs are not needed, only the categories that can be trimmed and the sentence pieces below.
BULLET = "• "


def _t(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def posted(ledger: DataFrame) -> DataFrame:
    return ledger.filter(~F.coalesce(F.col("is_pending"), F.lit(False)))


def _line(label: str, c: str) -> Column:
    return F.when(F.col(c) != 0, _t(f"{BULLET}{label} — ", dollars(c)))


def net_cash_flow(ledger: DataFrame) -> DataFrame:
    """Headline, money in and money out of each month."""
    s = agg.cash_flow_cents(posted(ledger))
    month = month_long("ym")
    head = F.when(F.col("net") >= 0, _t("In ", month, " you came out ahead by ", dollars("net"), ".")).otherwise(_t("In ", month, " you spent ", dollars("net"), " more than came in."))
    spend_line = F.when(F.col("net_expenses") != 0, _t(f"{BULLET}Spending — ", dollars("net_expenses"), F.when(F.col("card_credit") != 0, _t(" (after ", dollars("card_credit"), " in card credits)")).otherwise("")))
    ins = F.array_join(F.array_compact(F.array(_line("Income", "income"), _line("Refunds", "refunds"), _line("Transfers in", "transfers_in"))), "\n")
    outs = F.array_join(F.array_compact(F.array(spend_line, _line("Cash withdrawn", "cash"), _line("Transfers out", "transfers_out"))), "\n")
    answer = _t(head, "\n\nMoney in — ", dollars("money_in"), "\n", ins, "\n\nMoney out — ", dollars("money_out"), "\n", outs, "\n\nCredit card payments are left out so spending isn't counted twice.")
    return s.select("user_id", "ym", money("net").alias("net"), answer.alias("answer"))


def disclaimer_notes(ledger: DataFrame) -> DataFrame:
    """Context notes of each month as rows: (user_id, ym, position, note); a month without notes gets none."""
    rows = posted(ledger)
    n_months = user_months(rows).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_months"))
    s = agg.cash_flow_cents(rows).join(n_months, "user_id")
    fixed = F.array(
        F.struct(F.lit(1).alias("position"), F.when(F.col("income") == 0, F.lit("no income was found in your uploads, so this reflects spending only — add a checking account or tell me your monthly income for a complete picture")).alias("note")),
        F.struct(F.lit(2).alias("position"), F.when(F.col("card_credit") >= 20000, _t(dollars("card_credit"), " in card statement credits are offsetting your spending")).alias("note")),
        F.struct(F.lit(4).alias("position"), F.when(F.col("transfers_out") >= 10000, _t(dollars("transfers_out"), " in outgoing transfers is counted as money out — if any of that was moving money to your own savings, your real spending is lower")).alias("note")),
        F.struct(F.lit(5).alias("position"), F.when(F.col("n_months") < 2, F.lit("this is based on a single month of data")).alias("note")))
    general = s.select("user_id", "ym", F.explode_outer(fixed).alias("x")).select("user_id", "ym", "x.*").filter("note is not null")
    big = agg.big_money_back(rows).filter("kind = 'refund'")
    refunds = big.select("user_id", "ym", F.lit(3).alias("position"), _t("a ", dollars(cents("amount")), " refund (", F.col("description"), ") is included in money in — it may be for a purchase from an earlier month").alias("note"))
    return general.unionByName(refunds)


def summary_text(ledger: DataFrame) -> DataFrame:
    """Category lines of the compact text summary: share of gross expenses per category, high to low."""
    exp = agg.flow_expenses(posted(ledger))
    cats = exp.groupBy("user_id", "ym", "category").agg(F.sum("spent").alias("spent"))
    w = Window.partitionBy("user_id", "ym")
    cats = cats.withColumn("gross", F.sum("spent").over(w))
    return cats.select("user_id", "ym", "category", _t("  - ", F.col("category"), ": ", dollars("spent"), " (", percent("spent", "gross").cast("long").cast("string"), "%)").alias("line"))


def _category_months(ledger: DataFrame, categories: list[str]) -> DataFrame:
    rows = with_period(posted(ledger).filter((agg.flow_type() == "expense") & F.col("category").isin(categories) & F.col("transaction_date").isNotNull()))
    return rows.groupBy("user_id", "ym", "category").agg(F.sum("spent").alias("spent"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("s"))


def affordability(ledger: DataFrame, amount_cents: int) -> DataFrame:
    """Where room for a purchase could come from, per user and data month.

    Multi-month users: categories above 1.05x their prior mean, easing back to their prior low, at most three, filled in
    order of room. Prior months are all other data months of the user (three rows or more).
    """
    c = _category_months(ledger, v.TRIMMABLE_CATEGORIES)
    months = agg.months_with_data(posted(ledger)).select("user_id", "ym")
    known = c.join(months, ["user_id", "ym"], "left_semi")
    # Leave-one-out statistics from per-category totals and the two smallest months.
    low = F.array_sort(F.collect_list(F.struct("spent", "ym")))
    stats = known.groupBy("user_id", "category").agg(F.sum("spent").alias("sum"), F.count(F.lit(1)).alias("k"), F.slice(low, 1, 2).alias("lows"))
    x = c.join(stats, ["user_id", "category"]).join(months.withColumn("listed", F.lit(1)), ["user_id", "ym"], "left")
    own = F.coalesce(F.col("listed"), F.lit(0))
    x = x.withColumns({"prior_n": F.col("k") - own, "prior_sum": F.col("sum") - F.when(own == 1, F.col("spent")).otherwise(0)})
    x = x.withColumn("low", F.get(F.filter("lows", lambda s: s["ym"] != F.col("ym")), F.lit(0))["spent"]).filter("prior_n > 0")
    rose = x.filter("spent * prior_n * 100 > prior_sum * 105").withColumn("room", F.col("spent") - F.col("low"))
    w = Window.partitionBy("user_id", "ym").orderBy(F.desc("room"), F.desc("category"))
    rose = top_per_group(rose, ["user_id", "ym"], [F.desc("room"), F.desc("category")], 3)
    rose = rose.withColumn("before", F.coalesce(F.sum("room").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    picked = rose.filter(F.col("before") < amount_cents).withColumn("take", F.least(F.col("room"), F.lit(amount_cents) - F.col("before")))
    return picked.select("user_id", "ym", "rank", "category", money("spent").alias("current"), money("low").alias("low"), money("take").alias("frees"),
                         (F.col("before") + F.col("take") >= amount_cents).alias("covers"))


def single_month_trims(ledger: DataFrame, amount_cents: int) -> DataFrame:
    """Gentle cuts within one month: at most a third of the visits of the three largest categories with two or more."""
    c = _category_months(ledger, v.TRIMMABLE_CATEGORIES).filter("n >= 2")
    top = top_per_group(c, ["user_id", "ym"], [F.desc("spent"), F.col("s")], 3)
    items = top.groupBy("user_id", "ym").agg(F.array_sort(F.collect_list(F.struct("rank", "category", "spent", "n"))).alias("items"))
    # The running amount is kept in exact cents times visits, so shares of a mean never round on the way.
    start = F.struct(F.lit(0.0).alias("done"), F.expr("cast(array() as array<struct<category:string,cut:bigint,visits:bigint,spent:bigint>>)").alias("picks"))

    def step(acc, x):
        need = F.lit(float(amount_cents)) - acc["done"]
        mean = x["spent"] / x["n"]
        wanted = F.ceil(need / mean)
        cut = F.greatest(F.lit(1).cast("long"), F.least(wanted, F.greatest(F.lit(1).cast("long"), idiv(x["n"], F.lit(3).cast("long")))))
        pick = F.struct(x["category"].alias("category"), cut.alias("cut"), x["n"].alias("visits"), x["spent"].alias("spent"))
        more = F.struct((acc["done"] + cut * mean).alias("done"), F.concat(acc["picks"], F.array(pick)).alias("picks"))
        return F.when((acc["done"] >= amount_cents) | (x["spent"] <= 0), acc).otherwise(more)

    folded = items.withColumn("f", F.aggregate("items", start, step))
    out = folded.select("user_id", "ym", F.posexplode_outer("f.picks").alias("position", "p")).filter("p is not null")
    return out.select("user_id", "ym", "position", "p.category", "p.cut", "p.visits", money(round_ratio(F.col("p.spent") * F.col("p.cut"), F.col("p.visits"))).alias("saves"))


def lifestyle_creep(ledger: DataFrame) -> DataFrame:
    """Latest data month against the mean of the earlier ones: discretionary categories up most, three per user."""
    months = agg.months_with_data(posted(ledger)).select("user_id", "ym")
    span = months.groupBy("user_id").agg(F.max("ym").alias("latest"), (F.count(F.lit(1)) - 1).alias("k")).filter("k >= 2")
    c = _category_months(ledger, v.DISCRETIONARY_CATEGORIES).join(months, ["user_id", "ym"], "left_semi").join(span, "user_id")
    now = F.col("ym") == F.col("latest")
    g = c.groupBy("user_id", "latest", "k", "category").agg(F.sum(F.when(now, F.col("spent"))).alias("cur"), F.coalesce(F.sum(F.when(~now, F.col("spent"))), F.lit(0).cast("long")).alias("old"))
    up = g.filter("cur * k > old and cur >= 3000").withColumn("delta_k", F.col("cur") * F.col("k") - F.col("old"))
    best = top_per_group(up, ["user_id"], [F.desc("delta_k"), F.desc("category")], 3)
    usd = lambda n: _t("$", F.format_number(round_ratio(n, F.col("k") * 100), 0))
    text = F.when(F.col("old") > 0, _t(F.col("category"), " is up ", usd("delta_k"), " (", round_ratio("delta_k", "old", 100).cast("string"), "% over your ", usd("old"), " average)")).otherwise(_t(F.col("category"), " is new this month at ", dollars("cur")))
    return best.select("user_id", F.col("latest").alias("ym"), "rank", "category", money("cur").alias("current"), money(round_ratio("old", "k")).alias("average"), text.alias("fact"))


def recurring_charges(ledger: DataFrame) -> DataFrame:
    """Merchants that look like subscriptions or bills: latest charge, earlier mean and price rise."""
    rows = with_period(posted(ledger).filter((agg.flow_type() == "expense") & F.col("transaction_date").isNotNull())).withColumn("key", three_word_key("description")).filter("key <> ''")
    n_months = rows.select("user_id", "ym").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_months"))
    first = F.min(F.struct("seq", F.coalesce("category", F.lit("Other")).alias("category"), F.coalesce("description", F.lit("")).alias("text"))).alias("f")
    by_month = rows.groupBy("user_id", "key", "ym").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "spent")).alias("a"), first)
    g = by_month.groupBy("user_id", "key").agg(
        F.count(F.lit(1)).alias("months"), F.max("n").alias("most"), F.min("a.spent").alias("lo"), F.max("a.spent").alias("hi"), F.min("f").alias("f"),
        F.max_by("a.spent", "ym").alias("latest"), F.sum("a.spent").alias("sum"))
    g = g.join(n_months, "user_id").filter("months >= 2 and n_months >= 2")
    steady = all_of([F.col("most") == 1, F.col("lo") > 0, (F.col("hi") - F.col("lo")) * 100 <= F.col("lo") * 8])
    g = g.filter(F.col("f.category").isin("Subscriptions", "Insurance", "Bills & Utilities") | steady)
    earlier, k = F.col("sum") - F.col("latest"), F.col("months") - 1
    rise = (earlier > 0) & (F.col("latest") * k * 100 > earlier * 105) & (F.col("latest") * k - earlier >= k * 100)
    return g.select(
        "user_id", "key", F.substring("f.text", 1, 28).alias("name"), F.col("f.category").alias("category"), "months", money("latest").alias("latest"),
        money(round_ratio(earlier, k)).alias("earlier_average"), rise.alias("price_rise"), (~F.col("f.category").isin("Rent/Mortgage", "Loan Payment")).alias("is_listed"))


def duplicate_charges(ledger: DataFrame) -> DataFrame:
    """Same merchant, day and amount more than once, five dollars or more."""
    rows = with_period(posted(ledger).filter(agg.flow_type() == "expense")).withColumn("key", three_word_key("description")).filter("key <> ''")
    g = rows.groupBy("user_id", "key", "transaction_date", "spent").agg(F.count(F.lit(1)).alias("times"))
    return g.filter("times > 1 and spent >= 500").select("user_id", "key", F.col("transaction_date").alias("date"), money("spent").alias("amount"), "times")


def spending_velocity(ledger: DataFrame) -> DataFrame:
    """Daily pace of discretionary spend: mean over active days, heaviest day, first against second half."""
    rows = with_period(posted(ledger).filter((agg.flow_type() == "expense") & F.col("transaction_date").isNotNull()))
    rows = rows.filter(~F.coalesce("category", F.lit("Other")).isin(v.OBLIGATION_CATEGORIES))
    days = rows.groupBy("user_id", "ym", F.col("transaction_date").alias("d")).agg(F.sum("spent").alias("spent"), F.min("seq").alias("s"))
    m = days.groupBy("user_id", "ym").agg(
        F.sum("spent").alias("total"), F.count(F.lit(1)).alias("days"), F.coalesce(F.sum(F.when(F.dayofmonth("d") <= 15, F.col("spent"))), F.lit(0).cast("long")).alias("first"),
        F.min_by(F.struct("d", "spent"), F.struct(-F.col("spent"), F.col("s"))).alias("peak"))
    second = F.col("total") - F.col("first")
    halves = _t(dollars("first"), " in the first half, ", dollars(second), " in the second.")
    shape = first_match([(second * 100 > F.col("first") * 115, _t("It picked up later in the month — ", halves)), (F.col("first") * 100 > second * 115, _t("You front-loaded the month — ", halves))], _t("It stayed fairly even — ", halves))
    answer = _t("In ", month_long("ym"), " your day-to-day spending came to ", dollars("total"), " across ", F.col("days").cast("string"), " days — about $", F.format_number(round_ratio(F.col("total"), F.col("days") * 100), 0),
                " a day. Your heaviest was the ", ordinal(F.dayofmonth("peak.d")), " at ", dollars("peak.spent"), ". ", shape)
    return m.select("user_id", "ym", money("total").alias("total"), "days", F.col("peak.d").alias("peak_day"), money("peak.spent").alias("peak"), answer.alias("answer"))


def latest_meaningful_month(ledger: DataFrame) -> DataFrame:
    """Newest month with three rows or more; the newest of any size where there is none."""
    m = posted(ledger).groupBy("user_id", month_key().alias("ym")).agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("n") >= 3, F.col("ym"))), F.max("ym")).alias("ym"))
