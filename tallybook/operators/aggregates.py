"""Month, category, account and cash-flow aggregates, for every user at once.

All of these combine map-side: what is shuffled is one row per group and input partition, so a user or month that
holds a third of the ledger costs no more than any other.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.columns import (
    cents, contains_any, month_key, money, percent, round_ratio, round_ratio_up, top_per_group,
)
from tallybook.operators.periods import spend, user_months, with_period

# The client's fixed categories and card-credit phrases.
CLIENT_FIXED_CATEGORIES = [
    "bills & utilities", "bills", "utilities", "rent", "mortgage", "insurance", "loan payment", "debt payment",
    "credit card payment",
]
CARD_CREDIT_PHRASES = [
    "uber one credit", "amex credit", "credit applied", "statement credit", "annual credit", "travel credit",
    "hotel credit", "reward credit", "cash back", "cashback", "capital one credit", "membership credit",
]


def total(condition: Column, value: Column | None = None) -> Column:
    """Conditional sum, 0 when nothing matches."""
    value = F.col("spent") if value is None else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0).cast("long"))


def is_client_fixed() -> Column:
    return F.coalesce(F.col("is_fixed"), F.lit(False)) | F.lower(F.coalesce("category", F.lit(""))).isin(
        CLIENT_FIXED_CATEGORIES
    )


def is_card_credit() -> Column:
    text = contains_any(F.lower(F.coalesce("description", F.lit(""))), CARD_CREDIT_PHRASES)
    return (F.col("transaction_type") == "card_credit") | (text & (F.col("amount") > 0))


def month_cents(ledger: DataFrame) -> DataFrame:
    """Per user and month, in cents: flexible, committed, txn_count."""
    fixed = F.coalesce(F.col("is_fixed"), F.lit(False))
    return (
        with_period(spend(ledger))
        .groupBy("user_id", "ym")
        .agg(total(~fixed).alias("flexible"), total(fixed).alias("committed"), F.count(F.lit(1)).alias("txn_count"))
    )


def month_totals(ledger: DataFrame) -> DataFrame:
    t = month_cents(ledger)
    return t.select(
        "user_id", "ym", money(F.col("flexible") + F.col("committed")).alias("total"),
        money("flexible").alias("flexible"), money("committed").alias("committed"), "txn_count",
    )


def category_cents(ledger: DataFrame) -> DataFrame:
    """Per user, month, category and fixed flag, in cents, with the first row's order key for stable ties."""
    return (
        with_period(spend(ledger))
        .withColumn("category", F.coalesce("category", F.lit("Other")))
        .withColumn("is_fixed", F.coalesce(F.col("is_fixed"), F.lit(False)))
        .groupBy("user_id", "ym", "category", "is_fixed")
        .agg(F.sum("spent").alias("spent"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    )


def category_drilldown(ledger: DataFrame) -> DataFrame:
    """Flexible spend per category with its share of the month, count and mean."""
    month = Window.partitionBy("user_id", "ym")
    cats = category_cents(ledger).filter(~F.col("is_fixed")).withColumn("flex", F.sum("spent").over(month))
    return cats.select(
        "user_id", "ym", "category", money("spent").alias("amount"), percent("spent", "flex", 1).alias("pct_of_flexible"),
        F.col("n").alias("txn_count"), money(round_ratio("spent", "n")).alias("avg_amount"),
    )


def top_categories(ledger: DataFrame) -> DataFrame:
    """Largest flexible and largest fixed category of each month; ties go to the one seen first."""
    cats = category_cents(ledger)
    rank = F.struct(-F.col("spent"), F.col("first_seq"))
    flex = ~F.col("is_fixed")
    best = F.struct("category", "spent", "n")
    out = cats.groupBy("user_id", "ym").agg(
        F.min_by(F.when(flex, best), F.when(flex, rank)).alias("d"),
        F.min_by(F.when(~flex, best), F.when(~flex, rank)).alias("f"),
        total(flex).alias("flex"),
    )
    return out.select(
        "user_id", "ym", F.col("d.category").alias("top_category"), money("d.spent").alias("top_amount"),
        percent("d.spent", "flex", 1).alias("top_pct"), F.col("d.n").alias("top_count"),
        F.col("f.category").alias("fixed_category"), money("f.spent").alias("fixed_amount"),
    )


def biggest_charge(ledger: DataFrame) -> DataFrame:
    """The largest single flexible charge of each month; ties go to the earliest row."""
    flex = with_period(spend(ledger)).filter(~F.coalesce(F.col("is_fixed"), F.lit(False)))
    pick = F.struct("description", "transaction_date", "category", "spent")
    best = flex.groupBy("user_id", "ym").agg(F.min_by(pick, F.struct(-F.col("spent"), F.col("seq"))).alias("b"))
    return best.select(
        "user_id", "ym", F.col("b.description").alias("description"), F.col("b.transaction_date").alias("date"),
        F.coalesce("b.category", F.lit("Other")).alias("category"), money("b.spent").alias("amount"),
    )


def months_with_data(ledger: DataFrame, min_rows: int = 3) -> DataFrame:
    """Months with at least `min_rows` rows of any type."""
    dated = ledger.filter(F.col("transaction_date").isNotNull())
    counts = dated.groupBy("user_id", month_key().alias("ym")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_rows)


# Types outside the cash flow.
NON_CASH_FLOW_TYPES = ["credit_card_payment", "excluded", "reimbursement"]
OTHER_FLOW_TYPES = ["income", "refund", "card_credit", "transfer", "cash"] + NON_CASH_FLOW_TYPES


def flow_type() -> Column:
    return F.lower(F.coalesce("transaction_type", F.lit("expense")))


def is_flow_expense() -> Column:
    """Anything that is no other known type counts as an expense."""
    return ~flow_type().isin(OTHER_FLOW_TYPES)


def cash_flow_cents(ledger: DataFrame) -> DataFrame:
    """Per user and month, in cents: income, refunds, credits, transfers in/out, cash, gross/net expenses, in/out/net."""
    t, c = flow_type(), cents()
    size = F.abs(c)
    sums = (
        ledger.filter(F.col("transaction_date").isNotNull())
        .groupBy("user_id", month_key().alias("ym"))
        .agg(
            total((t == "income") & (c > 0), c).alias("income"),
            total(t == "refund", size).alias("refunds"),
            total(t == "card_credit", size).alias("card_credit"),
            total((t == "transfer") & (c > 0), c).alias("transfers_in"),
            total((t == "transfer") & (c <= 0), size).alias("transfers_out"),
            total(t == "cash", size).alias("cash"),
            total(is_flow_expense(), size).alias("gross_expenses"),
            F.count(F.lit(1)).alias("n_rows"),
            F.array_join(F.array_sort(F.collect_set("bank_source")), ", ").alias("accounts"),
        )
    )
    return (
        sums.withColumn("net_expenses", F.col("gross_expenses") - F.col("card_credit"))
        .withColumn("money_in", F.expr("income + refunds + transfers_in"))
        .withColumn("money_out", F.expr("net_expenses + cash + transfers_out"))
        .withColumn("net", F.expr("money_in - money_out"))
    )


FLOW_COLUMNS = [
    "income", "refunds", "card_credit", "transfers_in", "transfers_out", "cash", "gross_expenses", "net_expenses",
    "money_in", "money_out", "net",
]


def flow_expenses(ledger: DataFrame) -> DataFrame:
    """Rows that count as expenses in the cash flow, with `ym` and absolute cents."""
    dated = ledger.filter(is_flow_expense() & F.col("transaction_date").isNotNull())
    return with_period(dated).withColumn("category", F.coalesce("category", F.lit("Other")))


def cash_flow_summary(ledger: DataFrame) -> DataFrame:
    """Cash flow with the categories by size and the five largest expenses as sorted arrays of text."""
    exp = flow_expenses(ledger)
    cats = exp.groupBy("user_id", "ym", "category").agg(F.sum("spent").alias("spent"), F.min("seq").alias("first_seq"))
    by_size = F.array_sort(F.collect_list(F.struct(-F.col("spent"), F.col("first_seq"), F.col("category"))))
    cats = cats.groupBy("user_id", "ym").agg(F.array_join(F.transform(by_size, lambda s: s["category"]), "; ").alias("top_cats"))
    top5 = top_per_group(exp, ["user_id", "ym"], [F.desc("spent"), F.col("seq")], 5)
    item = F.concat(F.coalesce("description", F.lit("Unknown")), F.lit(" ["), F.col("category"), F.lit("]"))
    ranked = F.array_sort(F.collect_list(F.struct(F.col("rank"), item.alias("item"))))
    top5 = top5.groupBy("user_id", "ym").agg(F.array_join(F.transform(ranked, lambda s: s["item"]), "; ").alias("top_expenses"))
    flow = cash_flow_cents(ledger).join(cats, ["user_id", "ym"], "left").join(top5, ["user_id", "ym"], "left")
    return flow.select(
        "user_id", "ym", *[money(c).alias(c) for c in FLOW_COLUMNS], "accounts",
        F.coalesce("top_cats", F.lit("")).alias("top_cats"), F.coalesce("top_expenses", F.lit("")).alias("top_expenses"),
    )


def big_money_back(ledger: DataFrame, least: int = 200) -> DataFrame:
    """Refunds and card credits of at least `least` dollars, one row each."""
    kind = flow_type()
    rows = ledger.filter(kind.isin("refund", "card_credit") & (F.abs(cents()) >= least * 100))
    fallback = F.when(kind == "refund", "refund").otherwise("statement credit")
    return rows.select(
        "user_id", month_key().alias("ym"), kind.alias("kind"), F.abs("amount").alias("amount"),
        F.coalesce("description", fallback).alias("description"), "seq",
    )


def totals_by_type(ledger: DataFrame) -> DataFrame:
    """Card credits, transfers, card payments and refunds per month: absolute sums and counts."""
    wanted = ["card_credit", "transfer", "credit_card_payment", "refund"]
    rows = with_period(ledger.filter(F.col("transaction_type").isin(wanted)))
    wide = rows.groupBy("user_id", "ym").pivot("transaction_type", wanted).agg(F.sum("spent").alias("sum"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    out = []
    for t in wanted:
        out += [money(F.coalesce(f"{t}_sum", zero)).alias(f"{t}_total"), F.coalesce(f"{t}_n", zero).alias(f"{t}_count")]
    return wide.select("user_id", "ym", *out)


def client_month_cents(ledger: DataFrame) -> DataFrame:
    """Month split by the client's notion of fixed (flag or category), in cents."""
    rows = with_period(spend(ledger)).filter(~is_card_credit())
    fixed = is_client_fixed()
    return rows.groupBy("user_id", "ym").agg(
        total(~fixed).alias("variable"), total(fixed).alias("fixed"), F.count(F.lit(1)).alias("n_rows"),
    )


def spending_share(ledger: DataFrame) -> DataFrame:
    """Discretionary and fixed share of each month; the two always add to 100."""
    m = client_month_cents(ledger).withColumn("all", F.col("variable") + F.col("fixed"))
    m = m.withColumn("discretionary_pct", round_ratio_up("variable", "all", 100))
    return m.select(
        "user_id", "ym", money("variable").alias("discretionary"), money("fixed").alias("fixed"), "discretionary_pct",
        (100 - F.col("discretionary_pct")).alias("fixed_pct"), F.col("n_rows").alias("txn_count"),
    )


def full_months(ledger: DataFrame) -> DataFrame:
    """Months covering at least 20 days (or, with fewer than two dated rows, five rows)."""
    day = F.dayofmonth("transaction_date")
    dated = ledger.filter(F.col("transaction_date").isNotNull())
    m = dated.groupBy("user_id", month_key().alias("ym")).agg(F.count(F.lit(1)).alias("n"), (F.max(day) - F.min(day)).alias("span"))
    return m.select("user_id", "ym", F.col("n").alias("txn_count"), "span", F.when(F.col("n") < 2, F.col("n") >= 5).otherwise(F.col("span") >= 20).alias("is_full"))


def budget_multiplier(ledger: DataFrame) -> DataFrame:
    """How many months a multi-month budget spans: up to 3 for '3m', all full months for 'all'."""
    m = full_months(ledger).groupBy("user_id").agg(F.count_if("is_full").alias("n_full"), F.count(F.lit(1)).alias("n_months"))
    basis = F.when(F.col("n_full") > 0, F.col("n_full")).otherwise(F.col("n_months"))
    return m.select("user_id", "n_full", "n_months", F.least(F.lit(3), basis).alias("x3m"), F.greatest(basis, F.lit(1)).alias("xall"))


def budget_for_month(months: DataFrame, history: DataFrame, profile: DataFrame) -> DataFrame:
    """Budget of a month: the month's snapshot, else the profile value, else 0. Inputs carry cents."""
    h = history.select("user_id", "ym", F.nullif(F.col("budget"), F.lit(0)).alias("snapshot"))
    p = profile.select("user_id", F.col("budget").alias("standing"))
    joined = months.join(h, ["user_id", "ym"], "left").join(p, ["user_id"], "left")
    return joined.withColumn("budget", F.coalesce("snapshot", "standing", F.lit(0)).cast("long")).drop("snapshot", "standing")


def budget_use(ledger: DataFrame, history: DataFrame, profile: DataFrame, as_of: dt.date) -> DataFrame:
    """Budget used, left and over flag per month; expected pace only for the month of `as_of`."""
    m = budget_for_month(client_month_cents(ledger), history, profile)
    has = F.col("budget") > 0
    today = F.lit(as_of)
    days, elapsed = F.dayofmonth(F.last_day(today)).cast("long"), F.dayofmonth(today).cast("long")
    now = has & (F.col("ym") == F.date_format(today, "yyyy-MM"))
    used = F.when(has, F.least(round_ratio_up("variable", "budget", 100), F.lit(100))).otherwise(0)
    return m.select(
        "user_id", "ym", money("budget").alias("budget"), money("variable").alias("variable"), used.cast("long").alias("used_pct"),
        F.when(has, money(F.col("budget") - F.col("variable"))).alias("left_to_spend"),
        (has & (F.col("variable") > F.col("budget"))).alias("is_over"),
        F.when(now, money(round_ratio(F.col("variable") * days, elapsed))).alias("projected"),
        F.when(now, days - elapsed).alias("days_left"),
        F.when(now, F.col("variable") * days * 10 <= F.col("budget") * elapsed * 11).alias("on_track"),
    )


def partial_month(ledger: DataFrame, as_of: dt.date) -> DataFrame:
    """For the month of `as_of`: does the data start after the first day?"""
    ym = as_of.strftime("%Y-%m")
    rows = ledger.filter(month_key() == ym).groupBy("user_id").agg(
        F.min("transaction_date").alias("earliest"), F.max("transaction_date").alias("latest"))
    return rows.select("user_id", F.lit(ym).alias("ym"), "earliest", "latest", (F.dayofmonth("earliest") > 1).alias("is_partial"))


def accounts_in_months(ledger: DataFrame) -> DataFrame:
    """Distinct accounts of each month."""
    rows = ledger.filter(F.col("bank_source").isNotNull() & F.col("transaction_date").isNotNull())
    return rows.select("user_id", month_key().alias("ym"), "bank_source").distinct()


def usage_against_cap(log: DataFrame, as_of: dt.date, cap: int = 10) -> DataFrame:
    """Requests of each user since the first of the month of `as_of`, against a monthly cap."""
    since = log.filter(F.col("created_at") >= F.lit(as_of.replace(day=1)).cast("timestamp"))
    used = since.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    return used.select("user_id", "used", F.lit(cap).alias("cap"), (F.col("used") >= cap).alias("capped"))


def with_manual_fixed(ledger: DataFrame, manual: DataFrame) -> DataFrame:
    """Fixed spend per month including the user's manual fixed items (cents in `manual.amount_cents`)."""
    extra = manual.groupBy("user_id").agg(F.sum("amount_cents").alias("manual"))
    m = client_month_cents(ledger).join(extra, "user_id", "left")
    m = m.withColumn("manual", F.coalesce("manual", F.lit(0).cast("long")))
    return m.select(
        "user_id", "ym", money("fixed").alias("fixed"), money("manual").alias("manual_fixed"),
        money(F.col("fixed") + F.col("manual")).alias("fixed_all"),
    )


def spending_impact(ledger: DataFrame, income: DataFrame, as_of: dt.date) -> DataFrame:
    """Up to three facts per user about flexible spend in the month of `as_of`, in order of importance."""
    ym = as_of.strftime("%Y-%m")
    # Exclusions are not applied here, as in the client's goals page.
    rows = with_period(spend(ledger, include_excluded=True)).filter((F.col("ym") == ym) & ~F.col("is_fixed"))
    cats = rows.groupBy("user_id", F.coalesce("category", F.lit("Other")).alias("category")).agg(
        F.sum("spent").alias("spent"), F.min("seq").alias("first_seq"))
    everything = cats.groupBy("user_id").agg(F.sum("spent").alias("expenses"))
    named = cats.filter(~F.col("category").isin("Transfer", "Payment", "Other", "Income"))
    named = named.withColumn("val", round_ratio_up("spent", F.lit(100)))
    named = top_per_group(named, ["user_id"], [F.desc("val"), F.col("first_seq")], 6)
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    facts = named.groupBy("user_id").agg(
        pick(F.col("rank") == 1, "category").alias("c1"), pick(F.col("rank") == 1, "val").alias("v1"),
        pick(F.col("rank") == 2, "category").alias("c2"), pick(F.col("rank") == 2, "val").alias("v2"),
        pick(F.col("category") == "Subscriptions", "val").alias("subs"),
    )
    facts = everything.join(facts, "user_id", "left").join(income, "user_id", "left")
    usd = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    texts = F.array_compact(F.array(
        F.when(F.col("v1") > 50, F.concat(F.lit("You spent "), usd(F.col("v1")), F.lit(" on "), F.col("c1"), F.lit(" — cutting 20% saves ~"), usd(round_ratio_up(F.col("v1"), F.lit(5))), F.lit("/mo"))),
        F.when(F.col("subs") > 30, F.concat(F.lit("Subscriptions total "), usd(F.col("subs")), F.lit("/mo — auditing unused ones is quick savings"))),
        F.when((F.col("income") > 0) & (F.col("expenses") > 0), F.concat(F.lit("Your spending is "), round_ratio_up("expenses", "income", 100).cast("string"), F.lit("% of take-home pay this month"))),
        F.when(F.col("c2").isNotNull(), F.concat("c1", F.lit(" + "), "c2", F.lit(" make up most of your discretionary spending — "), usd(F.col("v1") + F.col("v2")), F.lit("/mo"))),
    ))
    return facts.select("user_id", F.posexplode(F.slice(texts, 1, 3)).alias("position", "fact"))


def card_only_users(ledger: DataFrame) -> DataFrame:
    """Users whose every source is a card issuer and who show no rent, mortgage, car or HOA text."""
    from tallybook.functions.signals import CARD_SOURCE_WORDS, HOUSING_WORDS

    src = F.lower(F.coalesce("bank_source", F.lit("")))
    desc = F.lower(F.coalesce("description", F.lit("")))
    flags = ledger.groupBy("user_id").agg(
        F.every(contains_any(src, CARD_SOURCE_WORDS)).alias("all_cards"), F.some(contains_any(desc, HOUSING_WORDS)).alias("has_housing"))
    return flags.select("user_id", "all_cards", "has_housing", (F.col("all_cards") & ~F.col("has_housing")).alias("card_only"))


def newest_month(ledger: DataFrame) -> DataFrame:
    return user_months(ledger).groupBy("user_id").agg(F.max("ym").alias("ym"))
