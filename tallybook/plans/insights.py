"""Ranked spending insights for every user and data month in one job.

The ledger is read once, into mergeable sums per user, month, category, text and flags. Everything a rule needs is merged
from those sums to one wide row per user and month (from month, category, merchant and subscription aggregates); the rules
are then plain columns of that row, and nothing is gathered beyond the at most eighteen insights of a month.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.columns import contains_any, dollars_plain, first_match, idiv, round_ratio, title_case
from tallybook.functions import fixed_values as v
from tallybook.functions import signals as sg
from tallybook.functions.merchants import prefix_key
from tallybook.operators.aggregates import budget_for_month
from tallybook.operators.periods import is_flexible, is_spend, with_period
from tallybook.sources.sinks import stored

# Row types the insights read and word lists of single rules.
READ_TYPES = ["expense", "income", "transfer", "credit_card_payment"]
UNRANKED_CATEGORIES = ["Transfer", "Payment", "Income", "Other"]
COMMITTED_WORDS = ["mortgage", "mtg", "loan", "rent", "insurance", "lakeview", "payment"]
NEW_MERCHANT_SKIP = ["mortgage", "mtg", "loan", "lakeview", "rent", "insurance", "bmw", "auto", "vehicle", "pymt", "payment"]
NEW_MERCHANT_SKIP_CATEGORIES = ["Loan Payment", "Bills & Utilities", "Insurance"]
LOAN_WORDS = ["bmw", "mortgage", "mtg pymt", "loan pymt", "car payment", "auto loan", "student loan", "lakeview", "vehicle"]
DINING = "Food & Dining"

OUT = ["id", "type", "score", "title", "body", "action", "action_filter"]


def insight_rows(ledger: DataFrame, include_excluded: bool = True) -> DataFrame:
    """Posted money-out expense rows with the fields the rules read."""
    rows = ledger.filter(F.col("transaction_type").isin(READ_TYPES) & ~F.coalesce(F.col("is_pending"), F.lit(False)) & is_spend() & F.col("transaction_date").isNotNull())
    if not include_excluded:
        rows = rows.filter("exclusion_reason is null")
    text = F.coalesce("description", F.lit(""))
    weekend, zero = F.weekday("transaction_date") >= 5, F.lit(0).cast("long")
    rows = with_period(rows).select(
        "user_id", "ym", "seq", "spent", text.alias("text"), F.coalesce("category", F.lit("Other")).alias("category"),
        F.coalesce(F.col("is_fixed"), F.lit(False)).alias("is_fixed"), is_flexible().alias("is_flex"),
        sg.is_subscription("category", "description", v.INSIGHT_SUBSCRIPTION_KEYWORDS).alias("is_sub"),
        F.lit(1).cast("long").alias("n"), F.col("spent").alias("first_spent"), weekend.cast("long").alias("wknd_n"), F.when(weekend, F.col("spent")).otherwise(zero).alias("wknd"),
        F.when(F.dayofmonth("transaction_date") >= 24, F.col("spent")).otherwise(zero).alias("late"))
    # Only charges above 200 can be outliers.
    big = (F.col("spent") > 20000) & F.col("is_flex") & ~contains_any(F.lower("text"), LOAN_WORDS)
    return rows.withColumn("big_seq", F.when(big, F.col("seq")))


def merged_rows(rows: DataFrame) -> DataFrame:
    """`insight_rows` with equal rows merged into sums; a possible outlier stays a row of its own.

    `seq` and `first_spent` are those of the first row, for rules that name a single charge. The columns stay the same, so the sums merge on and every aggregate below reads either form.
    """
    keys = ["user_id", "ym", "text", "category", "is_fixed", "is_flex", "is_sub", "big_seq"]
    return rows.groupBy(*keys).agg(F.min("seq").alias("seq"), F.min_by("first_spent", "seq").alias("first_spent"), *[F.sum(x).alias(x) for x in ("spent", "n", "wknd_n", "wknd", "late")])


def _sum(cond: Column, what: str = "spent") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(what))), F.lit(0).cast("long"))


def _count(cond: Column) -> Column:
    return _sum(cond, "n")


def _months(rows: DataFrame) -> DataFrame:
    """One row per user and data month with lags, position and the user's month count."""
    low = F.lower("text")
    dining, sub = F.col("category") == DINING, F.col("is_sub")
    loan_free = F.col("is_flex") & ~contains_any(low, LOAN_WORDS)
    keywords = list(dict.fromkeys(k for ks, _, _ in v.SUBSCRIPTION_BUNDLES for k in ks))
    aggs = [
        F.sum("n").alias("n"), F.sum("spent").alias("total"), _sum(F.col("is_flex")).alias("flex"),
        _count(dining).alias("dining_n"), _sum(dining).alias("dining"), F.sum("wknd_n").alias("wknd_n"), F.sum("wknd").alias("wknd"), (F.sum("spent") - F.sum("wknd")).alias("wkdy"),
        F.sum("late").alias("late"), _sum(sub).alias("sub_total"),
        F.count_distinct(F.when(sub, F.trim(F.substring("text", 1, 15)))).alias("sub_n"),
        _count(loan_free).alias("free_n"), _sum(loan_free).alias("free"),
    ]
    aggs += [F.bool_or(sub & low.contains(k)).alias(f"kw_{i}") for i, k in enumerate(keywords)]
    aggs += [_sum(sub & contains_any(low, ks)).alias(f"bundle_{i}") for i, (ks, _, _) in enumerate(v.SUBSCRIPTION_BUNDLES)]
    m = rows.groupBy("user_id", "ym").agg(*aggs)
    for i, (ks, _, _) in enumerate(v.SUBSCRIPTION_BUNDLES):
        m = m.withColumn(f"match_{i}", sum((F.col(f"kw_{keywords.index(k)}").cast("int") for k in ks), F.lit(0)))
    user = Window.partitionBy("user_id")
    w = user.orderBy("ym")
    m = m.withColumns({"pos": F.row_number().over(w), "n_months": F.count(F.lit(1)).over(user)})
    return m.withColumns({f"{p}{c}": F.lag(c, k).over(w) for k, p in ((1, "p_"), (2, "pp_")) for c in ("n", "flex", "dining_n")})


def _shifted(df: DataFrame, pos: DataFrame, ahead: int) -> DataFrame:
    """Each month's rows again as history of the following `ahead` data months: column `back` is 0, 1 or 2."""
    out = df.join(pos, ["user_id", "ym"]).withColumn("back", F.explode(F.array(*[F.lit(i) for i in range(ahead + 1)])))
    return out.withColumn("pos", F.col("pos") + F.col("back"))


def _category_picks(rows: DataFrame, pos: DataFrame) -> DataFrame:
    c = rows.groupBy("user_id", "ym", "category").agg(F.sum("spent").alias("spent"), _sum(~F.col("is_fixed")).alias("loose"), F.min("seq").alias("s"))
    c = c.filter(~F.col("category").isin(UNRANKED_CATEGORIES)).join(pos, ["user_id", "ym"])
    # Rolling mean per category over every month but the user's last.
    roll = c.filter("pos < n_months").groupBy("user_id", "category").agg(F.sum("spent").alias("r_sum"), F.count(F.lit(1)).alias("r_n"))
    at = lambda back, x: F.max(F.when(F.col("back") == back, F.col(x)))
    g = _shifted(c.drop("pos", "n_months"), pos, 2).groupBy("user_id", "pos", "category").agg(
        at(0, "spent").alias("c0"), at(1, "spent").alias("c1"), at(2, "spent").alias("c2"), at(0, "loose").alias("l0"), at(1, "loose").alias("l1"), at(0, "s").alias("s0"), at(1, "s").alias("s1"))
    g = g.join(roll, ["user_id", "category"], "left")
    up = (F.col("c2") > 0) & (F.col("c1") * 10 > F.col("c2") * 12) & (F.col("c0") * 10 > F.col("c1") * 12)
    down = (F.col("l1") > 5000) & (F.col("l0") >= 1000) & (F.col("l0") * 100 < F.col("l1") * 85)
    pick = lambda cond, order, *cols: F.min(F.when(cond, F.struct(order, "category", *cols)))
    return g.groupBy("user_id", "pos").agg(
        pick(up, "s0", "c0", "c1", "c2").alias("t1"), pick(down, "s1", "l0", "l1").alias("t2"),
        pick(F.col("s0").isNotNull() & (F.col("r_n") >= 2), "s0", "c0", "r_sum", "r_n").alias("a2"))


def _merchant_months(rows: DataFrame) -> DataFrame:
    """Sums and first rows of each merchant key per user and month."""
    k = rows.withColumn("key", prefix_key("text", 12)).filter("key <> ''")
    flex, fixed = F.col("is_flex"), F.col("is_fixed")
    first = lambda cond: F.min(F.when(cond, F.struct("seq", "text")))
    return k.groupBy("user_id", "ym", "key").agg(
        F.sum("n").alias("n"), F.min(F.struct("seq", "text")).alias("f"), _sum(flex).alias("flex"), _count(flex).alias("flex_n"), first(flex).alias("ff"),
        F.bool_or(flex & F.col("category").isin(NEW_MERCHANT_SKIP_CATEGORIES)).alias("skip_cat"), _sum(fixed).alias("fixed"), _count(fixed).alias("fixed_n"), first(fixed).alias("fx"))


def _merchant_picks(k: DataFrame, pos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per month: top flexible merchant, changed fixed merchant; new-merchant candidates; and first merchant with history."""
    at = lambda back, x: F.max(F.when(F.col("back") == back, F.col(x)))
    g = _shifted(k, pos, 1).groupBy("user_id", "pos", "key").agg(
        *[at(0, x).alias(x) for x in ("flex", "flex_n", "ff", "fixed", "fixed_n", "fx", "skip_cat")], at(1, "fixed").alias("p_fixed"), at(1, "fixed_n").alias("p_fixed_n"))
    life = k.groupBy("user_id", "key").agg(F.count(F.lit(1)).alias("months"), F.sum("n").alias("rows"), F.min("f").alias("f"), F.min("ym").alias("only_ym"))
    g = g.join(life.select("user_id", "key", "months"), ["user_id", "key"])
    mine = (F.col("flex_n") > 0) & ~contains_any("key", COMMITTED_WORDS)
    fresh = mine & (F.col("months") == 1) & ~contains_any("key", NEW_MERCHANT_SKIP) & ~F.col("skip_cat")
    picks = g.groupBy("user_id", "pos").agg(
        F.min(F.when(mine, F.struct((-F.col("flex")).alias("neg"), F.col("ff.seq").alias("s"), "key", "flex_n"))).alias("b4"),
        F.min(F.when((F.col("fixed_n") > 0) & (F.col("p_fixed_n") > 0), F.struct(F.col("fx.seq").alias("s"), "key", "fixed", "p_fixed", F.col("fx.text").alias("text")))).alias("f1"))
    new = g.filter(fresh).select("user_id", "pos", "flex", "ff")
    # First merchant (by its first row ever) that also occurs outside the month: a multi-month one, or the earliest
    # single-month one of another month; the two earliest months suffice.
    multi = life.filter("months > 1").groupBy("user_id").agg(F.min(F.struct("f", "key", "months", "rows")).alias("multi"))
    single = life.filter("months = 1").groupBy("user_id", "only_ym").agg(F.min(F.struct("f", "key", "months", "rows")).alias("one"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("one"))
    two = single.withColumn("r", rank).filter("r <= 2").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("one", "only_ym"))).alias("singles"))
    hist = multi.join(two, "user_id", "full")
    return picks, new, hist.join(pos, "user_id").withColumn(
        "h", F.array_min(F.array_compact(F.concat(F.array("multi"), F.transform(F.filter(F.coalesce("singles", F.array()), lambda s: s["only_ym"] != F.col("ym")), lambda s: s["one"]))))
    ).select("user_id", "ym", "h").join(k.select("user_id", "ym", F.col("key").alias("hk"), F.col("n").alias("h_now")), ["user_id", "ym"], "left").filter(
        F.col("h.key").isNotNull()).groupBy("user_id", "ym", "h").agg(F.coalesce(F.max(F.when(F.col("hk") == F.col("h.key"), F.col("h_now"))), F.lit(0).cast("long")).alias("h_now"))


def _cancelled(rows: DataFrame, pos: DataFrame) -> DataFrame:
    """First charge of last month for a subscription key seen in both earlier months and not in this one."""
    k = rows.filter("is_sub").withColumn("key", F.lower(F.substring("text", 1, 10)))
    k = k.groupBy("user_id", "ym", "key").agg(F.min(F.struct("seq", "text", F.col("first_spent").alias("spent"))).alias("f"))
    seen = lambda back: F.bool_or(F.col("back") == back)
    g = _shifted(k, pos, 2).groupBy("user_id", "pos", "key").agg(seen(0).alias("now"), seen(1).alias("last"), seen(2).alias("before"), F.min(F.when(F.col("back") == 1, F.col("f"))).alias("f"))
    return g.filter("last and before and not now").groupBy("user_id", "pos").agg(F.min("f").alias("w3"))


# Which optional aggregates a rule reads; every other rule needs only the month aggregate.
RULE_PARTS = {"B4": "merchant", "T1": "category", "T2": "category", "T3": "new", "A1": "outlier", "A2": "category", "A3": "history", "F1": "merchant", "W3": "cancelled"}
ALL_PARTS = frozenset(RULE_PARTS.values())
PART_SCHEMAS = {
    "category": {"t1": "struct<s0:string,category:string,c0:bigint,c1:bigint,c2:bigint>", "t2": "struct<s1:string,category:string,l0:bigint,l1:bigint>", "a2": "struct<s0:string,category:string,c0:bigint,r_sum:bigint,r_n:bigint>"},
    "merchant": {"b4": "struct<neg:bigint,s:string,key:string,flex_n:bigint>", "f1": "struct<s:string,key:string,fixed:bigint,p_fixed:bigint,text:string>"},
    "history": {"h": "struct<f:struct<seq:string,text:string>,key:string,months:bigint,rows:bigint>", "h_now": "bigint"},
    "cancelled": {"w3": "struct<seq:string,text:string,spent:bigint>"},
    "new": {"t3": "struct<s:string,text:string,flex:bigint>"},
    "outlier": {"a1": "struct<seq:string,text:string,spent:bigint>"},
}


def wide_months(ledger: DataFrame, history: DataFrame, profile: DataFrame, include_excluded: bool = True, only: list[str] | None = None) -> DataFrame:
    """The wide month row; with `only` (rule ids) the aggregates no rule asks for are left out of the plan.

    For all rules the merged sums, the months and the merchant months are written once, as several aggregates read each.
    """
    need = ALL_PARTS if only is None else {RULE_PARTS[r] for r in only if r in RULE_PARTS}
    once = stored if only is None else lambda df, name: df
    rows = insight_rows(ledger, include_excluded)
    rows = once(merged_rows(rows) if only is None else rows, "insight-sums")
    base = once(budget_for_month(_months(rows), history, profile), "insight-months")
    pos = base.select("user_id", "ym", "pos", "n_months")
    slim, by_pos, by_month = pos.select("user_id", "ym", "pos"), ["user_id", "pos"], ["user_id", "ym"]
    picks, new, hist = _merchant_picks(once(_merchant_months(rows), "insight-merchants"), slim) if need & {"merchant", "new", "history"} else (None, None, None)
    m = base
    if "category" in need:
        m = m.join(_category_picks(rows, pos), by_pos, "left")
    if "merchant" in need:
        m = m.join(picks, by_pos, "left")
    if "cancelled" in need:
        m = m.join(_cancelled(rows, slim), by_pos, "left")
    if "history" in need:
        m = m.join(hist, by_month, "left")
    if "new" in need:
        big_new = new.join(base.select("user_id", "pos", "budget"), by_pos).filter("budget > 0 and flex * 10 > budget")
        m = m.join(big_new.groupBy("user_id", "pos").agg(F.min(F.struct(F.col("ff.seq").alias("s"), F.col("ff.text").alias("text"), "flex")).alias("t3")), by_pos, "left")
    if "outlier" in need:
        big = rows.filter("big_seq is not null").select("user_id", "ym", "seq", "text", "spent")
        big = big.join(base.select("user_id", "ym", "free", "free_n"), by_month).filter("free_n >= 3 and spent * free_n * 10 > free * 25")
        m = m.join(big.groupBy("user_id", "ym").agg(F.min(F.struct("seq", "text", "spent")).alias("a1")), by_month, "left")
    absent = {c: F.lit(None).cast(t) for part, cols in PART_SCHEMAS.items() if part not in need for c, t in cols.items()}
    return m.withColumns(absent) if absent else m


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _str(c: Column) -> Column:
    return c.cast("string")


def _tenths(num: Column, den: Column) -> Column:
    t = round_ratio(num, den, 10)
    return _text(_str(idiv(t, F.lit(10).cast("long"))), ".", _str(t % 10))


def _usd_ratio(num: Column, den: Column) -> Column:
    """Whole dollars of num/den cents."""
    return _text("$", _str(round_ratio(num, den * 100)))


def rules(as_of: dt.date) -> list[tuple[str, Column, Column]]:
    """(id, condition, insight struct) in evaluation order, over the columns of `wide_months`."""
    c = F.col
    now = c("ym") == as_of.strftime("%Y-%m")
    day = F.when(now, as_of.day).otherwise(28)
    usd = dollars_plain
    has_prev = c("p_n").isNotNull()

    def made(rule, kind, score, title, body, action=None, action_filter=None):
        s = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x).cast("string")
        score = score if isinstance(score, Column) else F.lit(score)
        return F.struct(F.lit(rule).alias("id"), F.lit(kind).alias("type"), score.cast("int").alias("score"), s(title).alias("title"), s(body).alias("body"), s(action).alias("action"), s(action_filter).alias("action_filter"))

    out = []
    threshold = F.when(now, max(4, round(6 * as_of.day / 30))).otherwise(6)
    dn = c("dining_n")
    target = F.greatest(dn - 3, idiv(dn * 3, F.lit(4).cast("long")))
    every = round_ratio(F.lit(30), dn)
    often = F.when(every <= 1, "almost every day").when(every == 2, "every other day").otherwise(_text("every ", _str(every), " days"))
    out.append(("B1", dn >= threshold, made("B1", "behavior", F.when(dn > 10, 7).otherwise(6), _text("You dined out ", _str(dn), " times this month — ", often),
                _text("Avg ", _usd_ratio(c("dining"), dn), " per visit. Cutting to ", _str(target), " times saves ~", _usd_ratio((dn - target) * c("dining"), dn), "/mo."), "View dining transactions", DINING)))
    out.append(("B2", (c("wknd_n") > 0) & (c("n") > c("wknd_n")) & (c("wknd") * 220 > c("wkdy") * 104), made("B2", "behavior", 5, _text("You spend ", _tenths(c("wknd") * 22, c("wkdy") * 8), "× more per day on weekends"),
                _text(usd("wknd"), " on weekends vs ", usd("wkdy"), " on weekdays this month."))))
    out.append(("B3", (c("total") > 0) & (c("late") * 100 > c("total") * 35), made("B3", "behavior", 4, _text(_str(round_ratio("late", "total", 100)), "% of your spending happens in the last week"),
                _text(usd("late"), " in the final 7 days. Spreading purchases earlier helps budget tracking."))))
    top, tn = -c("b4.neg"), c("b4.flex_n")
    out.append(("B4", (c("flex") > 0) & (top * 100 > c("flex") * 15), made("B4", "behavior", 5, _text(title_case("b4.key"), " is ", _str(round_ratio(top, c("flex"), 100)), "% of your flexible spending"),
                _text(usd(top), " across ", _str(tn), " transaction", F.when(tn > 1, "s").otherwise(""), " — avg ", _usd_ratio(top, tn), " each."))))
    out.append(("B5", (c("sub_n") >= 4) | ((c("budget") > 0) & (c("sub_total") * 10 > c("budget"))), made("B5", "behavior", F.when(c("sub_n") >= 6, 6).otherwise(5), _text(_str(c("sub_n")), " active subscriptions · ", usd("sub_total"), "/mo"),
                _text("That's ", usd(c("sub_total") * 12), "/year. When did you last audit what you actually use?"), "View subscriptions", "Subscriptions")))
    out.append(("T1", c("t1").isNotNull(), made("T1", "trend", 8, _text(c("t1.category"), " has grown 3 months in a row"), _text(usd("t1.c2"), " → ", usd("t1.c1"), " → ", usd("t1.c0"), ". Worth reviewing before it becomes a habit."),
                _text("View ", c("t1.category")), c("t1.category"))))
    out.append(("T2", c("t2").isNotNull() & (day >= 15), made("T2", "win", 7, _text(c("t2.category"), " down ", _str(round_ratio(c("t2.l1") - c("t2.l0"), c("t2.l1"), 100)), "% vs last month"),
                _text(usd("t2.l0"), " this month vs ", usd("t2.l1"), " last month. You saved ", usd(c("t2.l1") - c("t2.l0")), ". Keep it up!"))))
    out.append(("T3", has_prev & c("t3").isNotNull(), made("T3", "trend", 6, _text("New merchant: ", title_case(F.trim(F.substring("t3.text", 1, 25)))),
                _text(usd("t3.flex"), " — that's ", _str(round_ratio("t3.flex", "budget", 100)), "% of your budget. First time seeing this charge."))))
    left = 30 - as_of.day
    pace = c("flex") * 30
    over = round_ratio(pace - c("p_flex") * as_of.day, c("p_flex") * as_of.day, 100)
    ahead = has_prev & now & F.lit(as_of.day > 5 and left > 10) & (c("p_flex") > 0) & (pace * 100 > c("p_flex") * as_of.day * 115)
    out.append(("T4", ahead, made("T4", "trend", F.when(over > 30, 8).otherwise(7), _text("On pace for ", _usd_ratio(pace, F.lit(as_of.day)), " — ", _str(over), "% above last month"),
                _text(usd("flex"), f" spent so far with {left} days left. Last month was ", usd("p_flex"), "."))))
    a1 = c("a1.spent")
    out.append(("A1", c("a1").isNotNull(), made("A1", "anomaly", 6, _text("One charge made up ", _str(round_ratio(a1, c("total"), 100)), "% of your spending"),
                _text(F.substring("a1.text", 1, 25), " · ", usd(a1), " — that's ", _str(round_ratio(a1 * c("free_n"), c("free"))), "× your average transaction. One-time or new recurring?"))))
    out.append(("A2", (c("n_months") >= 3) & (c("a2.c0") * c("a2.r_n") > c("a2.r_sum") * 3), made("A2", "anomaly", 8, _text(c("a2.category"), " is ", _str(round_ratio(c("a2.c0") * c("a2.r_n"), c("a2.r_sum"))), "× your usual spend"),
                _text(usd("a2.c0"), " this month vs your ", _usd_ratio(c("a2.r_sum"), c("a2.r_n")), " average. One-time event or new pattern?"), _text("View ", c("a2.category")), c("a2.category"))))
    hm = c("h.months") - (c("h_now") > 0).cast("long")
    hr = c("h.rows") - c("h_now")
    out.append(("A3", (c("n_months") >= 3) & (hr >= hm * 2) & (c("h_now") * hm * 10 > hr * 25), made("A3", "anomaly", 6, _text(title_case(F.trim(F.substring("h.f.text", 1, 20))), " · ", _str(c("h_now")), "× this month vs usual ", _str(round_ratio(hr, hm)), "×"),
                _text("You visited ", _tenths(c("h_now") * hm, hr), "× more than usual. Small habit adding up?"))))
    bundle = first_match([(c(f"match_{i}") >= 2, _text("Overlapping ", kind, " subscriptions detected")) for i, (_, kind, _) in enumerate(v.SUBSCRIPTION_BUNDLES)])
    advice = first_match([(c(f"match_{i}") >= 2, _text(tip, ". You're spending ", usd(f"bundle_{i}"), "/mo on overlapping services.")) for i, (_, _, tip) in enumerate(v.SUBSCRIPTION_BUNDLES)])
    out.append(("O2", bundle.isNotNull(), made("O2", "optimization", 7, bundle, advice, "View subscriptions", "Subscriptions")))
    fc, fpv = c("f1.fixed"), c("f1.p_fixed")
    change = round_ratio(fc - fpv, fpv, 100)
    month = F.substring("ym", 6, 2).cast("int")
    note = first_match([
        (month.isin(6, 7, 8) & c("f1.key").contains("electric"), " Expected in summer — AC usage peaks Jun-Aug."),
        ((month == 1) & c("f1.key").contains("gym"), " January gym spikes are common — worth tracking if it sticks."),
        (month.isin(11, 12), " Common in holiday season — check for annual renewals.")], "")
    short = F.substring("f1.text", 1, 20)
    clean = F.trim(F.substring(title_case(F.trim(F.regexp_replace(short, r"[\d\-\*]{4,}", ""))), 1, 25))
    out.append(("F1", (fpv > 0) & (F.abs(fc - fpv) * 10 > fpv), made("F1", "fixed", 4, _text(F.when(clean != "", clean).otherwise(title_case(short)), " ", F.when(change > 0, "increased").otherwise("decreased"), " by ", _str(F.abs(change)), "%"),
                _text(usd(fc), " this month vs ", usd(fpv), " last month.", note))))
    used, rest = round_ratio("flex", "budget", 100), c("budget") - c("flex")
    streak = F.coalesce((c("p_flex") > 0) & (c("p_flex") * 10 < c("budget") * 9), F.lit(False))
    out.append(("W2", (c("budget") > 0) & (c("flex") * 10 < c("budget") * 9), made("W2", "win", F.when(streak, 8).otherwise(5),
                F.when(streak, _text("You're ", _str(100 - used), "% under budget — 2 months running")).otherwise(_text("On track — ", _str(used), "% of budget used")),
                F.when(streak, _text(usd(rest), " still available. Solid discipline — that's ", usd(rest * 12), "/year in savings if it holds.")).otherwise(_text(usd(rest), " remaining. You're managing well this month.")))))
    out.append(("W3", c("w3").isNotNull() & (c("n_months") >= 3), made("W3", "win", 7, _text("Looks like you cancelled ", title_case(F.substring("w3.text", 1, 20))), _text("Saving ", usd("w3.spent"), "/mo — that's ", usd(c("w3.spent") * 12), "/year back in your pocket."))))
    out.append(("W4", (c("pp_flex") > 0) & (c("p_flex") < c("pp_flex")) & (c("flex") < c("p_flex")), made("W4", "win", 9, "Flexible spending down 2 months in a row", _text(usd("pp_flex"), " → ", usd("p_flex"), " → ", usd("flex"), ". You're trending in the right direction. Keep going!"))))
    drop = c("p_dining_n") - dn
    out.append(("W5", has_prev & (day >= 15) & (c("p_dining_n") > 0) & (dn * 10 < c("p_dining_n") * 8) & (drop <= 10), made("W5", "win", 6, _text("You dined out ", _str(drop), " fewer times than last month"), _text(_str(dn), " this month vs ", _str(c("p_dining_n")), " last month. Small habit, real savings."))))
    return out


def is_partial() -> Column:
    return (F.col("n") < 10) | F.coalesce((F.col("p_n") > 0) & (F.col("n") * 10 < F.col("p_n") * 4), F.lit(False))


def partial_months(wide: DataFrame) -> DataFrame:
    """Months with too little data: a single upload nudge instead of insights."""
    return wide.filter(is_partial()).select("user_id", "ym", F.lit("PARTIAL").alias("id"), F.lit("info").alias("type"), F.lit(10).alias("score"),
        F.concat(F.lit("Only "), _str(F.col("n")), F.lit(" transactions found for this month")).alias("title"),
        F.lit("Upload your complete statement for accurate insights and spending comparisons.").alias("body"), F.lit("Upload complete statement").alias("action"), F.lit(None).cast("string").alias("action_filter"))


def candidate_arrays(wide: DataFrame, as_of: dt.date, only: list[str] | None = None) -> DataFrame:
    fired = [F.when(cond, made) for rule, cond, made in rules(as_of) if only is None or rule in only]
    return wide.filter(~is_partial()).select("user_id", "ym", F.array_compact(F.array(*fired)).alias("found"))


def candidates(wide: DataFrame, as_of: dt.date, only: list[str] | None = None) -> DataFrame:
    """Every insight that fires, before ranking."""
    found = candidate_arrays(wide, as_of, only)
    return found.select("user_id", "ym", F.explode_outer("found").alias("i")).filter("i is not null").select("user_id", "ym", "i.*")


def _ranked(found: Column) -> Column:
    """Top win, then others by score with type and category diversity, then further wins; six at most, wins first."""
    spot = F.transform(found, lambda x, i: F.struct((-x["score"]).alias("neg"), i.alias("at"), x.alias("x")))
    best = F.transform(F.array_sort(spot), lambda s: s["x"])
    wins, others = F.filter(best, lambda x: x["type"] == "win"), F.filter(best, lambda x: x["type"] != "win")

    def consider(acc, x):
        repeated = F.exists(acc, lambda a: a["type"] == x["type"]) & (F.size(acc) > 2)
        same = x["action_filter"].isNotNull() & F.exists(acc, lambda a: a["action_filter"].eqNullSafe(x["action_filter"]))
        return F.when((F.size(acc) >= 6) | repeated | same, acc).otherwise(F.concat(acc, F.array(x)))

    picked = F.aggregate(others, F.slice(wins, 1, 1), consider)
    return F.slice(F.concat(picked, F.slice(wins, 2, 18)), 1, 6)


def ranked_insights(wide: DataFrame, as_of: dt.date) -> DataFrame:
    """Final list of each month with its rank, including the nudge of partial months."""
    found = candidate_arrays(wide, as_of).withColumn("found", _ranked(F.col("found")))
    order = F.array_sort(F.transform("found", lambda x, i: F.struct((x["type"] != "win").alias("w"), (-x["score"]).alias("n"), i.alias("at"), x.alias("x"))))
    full = found.select("user_id", "ym", F.posexplode_outer(F.transform(order, lambda s: s["x"])).alias("rank", "i")).filter("i is not null").select("user_id", "ym", "rank", "i.*")
    return full.unionByName(partial_months(wide).withColumn("rank", F.lit(0)))
