"""Card credits: classification, matching to expenses, and credit cover of merchants.

"Text contains key" is an equi join on fixed-length substrings, with one best candidate kept per substring before the
join, so the work grows with the text and never with the number of matching pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.columns import cents, col, first_match, money, month_key, top_per_group
from tallybook.functions import fixed_values as v
from tallybook.functions.merchants import credit_hint
from tallybook.operators.periods import is_spend, spend, with_period
from tallybook.sources.sinks import stored


def classify_credit(description: Column | str) -> Column:
    """struct(credit_type, eligible, target_category, target_bucket, program, confidence)."""
    low = F.trim(F.lower(F.coalesce(col(description), F.lit(""))))

    def made(kind, eligible, category=None, bucket=None, program=None, confidence="low"):
        s = lambda x: F.lit(x).cast("string")
        return F.struct(
            s(kind).alias("credit_type"), F.lit(eligible).alias("eligible"), s(category).alias("target_category"),
            s(bucket).alias("target_bucket"), s(program).alias("program"), s(confidence).alias("confidence"))

    cases = [(low.rlike(v.CREDIT_INELIGIBLE_PATTERN), made("cashback", False))]
    for key, (category, bucket, confidence) in v.CREDIT_PROGRAMS.items():
        kind = "subscription" if bucket == "committed" else "purchase"
        cases.append((low.contains(key), made(kind, True, category, bucket, key, confidence)))
    for pattern, kind, category, bucket in v.CREDIT_TYPE_PATTERNS:
        cases.append((low.rlike(pattern), made(kind, kind != "cashback", category, bucket, None, "medium")))
    return first_match(cases, made("unknown", True))


def _pieces(text: Column, sizes) -> Column:
    """Distinct substrings of the given lengths."""
    n = F.length(text)

    def of(k):
        cut = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
        return F.when(n >= k, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of(k) for k in sizes])))


def matchable_expenses(ledger: DataFrame) -> DataFrame:
    return with_period(spend(ledger)).select("user_id", "ym", "transaction_id", "description", "category", "spent", "seq")


def distinct_credits(ledger: DataFrame) -> DataFrame:
    """Card credits, one per user, month, amount and 30-character text, with their class and merchant hint."""
    rows = ledger.filter("transaction_type = 'card_credit'").withColumns({"ym": month_key(), "credit": cents(), "_text": F.lower(F.substring(F.coalesce("description", F.lit("")), 1, 30))})
    first = top_per_group(rows, ["user_id", "ym", "credit", "_text"], [F.col("seq")], 1)
    first = first.withColumns({"k": classify_credit("description"), "hint": F.trim(F.substring(credit_hint("description"), 1, 8))})
    return first.select("user_id", "ym", "credit", F.col("transaction_id").alias("credit_id"), F.col("description").alias("credit_text"), "hint", "k.*")


def _by_merchant(credits: DataFrame, expenses: DataFrame) -> DataFrame:
    """First expense of the month whose text contains the hint."""
    hints = credits.filter("eligible and hint is not null and hint <> ''").select("user_id", "ym", "hint").distinct()
    active = expenses.join(hints.select("user_id", "ym").distinct(), ["user_id", "ym"], "left_semi")
    texts = active.groupBy("user_id", "ym", F.lower(F.coalesce("description", F.lit(""))).alias("text")).agg(
        F.min_by(F.struct("seq", "transaction_id", "spent", "category"), F.col("seq")).alias("e"))
    pieces = texts.withColumn("hint", F.explode(_pieces(F.col("text"), range(1, 9)))).groupBy("user_id", "ym", "hint").agg(F.min("e").alias("e"))
    return hints.join(pieces, ["user_id", "ym", "hint"])


def _by_amount(credits: DataFrame, expenses: DataFrame) -> DataFrame:
    """Nearest expense amount within month and category: distinct amounts of both sides in one sorted pass per direction."""
    keys = ["user_id", "ym", "category"]
    have = expenses.groupBy(*keys, F.col("spent").alias("value")).agg(F.min(F.struct("seq", "transaction_id", "spent")).alias("e"))
    want = credits.filter("eligible and target_category is not null").select("user_id", "ym", F.col("target_category").alias("category"), F.col("credit").alias("value")).distinct()
    both = have.unionByName(want.withColumn("e", F.lit(None).cast(have.schema["e"].dataType)))
    below = Window.partitionBy(*keys).orderBy("value", F.col("e").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*keys).orderBy(F.desc("value"), F.col("e").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("lo", F.last("e", ignorenulls=True).over(below)).withColumn("hi", F.last("e", ignorenulls=True).over(above))
    rank = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.spent") - F.col("value")).alias("d"), F.col(f"{c}.seq").alias("s")))
    pick = F.when(rank("hi").isNull() | (rank("lo") <= rank("hi")), F.col("lo")).otherwise(F.col("hi"))
    return near.filter("e is null").select(*keys, F.col("value").alias("credit"), pick.alias("near")).filter("near is not null")


def match_credits(ledger: DataFrame) -> DataFrame:
    """Every distinct credit with its matched expense, applied and unapplied amount, method and confidence."""
    credits, expenses = distinct_credits(ledger), matchable_expenses(ledger)
    by_name = _by_merchant(credits, expenses)
    by_amount = _by_amount(credits, expenses).withColumnRenamed("category", "target_category")
    m = credits.join(by_name, ["user_id", "ym", "hint"], "left").join(by_amount, ["user_id", "ym", "target_category", "credit"], "left")
    named, near = F.col("eligible") & F.col("e").isNotNull(), F.col("eligible") & F.col("near").isNotNull()
    high = F.col("confidence") == "high"
    method = first_match([(~F.col("eligible"), "ineligible"), (named, "exact_merchant"), (near & high, "program_mapping"), (near, "category_window")], "unmatched")
    conf = first_match([(named, "high"), (near & high, "high"), (near, "medium")], "none")
    spent = first_match([(named, F.col("e.spent")), (near, F.col("near.spent"))])
    applied = F.when(spent.isNotNull(), F.least(F.col("credit"), spent)).otherwise(F.lit(0).cast("long"))
    return m.withColumn("applied", applied).select(
        "user_id", F.col("ym").alias("statement_period"), "credit_id", "credit_text", money("credit").alias("credit_amount"),
        first_match([(named, F.col("e.transaction_id")), (near, F.col("near.transaction_id"))]).alias("expense_id"),
        F.when(F.col("eligible"), F.coalesce("target_category", F.when(named, F.col("e.category")))).alias("matched_category"),
        "credit_type", "eligible", money("applied").alias("applied_amount"), money(F.col("credit") - F.col("applied")).alias("unapplied_amount"),
        conf.alias("match_confidence"), method.alias("match_method"))


def offset_totals(offsets: DataFrame) -> DataFrame:
    """Applied (eligible only) and unapplied totals per user and period."""
    return offsets.groupBy("user_id", "statement_period").agg(
        F.count(F.lit(1)).alias("n_offsets"), F.coalesce(F.sum(F.when(F.col("eligible"), F.col("applied_amount"))), F.lit(0)).alias("total_applied"),
        F.sum(F.coalesce("unapplied_amount", F.lit(0))).alias("total_unapplied"))


def offset_listing(offsets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Offsets with their credit row; order the page that is shown (`periods.page`), not the listing."""
    rows = ledger.select(F.col("transaction_id").alias("credit_id"), "user_id", "description", F.col("amount").alias("ledger_amount"))
    return offsets.join(rows, ["user_id", "credit_id"])


def net_category_spend(ledger: DataFrame, offsets: DataFrame) -> DataFrame:
    """Gross, credited and net spend per user, month and category."""
    gross = with_period(spend(ledger)).groupBy("user_id", "ym", F.coalesce("category", F.lit("Other")).alias("category")).agg(F.sum("spent").alias("gross"))
    credit = offsets.filter("applied_amount > 0 and matched_category is not null").groupBy("user_id", F.col("statement_period").alias("ym"), F.col("matched_category").alias("category")).agg(F.sum(cents("applied_amount")).alias("credit"))
    n = gross.join(credit, ["user_id", "ym", "category"], "left").withColumn("credit", F.coalesce("credit", F.lit(0).cast("long")))
    return n.select("user_id", "ym", "category", money("gross").alias("gross_spend"), money("credit").alias("credit_applied"), money(F.greatest(F.lit(0).cast("long"), F.col("gross") - F.col("credit"))).alias("net_spend"))


# ------------------------------------------------------------------ cover by merchant text


def _credit_key() -> Column:
    """Merchant key of a card credit whose text names one, else NULL."""
    named = (F.col("transaction_type") == "card_credit") & F.col("description").rlike(r"-\s*(.+)")
    return F.when(named, F.lower(F.substring(F.trim(F.regexp_extract("description", r"-\s*(.+)", 1)), 1, 10)))


def credit_map(ledger: DataFrame) -> DataFrame:
    """Summed credits per user and 10-character merchant key, with the first row's order."""
    named = ledger.withColumn("credit_key", _credit_key()).filter("credit_key is not null")
    return named.groupBy("user_id", "credit_key").agg(F.sum(cents()).alias("credit"), F.min("seq").alias("first_seq"))


def cover_by_text(names: DataFrame, credits: DataFrame) -> DataFrame:
    """First credit whose key head lies in a merchant key, or whose key contains the merchant's head.

    `names` is distinct (user_id, merchant_key of at most ten characters).
    """
    best = F.min(F.struct("first_seq", "credit_key", "credit")).alias("best")
    heads = credits.groupBy("user_id", F.substring("credit_key", 1, 6).alias("piece")).agg(best).withColumn("side", F.lit("in"))
    bodies = credits.withColumn("piece", F.explode(F.concat(F.array(F.lit("")), _pieces(F.col("credit_key"), range(1, 7))))).groupBy("user_id", "piece").agg(best).withColumn("side", F.lit("has"))
    inside = F.transform(F.concat(F.array(F.lit("")), _pieces(F.col("merchant_key"), range(1, 7))), lambda x: F.struct(x.alias("piece"), F.lit("in").alias("side")))
    head = F.array(F.struct(F.substring("merchant_key", 1, 6).alias("piece"), F.lit("has").alias("side")))
    probes = names.withColumn("p", F.explode(F.concat(inside, head))).select("user_id", "merchant_key", "p.piece", "p.side")
    hit = probes.join(heads.unionByName(bodies), ["user_id", "piece", "side"])
    return hit.groupBy("user_id", "merchant_key").agg(F.min("best").alias("b")).select("user_id", "merchant_key", F.col("b.credit_key").alias("credit_key"), F.col("b.credit").alias("credit"))


def covered_expenses(ledger: DataFrame) -> DataFrame:
    """Expense rows with the merchant credit that covers them and the net amount."""
    rows = with_period(spend(ledger, include_excluded=True)).withColumn("merchant_key", F.lower(F.substring(F.coalesce("description", F.lit("")), 1, 10)))
    cover = cover_by_text(rows.select("user_id", "merchant_key").distinct(), credit_map(ledger))
    hit = rows.join(cover, ["user_id", "merchant_key"]).withColumn("applied", F.least("credit", "spent")).filter("applied > 0")
    return hit.select("user_id", "transaction_id", "credit_key", money("applied").alias("credit_applied"), money(F.col("spent") - F.col("applied")).alias("net_amount"))


def fully_covered(ledger: DataFrame, credits: DataFrame | None = None) -> DataFrame:
    """Live expenses that a credit of the batch pays in full: the first one naming the credit's merchant, if net <= 0.

    Each merchant key is checked once per batch against the ledger as it stood before; the next batch sees the result.
    """
    credits = ledger.filter("transaction_type = 'card_credit'") if credits is None else credits
    named = credits.filter(F.col("description").rlike(r"-\s*(.+)"))
    key = F.trim(F.lower(F.substring(F.trim(F.regexp_extract("description", r"-\s*(.+)", 1)), 1, 10)))
    keys = named.groupBy("user_id", key.alias("piece")).agg(F.max(cents()).alias("credit")).filter("piece <> ''")
    live = with_period(spend(ledger)).join(keys.select("user_id").distinct(), "user_id", "left_semi")
    texts = live.groupBy("user_id", F.lower(F.coalesce("description", F.lit(""))).alias("text")).agg(F.min(F.struct("seq", "transaction_id", "spent")).alias("e"))
    pieces = texts.withColumn("piece", F.explode(_pieces(F.col("text"), range(1, 11)))).groupBy("user_id", "piece").agg(F.min("e").alias("e"))
    hit = keys.join(pieces, ["user_id", "piece"]).filter(F.col("e.spent") <= F.col("credit"))
    return hit.select("user_id", F.col("e.transaction_id").alias("transaction_id")).distinct()


def exclude_covered(ledger: DataFrame) -> DataFrame:
    """The ledger with fully covered expenses retyped to excluded."""
    done = fully_covered(ledger).withColumn("_covered", F.lit(True))
    rows = ledger.join(done, ["user_id", "transaction_id"], "left")
    hit = F.col("_covered").isNotNull()
    return rows.withColumns({
        "transaction_type": F.when(hit, "excluded").otherwise(F.col("transaction_type")),
        "exclusion_reason": F.when(hit, "credit_covered").otherwise(F.col("exclusion_reason"))}).drop("_covered")


def fixed_with_cover(ledger: DataFrame, manual: DataFrame, by_month: bool = False, credits_of: str = "all") -> DataFrame:
    """Fixed items net of merchant credits, with credit-covered rows and the user's manual items appended.

    With `by_month` every dated month of a user is a period of its own, each with the manual items. `credits_of` says which
    credits pay an item: "all" of the user, whatever the period, or only those of the same "month".
    """
    from tallybook.operators.recurrence import grouped_spellings, spelling, spelling_sums

    if credits_of not in ("all", "month") or (credits_of == "month" and not by_month):
        raise ValueError("credits_of is 'all', or 'month' together with by_month")
    # One read of the ledger for items and credits: sums per user, month, spelling of an item and key of a credit, written once.
    fixed = F.col("is_fixed") & ((is_spend() & F.col("exclusion_reason").isNull()) | (F.col("exclusion_reason") == "credit_covered"))
    month = month_key() if by_month else F.lit(None).cast("string")
    rows = ledger.filter(fixed | _credit_key().isNotNull()).select("user_id", month.alias("ym"), F.when(fixed, spelling()).alias("raw"), _credit_key().alias("credit_key"), F.abs(cents()).alias("spent"), cents().alias("credit"), "seq")
    sums = stored(rows.groupBy("user_id", "ym", "raw", "credit_key").agg(*spelling_sums(), F.sum("credit").alias("credit"), F.min("seq").alias("first_seq")), "fixed-sums")
    dated, owner = sums, F.col("user_id")
    if by_month:
        dated = sums.filter("ym is not null")
        months = ledger.filter("transaction_date is not null").select("user_id", month.alias("ym")).distinct()
        manual = manual.join(months, "user_id").withColumn("user_id", F.struct("user_id", "ym"))
        dated = dated.withColumn("user_id", F.struct("user_id", "ym"))
        owner = owner if credits_of == "month" else F.col("user_id.user_id")
    items = grouped_spellings(dated.filter("raw is not null")).withColumns({"merchant_key": F.lower(F.substring("merchant", 1, 10)), "owner": owner})
    credits = (dated if credits_of == "month" else sums).filter("credit_key is not null")
    credits = credits.groupBy("user_id", "credit_key").agg(F.sum("credit").alias("credit"), F.min("first_seq").alias("first_seq"))
    cover = cover_by_text(items.select(F.col("owner").alias("user_id"), "merchant_key").distinct(), credits)
    cover = cover.withColumnRenamed("user_id", "owner")
    items = items.join(cover, ["owner", "merchant_key"], "left").withColumn("covered", F.least(F.coalesce("credit", F.lit(0).cast("long")), F.col("total")))
    auto = items.select("user_id", "merchant", "total", "varies", "occurrences", F.lit(False).alias("manual"), "covered")
    own = manual.select("user_id", F.col("name").alias("merchant"), F.col("amount_cents").alias("total"), F.lit(False).alias("varies"), F.lit(1).cast("long").alias("occurrences"), F.lit(True).alias("manual"), F.lit(0).cast("long").alias("covered"))
    out = auto.unionByName(own).select("user_id", "merchant", money("total").alias("amount"), "varies", "occurrences", "manual", money("covered").alias("credit_covered"), money(F.col("total") - F.col("covered")).alias("net_amount"))
    return out.select("user_id.*", *[c for c in out.columns if c != "user_id"]) if by_month else out


def fixed_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("user_id").agg(
        F.sum("amount").alias("total"), F.sum("credit_covered").alias("credit_covered_total"), F.sum("net_amount").alias("net_fixed_total"), F.count(F.lit(1)).alias("n_items"))
