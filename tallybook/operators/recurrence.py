"""Fixed or variable: recurrence, amount and category signals, and the fixed/subscription summaries.

Signals are aggregates per user and merchant key joined back by equi keys; nothing rescans the ledger per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.columns import cents, first_match, money, month_index, month_key, round_ratio, sample_stddev, squares, title_case, tokens
from tallybook.functions import merchants as mt
from tallybook.functions import signals as sg
from tallybook.operators.periods import is_spend, spend


def _moments(prefix: str = "") -> list[Column]:
    c = F.col("spent")
    return [F.count(F.lit(1)).alias(f"{prefix}n"), F.sum(c).alias(f"{prefix}total"), squares(c).alias(f"{prefix}squares")]


def _merged() -> list[Column]:
    """Moments of finer groups added up."""
    return [F.sum(c).alias(c) for c in ("n", "total", "squares")]


def expenses(ledger: DataFrame) -> DataFrame:
    return ledger.filter(is_spend()).withColumns({"ym": month_key(), "spent": F.abs(cents())})


def keyed_expenses(ledger: DataFrame) -> DataFrame:
    return expenses(ledger).withColumn("key8", mt.key8("description"))


def _signal(label: str, conf: int) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(conf).alias("conf"))


def recurrence_signals(ledger: DataFrame) -> DataFrame:
    """Per user and merchant key: months present, all months, variation and the resulting label/confidence (hundredths)."""
    rows = expenses(ledger)
    months = rows.select("user_id", "ym").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("total_months"))
    # Descriptions combine before the merchant key is worked out, so that text work is per description and month.
    by_text = rows.groupBy("user_id", "description", "ym").agg(*_moments()).withColumn("key8", mt.key8("description"))
    by_month = by_text.filter("key8 <> ''").groupBy("user_id", "key8", "ym").agg(*_merged())
    per_key = by_month.groupBy("user_id", "key8").agg(
        F.count(F.lit(1)).alias("present"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        (F.max(month_index("ym")) - F.min(month_index("ym"))).alias("span"),
    )
    k = per_key.join(months, "user_id")
    mean = F.col("total") / F.col("n")
    k = k.withColumn("variation", F.when(F.col("n") < 2, F.lit(0.0)).when(F.col("total") > 0, sample_stddev(F.col("n"), F.col("total"), F.col("squares")) / mean).otherwise(F.lit(1.0)))
    steps = F.col("present") - 1
    gap = lambda lo, hi: (F.col("span") * 2 >= steps * lo) & (F.col("span") * 2 <= steps * hi)
    long_enough = F.col("total_months") >= 3
    often, usual = F.col("present") * 5 >= F.col("total_months") * 4, F.col("present") * 5 >= F.col("total_months") * 3
    single = (F.col("n") == 1) & (F.col("total") >= 20000) & (F.col("total") % 5000 == 0)
    sparse = (F.col("total_months") < 2) | (F.col("present") < 2)
    rec = first_match(
        [
            (sparse & single, _signal("fixed", 65)), (sparse, _signal("unknown", 0)),
            (long_enough & gap(5, 7), _signal("fixed", 80)), (long_enough & gap(11, 13), _signal("fixed", 75)),
            (long_enough & gap(22, 26), _signal("fixed", 75)), (often & (F.col("variation") < 0.05), _signal("fixed", 95)),
            (often & (F.col("variation") < 0.25), _signal("fixed", 80)), (usual, _signal("fixed", 65)),
        ],
        _signal("variable", 65),
    )
    return k.withColumn("rec", rec).select("user_id", "key8", "present", "total_months", "n", "variation", F.col("rec.label").alias("rec_label"), F.col("rec.conf").alias("rec_conf"))


def amount_profile(ledger: DataFrame) -> DataFrame:
    """Mean and sample deviation of each user's expense amounts, in cents."""
    m = expenses(ledger).groupBy("user_id").agg(*_moments("a_"))
    sd = sample_stddev(F.col("a_n"), F.col("a_total"), F.col("a_squares"))
    return m.select("user_id", "a_n", (F.col("a_total") / F.col("a_n")).alias("a_mean"), sd.alias("a_sd"))


def amount_signal() -> Column:
    c = F.col("spent")
    outlier = (F.col("a_n") >= 3) & (F.col("a_sd") > 0) & (c > F.col("a_mean") + F.col("a_sd") * 2.5)
    return first_match(
        [
            (c == 0, _signal("unknown", 0)), (F.coalesce(outlier, F.lit(False)), _signal("irregular", 80)),
            ((c >= 10000) & (c % 5000 == 0), _signal("fixed", 60)), ((c >= 5000) & (c % 2500 == 0), _signal("fixed", 55)),
        ],
        _signal("unknown", 0),
    )


def with_amount_signal(ledger: DataFrame) -> DataFrame:
    rows = expenses(ledger).join(amount_profile(ledger), "user_id")
    return rows.withColumn("amt", amount_signal())


def fixed_or_variable(ledger: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Label every expense fixed, variable or irregular with a confidence and the signal that decided.

    `confirmed` is (user_id, key8, is_fixed): a user's own decision per merchant key overrides everything.
    """
    rows = with_amount_signal(ledger).withColumn("key8", mt.key8("description"))
    rec = recurrence_signals(ledger).select("user_id", "key8", "rec_label", "rec_conf")
    rows = rows.join(rec, ["user_id", "key8"], "left")
    if confirmed is None:
        rows = rows.withColumn("decision", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(confirmed.select("user_id", "key8", F.col("is_fixed").alias("decision")), ["user_id", "key8"], "left")
    rows = rows.withColumns({"cat": sg.category_signal("category"), "rec_conf": F.coalesce("rec_conf", F.lit(0))})
    rec_fixed = (F.col("rec_conf") > 0) & (F.col("rec_label") == "fixed")
    cat_fixed = F.col("cat.label") == "fixed"
    by_category = F.when(cat_fixed & rec_fixed, F.col("cat.conf") / 100 * 0.6 + F.col("rec_conf") / 100 * 0.4).when(cat_fixed, F.col("cat.conf") / 100).otherwise(0.0)
    rec_part = F.when(rec_fixed, F.col("rec_conf") / 100 * 0.7).otherwise(0.0)
    amt_part = F.col("amt.conf") / 100 * 0.3
    has_rec, has_amt = F.col("rec_conf") > 0, F.col("amt.conf") > 0
    by_signal = first_match([(has_rec & has_amt, rec_part + amt_part), (has_rec, rec_part / 0.7), (has_amt, amt_part / 0.3)], 0.0)

    def out(score: Column, source: str | Column, label: str | Column | None = None, is_fixed: Column | None = None) -> Column:
        yes = score >= 0.75 if is_fixed is None else is_fixed
        named = F.when(yes, "fixed").otherwise("variable") if label is None else F.lit(label)
        src = F.lit(source) if isinstance(source, str) else source
        return F.struct(yes.alias("is_fixed"), F.bround(score, 2).alias("confidence"), src.alias("source"), named.alias("label"))

    verdict = first_match(
        [
            (F.col("decision").isNotNull(), out(F.lit(1.0), "user_confirmed", None, F.col("decision"))),
            (sg.is_keyword_fixed("description"), out(F.lit(0.95), "keyword_override")),
            (sg.is_hard_fixed("category"), out(F.lit(0.95), "category_override")),
            (F.col("amt.label") == "irregular", out(F.lit(0.8), "amount_pattern", "irregular", F.lit(False))),
            (F.col("cat.conf") >= 85, out(by_category, "category_rule")),
            (~has_rec & ~has_amt, out(F.lit(0.0), "none")),
        ],
        out(by_signal, F.when(has_rec, "recurrence").otherwise("amount_pattern")),
    )
    rows = rows.withColumn("f", verdict)
    return rows.select(
        "user_id", "transaction_id", "key8", F.col("f.is_fixed").alias("is_fixed"), F.col("f.confidence").alias("confidence"),
        F.col("f.source").alias("source"), F.col("f.label").alias("label"),
    )


def spelling_sums() -> list[Column]:
    return [*_moments(), F.max("seq").alias("seq")]


def _merged_spellings(by_raw: DataFrame) -> DataFrame:
    """Moments per user and dedup key with the shortest spelling (the latest among equals) from `spelling_sums` of finer groups."""
    by_raw = by_raw.groupBy("user_id", "raw").agg(*_merged(), F.max("seq").alias("seq")).withColumn("dk", mt.dedup_key("raw"))
    return by_raw.groupBy("user_id", "dk").agg(*_merged(), F.max_by("raw", F.struct(-F.length("raw"), F.col("seq"))).alias("raw"))


def _by_dedup_key(rows: DataFrame) -> DataFrame:
    """Moments per user and dedup key with the shortest spelling (the latest among equals); input carries raw, spent, seq.

    Equal spellings combine first, so the key is worked out once per user and spelling.
    """
    by_raw = rows.groupBy("user_id", "raw").agg(*spelling_sums()).withColumn("dk", mt.dedup_key("raw"))
    return by_raw.groupBy("user_id", "dk").agg(*_merged(), F.max_by("raw", F.struct(-F.length("raw"), F.col("seq"))).alias("raw"))


def spelling() -> Column:
    """What names a fixed item: its text, else its category."""
    return F.trim(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("category"), F.lit("")), F.lit("Other")))


def _shown_groups(g: DataFrame) -> DataFrame:
    sd = sample_stddev(F.col("n"), F.col("total"), F.col("squares"))
    varies = (F.col("n") > 1) & (F.col("total") > 0) & (sd / (F.col("total") / F.col("n")) > 0.05)
    return g.select("user_id", "dk", mt.group_display_name("raw").alias("merchant"), "total", round_ratio("total", "n").alias("avg"), F.coalesce(varies, F.lit(False)).alias("varies"), F.col("n").alias("occurrences"))


def fixed_groups(rows: DataFrame) -> DataFrame:
    """Fixed rows grouped by user and dedup key (cents)."""
    return _shown_groups(_by_dedup_key(rows.filter("is_fixed").withColumns({"raw": spelling(), "spent": F.abs(cents())})))


def grouped_spellings(by_raw: DataFrame) -> DataFrame:
    """`fixed_groups` from `spelling_sums` per user and spelling, or finer."""
    return _shown_groups(_merged_spellings(by_raw))


def fixed_summary(ledger: DataFrame) -> DataFrame:
    """Fixed expenses per merchant: period total, mean, whether the amount varies, occurrences."""
    g = fixed_groups(spend(ledger))
    return g.select("user_id", "dk", "merchant", money("total").alias("amount"), money("avg").alias("avg"), "varies", "occurrences")


def newly_recurring(ledger: DataFrame, period: str = "ym") -> DataFrame:
    """Fixed charges that a user's period holds exactly twice, for every period of the ledger."""
    scoped = fixed_summary(ledger.withColumn("user_id", F.struct("user_id", period))).filter("occurrences = 2")
    return scoped.select("user_id.*", *[c for c in scoped.columns if c != "user_id"])


def subscription_groups(rows: DataFrame) -> DataFrame:
    subs = rows.filter(sg.is_subscription("category", "description"))
    g = _by_dedup_key(subs.withColumns({"raw": F.trim(F.coalesce("description", F.lit(""))), "spent": F.abs(cents())}))
    name = F.array_join(F.slice(tokens(title_case("raw")), 1, 2), " ")
    return g.select("user_id", "dk", name.alias("name"), round_ratio("total", "n").alias("avg"))


def subscription_summary(ledger: DataFrame) -> DataFrame:
    """Mean charge per subscription with the user's count and monthly total."""
    g = subscription_groups(spend(ledger))
    totals = g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("avg").alias("sum"))
    return g.join(totals, "user_id").select("user_id", "dk", "name", money("avg").alias("amount"), F.col("n").alias("subscription_count"), money("sum").alias("total"))
