"""Cheap yes/no and label expressions over one ledger row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.columns import any_of, col, contains_any, first_match
from tallybook.functions import fixed_values as v

# Card issuers, housing words and auto-excluded payments as the client knows them.
CARD_SOURCE_WORDS = [
    "amex", "american express", "sapphire", "freedom", "venture", "quicksilver", "double cash", "discover", "citi",
    "synchrony", "barclays",
]
HOUSING_WORDS = ["rent", "mortgage", "car payment", "auto loan", "hoa"]
AUTO_EXCLUDED_TYPES = ["credit_card_payment", "loan_payment"]
AUTO_EXCLUDED_WORDS = ["payment thank you", "autopay payment", "online payment", "minimum payment"]
NON_SPENDING_TYPES = ["income", "transfer", "credit_card_payment", "card_credit", "refund", "excluded", "reimbursement", "cash"]


def is_recurring_hint(category: Column | str) -> Column:
    return col(category).isin(v.RECURRING_HINT_CATEGORIES)


def is_outside_spending(transaction_type: Column | str) -> Column:
    return col(transaction_type).isin(NON_SPENDING_TYPES)


def category_signal(category: Column | str) -> Column:
    """struct(label, confidence in hundredths): fixed list first, then semi-fixed, then variable."""
    cat = F.lower(F.trim(F.coalesce(col(category), F.lit(""))))
    sig = lambda label, conf: F.struct(F.lit(label).alias("label"), F.lit(conf).alias("conf"))
    return first_match(
        [
            (cat.isin(v.FIXED_CATEGORIES), sig("fixed", 85)),
            (cat.isin(v.SEMI_FIXED_CATEGORIES), sig("fixed", 75)),
            (cat.isin(v.VARIABLE_CATEGORIES), sig("variable", 85)),
        ],
        sig("unknown", 0),
    )


def is_keyword_fixed(description: Column | str) -> Column:
    text = F.lower(F.coalesce(col(description), F.lit("")))
    return any_of(text.rlike(p) for p in v.KEYWORD_FIXED_PATTERNS)


def is_hard_fixed(category: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col(category), F.lit("")))).isin(v.HARD_FIXED_CATEGORIES)


def is_subscription(category: Column | str, description: Column | str, words=v.SUBSCRIPTION_KEYWORDS) -> Column:
    cat = F.lower(F.coalesce(col(category), F.lit("")))
    text = F.lower(F.coalesce(col(description), F.lit("")))
    return cat.isin("subscription", "subscriptions", "streaming") | contains_any(text, words)


def is_auto_excluded(transaction_type: Column | str, description: Column | str) -> Column:
    text = F.lower(F.coalesce(col(description), F.lit("")))
    return col(transaction_type).isin(AUTO_EXCLUDED_TYPES) | contains_any(text, AUTO_EXCLUDED_WORDS)
