"""Explicit schemas and the category dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY_TYPE = T.DecimalType(18, 2)

LEDGER = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("transaction_date", T.DateType()),
        T.StructField("amount", MONEY_TYPE),
        T.StructField("description", T.StringType()),
        T.StructField("bank_source", T.StringType()),
        T.StructField("account_name", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("ext_id", T.StringType()),
        T.StructField("is_pending", T.BooleanType()),
        T.StructField("is_fixed", T.BooleanType()),
        T.StructField("needs_review", T.BooleanType()),
        T.StructField("exclusion_reason", T.StringType()),
        T.StructField("project_id", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
    ]
)

MERCHANT_RULES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("match_field", T.StringType()),
        T.StructField("match_value", T.StringType()),
        T.StructField("match_type", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("confidence_override", T.DoubleType()),
        T.StructField("is_active", T.BooleanType()),
    ]
)

# The default categories in display order with their group.
DEFAULT_CATEGORIES = [
    ("Food & Dining", "expense"), ("Groceries", "expense"), ("Transport", "expense"), ("Bills & Utilities", "expense"),
    ("Subscriptions", "expense"), ("Health", "expense"), ("Shopping", "expense"), ("Entertainment", "expense"),
    ("Travel", "expense"), ("Personal Care", "expense"), ("Pets", "expense"), ("Education", "expense"),
    ("Baby & Kids", "expense"), ("Bank Fees", "expense"), ("Cash & ATM", "expense"), ("Gifts & Donations", "expense"),
    ("Government & Taxes", "expense"), ("Home Improvement", "expense"), ("Insurance", "expense"),
    ("Professional Services", "expense"), ("Salary", "income"), ("Transfer", "transfer"),
    ("Credit Card Payment", "transfer"), ("Card Credit", "transfer"), ("Loan Payment", "debt"), ("Refund", "refund"),
    ("Other", "expense"),
]


def category_dimension(spark: SparkSession) -> DataFrame:
    """The seeded category table: (category_id, category_name, category_group, display_order, is_active)."""
    rows = [(i, n, g, i, True) for i, (n, g) in enumerate(DEFAULT_CATEGORIES)]
    return spark.createDataFrame(
        rows, "category_id long, category_name string, category_group string, display_order long, is_active boolean"
    )
