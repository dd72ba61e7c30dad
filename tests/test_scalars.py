"""Literal rows for the scalar expressions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook import columns as C
from tallybook.functions import fingerprints as fp
from tallybook.functions import merchants as mt
from tallybook.functions import parsing as ps


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,want",
    [("SQ *BIRYANI BISTRO", "biryani bistro"), ("firestone28258", "firestone"), ("NETFLIX.COM 866-579-7172 CA", "netflix.com 866-579-"), (None, "")],
)
def test_clean_description(spark, text, want):
    assert one(spark, text, mt.clean_description) == want


@pytest.mark.parametrize(
    "text,want",
    [("AMZN MKTP US*2K4", "amazon"), ("POS PURCHASE blue widget 12345", "blue widget"), ("SQ *CORNER SHOP", "corner shop"), ("", "")],
)
def test_merchant_stem(spark, text, want):
    assert one(spark, text, mt.merchant_stem) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("LAKEVIEW LN SRV DES:MTG PYMT ID:1 INDN:X CO ID:2 WEB", "Lakeview Ln Srv"),
        ("KUSHKLUB - S-7 WITHDRWL KUSHKLUB - S-7690 TUKWILA", "Kushklub"),
        ("Trader Joe s #123", "Trader Joe's"),
        ("OAK RIDGE HOA DUES", "HOA Payment"),
    ],
)
def test_display_merchant(spark, text, want):
    assert one(spark, text, mt.display_merchant) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("03/15/2024", "2024-03-15"), ("3/5/24", "2024-03-05"), ("01/02/95", "1995-01-02"), ("2024-03-15", "2024-03-15"), ("03-15-2024", "2024-03-15"),
        ("March 15, 2024", "2024-03-15"), ("15 Mar 2024", "2024-03-15"), ("03/2024", "2024-03-01"), ("2024-03", "2024-03-01"), ("20240315", "2024-03-15"),
        ("02/30/2024", None), ("n/a", None), ("", None),
    ],
)
def test_parse_date(spark, text, want):
    got = one(spark, text, ps.parse_date)
    assert got == (dt.date.fromisoformat(want) if want else None)


@pytest.mark.parametrize("text,want", [("$1,234.56", "1234.56"), ("(45.00)", "-45.00"), ("+3", "3.00"), ("", "0.00"), ("abc", "0.00")])
def test_lenient_amount(spark, text, want):
    assert one(spark, text, ps.parse_amount_or_zero) == Decimal(want)


def test_amount_is_null_when_unreadable(spark):
    assert one(spark, "abc", ps.parse_amount) is None


def test_mask_accounts(spark):
    text = "card 4111 1111 1111 1111 ref 123456789012 xxxx4321 call 555-123-4567"
    assert one(spark, text, ps.mask_accounts) == "card ****1111 ref ****9012 ****4321 call 555-123-4567"


def test_sign_is_normalized_once_for_every_spelling(spark):
    rows = spark.createDataFrame([("Citi",), ("Citibank",), ("Barclays",), ("Chase",)], "bank string").withColumn("amount", F.lit(10))
    got = [r["a"] for r in rows.select(ps.normalize_sign("amount", "bank").alias("a")).collect()]
    assert got == [-10, -10, -10, 10]


def test_rounding_is_exact_half_even(spark):
    df = spark.createDataFrame([(25, 10), (35, 10), (-25, 10), (5, 0)], "n long, d long")
    assert [r[0] for r in df.select(C.round_ratio("n", "d")).collect()] == [2, 4, -2, None]


def test_missing_amount_is_not_zero_in_the_fingerprint(spark):
    df = spark.createDataFrame([(None,), (Decimal("0.00"),)], "amount decimal(18,2)")
    f = fp.fingerprint(F.lit("b"), F.lit("a"), F.lit("2024-01-01").cast("date"), "amount", F.lit("shop"), F.lit(""))
    a, b = [r[0] for r in df.select(f).collect()]
    assert a != b


def test_title_case_after_punctuation(spark):
    assert one(spark, "netflix.com o'neil", C.title_case) == "Netflix.Com O'Neil"
