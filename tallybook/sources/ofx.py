"""OFX/QFX statements as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.columns import MONEY, lookup, staged
from tallybook.functions import fixed_values as v
from tallybook.functions import parsing as p


# A tag and its value, up to the next tag or line end.
PAIR = r"<([A-Za-z0-9_.]+)>([^<\r\n]*)"


def _tag(text: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i)<{name}>([^<\r\n]*)", 1)), F.lit(""))


def _value(name: str) -> Column:
    """Value of the block's first tag of that name."""
    return F.nullif(F.trim(F.get("values", (F.array_position("names", name) - 1).cast("int"))), F.lit(""))


def parse_ofx(files: DataFrame) -> DataFrame:
    """(path, text) to transactions: issuer from the institution id, type hint, external id, issuer sign applied.

    Each block is read once, into its tags and values; fields are looked up in them.
    """
    org = _tag(F.col("text"), "ORG")
    issuer = F.coalesce(lookup(_tag(F.col("text"), "FID"), v.OFX_INSTITUTIONS), p.issuer_from_text(org), F.initcap(org), F.lit("Unknown Bank"))
    blocks = files.select("path", issuer.alias("bank_source"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1))).alias("position", "b"))
    pairs = lambda group: F.regexp_extract_all("b", F.lit(PAIR), F.lit(group))
    rows = staged(blocks, names=F.transform(pairs(1), F.upper), values=pairs(2))
    rows = staged(
        rows, day=F.to_date(F.try_to_timestamp(F.substring(_value("DTPOSTED"), 1, 8), F.lit("yyyyMMdd"))), amount=_value("TRNAMT").try_cast(MONEY),
        description=F.coalesce(_value("PAYEE"), _value("NAME"), _value("MEMO"), _value("FITID")), kind=F.lower(_value("TRNTYPE")), ext_id=F.coalesce(_value("FITID"), F.lit("")))
    rows = rows.filter(F.col("day").isNotNull() & F.col("description").isNotNull() & (F.coalesce("amount", F.lit(0)) != 0) & ~p.is_non_transaction("description"))
    return rows.select(
        "path", "position", "bank_source", F.col("day").alias("transaction_date"), "description", p.normalize_sign("amount", "bank_source").alias("amount"),
        F.coalesce(lookup(F.col("kind"), v.OFX_TYPES), F.lit("unknown")).alias("type_hint"), "ext_id")
