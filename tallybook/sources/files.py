"""Statement files: reading whole files and routing them by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.columns import col, first_match

# File signatures (hex) and extensions.
SIGNATURES = {"25504446": "pdf", "504B": "xlsx", "D0CF11E0A1B11AE1": "xls"}
EXTENSIONS = ["pdf", "csv", "xlsx", "xls", "ofx", "qfx"]


def statement_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of statement files, one row per file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


# The leading bytes that by default tell a delimited or OFX file.
FIRST_BYTES, MORE_BYTES = 200, 500


def file_type(content: Column | str, name: Column | str, whole: bool = False) -> Column:
    """pdf, xlsx, xls, csv or ofx by leading bytes; else the extension; else 'unknown'.

    With `whole` a separator or OFX mark counts wherever it is, also beyond the leading bytes.
    """
    body = col(content)
    head = F.hex(F.substring(body, 1, 8))
    text = lambda n: F.decode(body if whole else F.substring(body, 1, n), "ISO-8859-1")
    first, more = text(FIRST_BYTES), text(MORE_BYTES)
    ofx = first.contains("OFXHEADER") | more.contains("<OFX>")
    comma = (head.startswith("EFBBBF") | first.contains(",")) & (more.contains(",") | more.contains(";"))
    cases = [(head.startswith(sig), kind) for sig, kind in SIGNATURES.items()]
    cases += [(ofx, "ofx"), (comma, "csv")] if whole else [(comma, "csv"), (ofx, "ofx")]
    low = F.lower(col(name))
    cases += [(low.endswith("." + e), e) for e in EXTENSIONS]
    return first_match(cases, "unknown")


# Whole quoted fields, text between quotes, stray quotes.
QUOTED = r'((?<![^,\n])"(?:[^"]++|"")*+"(?![^,\n])|[^"]++|")'


def _unbroken(text: Column) -> Column:
    """Line breaks inside quoted fields become spaces; a stray quote opens nothing."""
    parts = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))
    flat = F.transform(parts, lambda x: F.when(x.startswith('"') & (F.length(x) > 1), F.regexp_replace(x, "\n", " ")).otherwise(x))
    return F.when(text.contains('"'), F.array_join(flat, "")).otherwise(text)


def text_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of text files; undecodable bytes fall back to Latin-1, quoted fields stay on one line."""
    utf8 = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")
    return files.select("path", F.posexplode(F.split(_unbroken(clean), "\n")).alias("line_no", "line"))
