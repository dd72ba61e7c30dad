"""Delimited statements, toll exports, sheet exports and extracted table rows.

The column layout is found per file as data (an array of roles from the header line), so any number of layouts is parsed
in one pass without a driver-side plan per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.columns import contains_any, first_match, staged
from tallybook.functions import fixed_values as v
from tallybook.functions import parsing as p
from tallybook.sources.sinks import stored

# Header words of each column role, in the order they are tried.
ROLE_WORDS = [
    ("date", ["date", "posted"]), ("description", ["description", "narration", "details", "merchant", "payee", "memo", "name", "transaction"]),
    ("debit", ["debit", "withdrawal", "charge", "payment"]), ("credit", ["credit", "deposit"]), ("amount", ["amount", "amt"]),
    ("raw_category", ["category", "cat", "type"]), ("status", ["status", "pending"]),
]
# A quoted field up to the next comma, else everything before it; each cell is read once.
CELL = r',(\s*"(?:[^"]++|"")*+"\s*(?=,|$)|[^,]*+)'
# Issuer words stand above the header; a file whose header comes early is read at least this far.
ISSUER_LINES, ISSUER_ROWS = 40, 8


def cells(line: Column | str) -> Column:
    """Fields of one CSV line; quotes are removed, doubled quotes kept as one."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), F.col(line) if isinstance(line, str) else line), F.lit(CELL), F.lit(1))
    return F.transform(parts, lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))


def is_header(line: Column) -> Column:
    low = F.lower(line)
    return low.contains("date") & contains_any(low, ["amount", "amt", "description", "payee", "memo"]) & ~low.contains("summary")


def header_roles(line: Column) -> Column:
    """Role of each header cell; the first cell of a role wins when looked up by position."""
    return F.transform(cells(line), lambda c: first_match([(contains_any(F.lower(c), words), role) for role, words in ROLE_WORDS], ""))


def headers(lines: DataFrame) -> DataFrame:
    """(path, header_no, roles): the first transaction header of the file, else line 0."""
    found = F.min(F.when(is_header(F.col("line")), F.struct("line_no", "line")))
    first = F.min(F.struct("line_no", "line"))
    h = lines.groupBy("path").agg(F.coalesce(found, first).alias("h"))
    return h.select("path", F.col("h.line_no").alias("header_no"), header_roles(F.col("h.line")).alias("roles"))


def _cell(role: str) -> Column:
    at = F.array_position("roles", role)
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def parse_delimited(lines: DataFrame, issuers: DataFrame | None = None, source: str = "csv") -> DataFrame:
    """Statement lines to raw rows; undated, blank, balance and zero rows are dropped.

    `issuers` is (path, issuer); without it the file name and the lines up to the header decide. What is known of each file is
    written first, so that Spark knows its size and moves it to the lines where it is small. Lines are read three times.
    """
    h = stored(headers(lines), "headers")
    if issuers is None:
        name = F.element_at(F.split("path", "/"), -1)
        above = lines.join(h.select("path", "header_no"), "path").filter(F.col("line_no") <= F.greatest("header_no", F.lit(ISSUER_LINES - 1)))
        top = above.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("head"))
        issuers = top.select("path", p.detect_issuer(name, "head", "head", whole=True).alias("issuer"))
    files = stored(h.join(issuers, "path"), "delimited-files")
    rows = lines.join(files, "path").filter("line_no > header_no and trim(line) <> ''")
    rows = staged(rows, cells=cells("line"))
    blank = lambda c: F.when(F.lower(F.trim(c)).isin("", "nan", "none"), None).otherwise(F.trim(c))
    split = F.exists("roles", lambda r: r.isin("debit", "credit"))
    rows = staged(
        rows.select("path", "line_no", "issuer", "roles", "cells"), split=split, raw_date=_cell("date"), description=blank(_cell("description")),
        debit=p.parse_amount_or_zero(_cell("debit")), credit=p.parse_amount_or_zero(_cell("credit")), single=p.parse_amount_or_zero(_cell("amount")),
        raw_category=F.coalesce(blank(_cell("raw_category")), F.lit("")), is_pending=p.is_pending_status(_cell("status")))
    both = first_match([(F.col("debit") != 0, -F.abs("debit")), (F.col("credit") != 0, F.abs("credit"))])
    amount = F.when(F.col("split"), both).otherwise(p.normalize_sign("single", "issuer"))
    rows = staged(rows, amount=amount, transaction_date=p.parse_date("raw_date"))
    ok = F.col("transaction_date").isNotNull() & F.col("description").isNotNull() & ~p.is_non_transaction("description") & (F.coalesce("amount", F.lit(0)) != 0)
    return rows.filter(ok).select("path", "line_no", F.col("issuer").alias("bank_source"), "transaction_date", "raw_date", "description", "amount", "raw_category", "is_pending", F.lit(source).alias("source"))


def parse_toll(rows: DataFrame) -> DataFrame:
    """Toll-account rows (text columns of the export): TOLL rows only, amount sign as printed."""
    at = F.trim("exit_time")
    day = F.coalesce(
        F.to_date(F.try_to_timestamp(F.substring(at, 1, 19), F.lit("MM/dd/yyyy HH:mm:ss"))), F.to_date(F.try_to_timestamp(at, F.lit("MM/dd/yyyy"))), F.to_date(F.try_to_timestamp(at, F.lit("yyyy-MM-dd"))))
    place = F.coalesce(F.nullif(F.nullif(F.trim("location"), F.lit("")), F.lit("nan")), F.lit("Toll"))
    out = rows.filter(F.upper(F.trim("transaction_type")) == "TOLL").select("path", day.alias("transaction_date"), F.concat(F.lit("Toll - "), place).alias("description"), p.parse_amount("amount").alias("amount"), F.trim("transaction_id").alias("ext_id"))
    return out.filter("transaction_date is not null and amount is not null")


def sheet_roles(header: Column) -> Column:
    """field -> position by alias: a field takes the first header that equals or contains one of its aliases."""
    low = F.transform(header, lambda h: F.lower(F.trim(h)))
    pairs = []
    for field, aliases in v.COLUMN_ALIASES.items():
        at = F.filter(F.sequence(F.lit(0), F.size(low) - 1), _holds(low, aliases))
        pairs += [F.lit(field), F.get(at, F.lit(0))]
    return F.create_map(*pairs)


def _holds(low: Column, aliases: list[str]):
    return lambda i: contains_any(F.get(low, i), aliases)


def parse_sheet(rows: DataFrame) -> DataFrame:
    """Sheet export rows (path, row_no, cells): the sheet's first header row, issuer from the rows up to it."""
    head_words = ["date", "description", "amount", "debit"]
    joined = F.lower(F.array_join("cells", " "))
    found = rows.groupBy("path").agg(F.min(F.when(contains_any(joined, head_words), F.struct("row_no", "cells"))).alias("h")).filter("h is not null")
    h = found.select("path", F.col("h.row_no").alias("header_no"), sheet_roles(F.col("h.cells")).alias("role"))
    above = rows.join(h.select("path", "header_no"), "path").filter(F.col("row_no") <= F.greatest("header_no", F.lit(ISSUER_ROWS - 1)))
    sniffed = above.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", joined.alias("t")))), lambda s: s["t"]), " ").alias("sniff"))
    h = h.join(sniffed.select("path", p.issuer_from_sheet("sniff").alias("issuer")), "path")
    r = rows.join(h, "path").filter("row_no > header_no")
    cell = lambda f: F.get("cells", F.try_element_at("role", F.lit(f)))
    has = lambda f: F.try_element_at("role", F.lit(f)).isNotNull()
    shape = r"^\d{1,2}/\d{1,2}/(\d{4}|\d{2})$|^\d{4}-\d{1,2}-\d{1,2}$"
    raw = F.trim(cell("date"))
    swapped = F.regexp_replace(raw, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$2/$1/$3")
    day = F.when(raw.rlike(shape), F.coalesce(p.parse_date(raw), p.parse_date(swapped)))
    single = p.parse_amount(cell("amount"))
    flip = F.lower(F.coalesce("issuer", F.lit(""))).rlike("discover|amex|american express")
    debit, credit = p.parse_amount(cell("debit")), p.parse_amount(cell("credit"))
    two = first_match([(debit != 0, -F.abs(debit)), (credit != 0, F.abs(credit))])
    amount = F.when(has("amount"), F.when(flip, -single).otherwise(single)).when(has("debit") & has("credit"), two)
    desc = F.nullif(F.nullif(F.trim(cell("description")), F.lit("")), F.lit("nan"))
    r = staged(r.select("path", "row_no", "issuer", "role", "cells"), transaction_date=day, description=desc, amount=amount)
    out = r.select("path", "row_no", F.coalesce("issuer", F.lit("Unknown Bank")).alias("bank_source"), "transaction_date", "description", "amount")
    return out.filter("transaction_date is not null and description is not null and coalesce(amount, 0) <> 0")


def cell_roles(rows: DataFrame) -> DataFrame:
    """Extracted table rows (path, row_no, cells): first date-like cell, last amount-like cell, longest text."""
    cs = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != "")
    looks_date, looks_money = r"^\d{1,2}[/\-]\d{1,2}[/\-]?\d{0,4}", r"^-?\$?[\d,]+\.\d{2}$"
    date = F.get(F.filter(cs, lambda c: c.rlike(looks_date)), F.lit(0))
    rest = F.filter(cs, lambda c: ~(c.rlike(looks_date)))
    amounts = F.filter(rest, lambda c: F.regexp_replace(c, ",", "").rlike(looks_money))
    words = F.filter(rest, lambda c: ~F.regexp_replace(c, ",", "").rlike(looks_money) & (F.length(c) > 3) & ~c.rlike(r"^[\d\s\$\.\,\-]+$"))
    longest = F.array_sort(F.transform(words, lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("c"))))
    out = rows.filter(F.size("cells") >= 3).select("path", "row_no", p.parse_date(date).alias("transaction_date"), F.get(longest, F.lit(0))["c"].alias("description"), p.parse_amount(F.try_element_at(amounts, F.lit(-1))).alias("amount"))
    return out.filter("transaction_date is not null and description is not null and coalesce(amount, 0) <> 0")
