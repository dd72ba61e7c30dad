"""Statement pages as positioned words or text lines: rows, sections, years and issuer templates.

Inputs are words(doc_id, page, top, x0, text) or lines(doc_id, page, line_no, text). State that runs down a document is
carried page by page: the window inside a page plus one row per page, so a very long document is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tallybook.columns import contains_any, first_match, squash, staged
from tallybook.functions import parsing as p
from tallybook.sources.sinks import stored

# Column ranges, line shapes, section markers and skip words of the issuer templates.
AMEX_COLUMNS = {"date": (45, 95), "description": (95, 290), "amount": (480, 560)}
BOFA_COLUMNS = {"date": (30, 88), "description": (88, 520), "amount": (520, 580)}
FULL_DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
CHASE_LINE = r"^(\d{2})/(\d{2})\s+(.*?)\s*(-?[\d,]+\.\d{2})$"
WELLS_CREDIT_LINE = r"^(\d{2})/(\d{2})\s+\d{2}/\d{2}\s+\d+\s+\S+\s+(.+?)\s+\$(-?[\d,]+\.\d{2})$"
MACYS_LINE = r"(?i)^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+(.+?)\s+(-?\$[\d,]+\.\d{2})$"
MONTH_YEAR = r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(20\d{2})\b"
PAYMENT_WORDS = ["payment thank you", "autopay", "online payment", "mobile payment", "payment received", "thank you"]
CHASE_SKIP = ["payment thank you", "autopay", "indian rupee", "exchg rate", "x 0.0"]
WELLS_CREDIT_SKIP = ["total fees", "total interest", "year-to-date", "biltprotect", "interest charge", "fees charged", "interest charged", "transaction summary"]
WELLS_BANK_SKIP = ["beginning balance", "ending balance", "ending daily", "date number", "deposits/additions", "withdrawals/subtractions", "transaction history", "check deposits", "summary of accounts", "statement period"]
MACYS_SKIP = ["bag fee", "sales tax", "receipt total", "other pay type", "total fees", "total interest", "year-to-date", "total card ending", "transaction date", "macy's transactions", "fees charged", "interest charged", "activity and", "promotion", "this page intentionally"]
DISCOVER_SKIP = ["previous balance", "total fees for this period", "total interest for this period", "redeemed this period", "earned this period", "fees and interest charged", "cashback bonus balance", "year-to-date", "interest charge calculation"]
DISCOVER_LABELS = ["services", "merchandise", "restaurants", "travel", "automotive", "cashback bonus", "% cashback"]
DISCOVER_CUTS = [r"\s+[A-Z]{2}$", r"\s+\d{3}-\d{3}-\d{4}.*$", r"\s+\d{6,}.*$", r"\s+\d{3,}\s*[A-Z]{2}$", r"\s+\+\$[\d.]+$"]
SHIFT = 29
#: How many times as many partitions as other moves that of the words of pages has, whose windows sort them whole: nothing is spilled.
FINER = 4


def _from_second(words):
    """All words but the first, however many."""
    return F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))


def decode_shifted(text: Column | str) -> Column:
    """Undo a font encoding that prints every character 29 code points too low."""
    src = "".join(chr(i) for i in range(1, 127))
    dst = "".join(chr(i + SHIFT) for i in range(1, 127))
    return F.translate(text, src, dst)


def join_split_amounts(text: Column | str) -> Column:
    """'$14 .13' -> '$14.13'."""
    return F.regexp_replace(text, r"(\S)\s+(\.\d{2})(?=\s|$)", "$1$2")


def carry_forward(df: DataFrame, doc: Sequence[str], page: str, order: Sequence[str], marker: str, out: str) -> DataFrame:
    """Last non-null marker at or above each row, in (page, order) within the document."""
    pages = df.groupBy(*doc, page).agg(F.max_by(F.col(marker), F.when(F.col(marker).isNotNull(), F.struct(*order))).alias("_last"))
    above = Window.partitionBy(*doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("_above", F.last("_last", ignorenulls=True).over(above)).drop("_last")
    here = Window.partitionBy(*doc, page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("_here", F.last(marker, ignorenulls=True).over(here)).join(pages, [*doc, page])
    return joined.withColumn(out, F.coalesce("_here", "_above")).drop("_here", "_above")


def _text_of(words: Column | str) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def _row_text(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("x0", "text")))
    rows = words.groupBy(*keys).agg(items.alias("words"))
    return rows.withColumn("text", _text_of("words"))


def rows_by_bucket(words: DataFrame, height: int) -> DataFrame:
    """Words of a page grouped by rounded height bands."""
    return _row_text(words.withColumn("row", (F.bround(F.col("top") / height) * height).cast("long")), ["doc_id", "page", "row"])


def rows_by_anchor(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words within `tolerance` of a row's first height form the row.

    A height more than `tolerance` above the one before always starts a row, so a row's first height is found by windows over the
    page's sorted words. Only heights that lie further than `tolerance` above the start of their unbroken run (rows printed
    closer than that) are folded, from that start on.
    """
    top, page = F.col("top"), Window.partitionBy("doc_id", "page")
    up = page.orderBy("top")
    tasks = FINER * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = words.filter("doc_id is not null and page is not null and top is not null").repartition(tasks, "doc_id", "page").withColumn("_before", F.lag("top").over(up))
    opens = F.col("_before").isNull() | ((top != F.col("_before")) & (top - F.col("_before") > tolerance))
    w = w.withColumn("_run", F.max(F.when(opens, top)).over(up))
    w = w.withColumn("_far", F.collect_set(F.when(top - F.col("_run") > tolerance, top)).over(page))
    inside = F.array_sort(F.filter("_far", lambda t: (t > F.col("_run")) & (t <= top)))
    folded = F.aggregate(inside, F.col("_run"), lambda anchor, t: F.when(t - anchor > tolerance, t).otherwise(anchor))
    row = F.when(top - F.col("_run") > tolerance, folded).otherwise(F.col("_run"))
    return _row_text(w.withColumn("row", row), ["doc_id", "page", "row"])


def words_between(words: Column | str, lo: float, hi: float) -> Column:
    """Text of the words whose left edge lies in [lo, hi)."""
    inside = F.filter(words, lambda w: (w["x0"] >= lo) & (w["x0"] < hi))
    return F.array_join(F.transform(inside, lambda w: w["text"]), " ")


def in_columns(rows: DataFrame, columns: dict[str, tuple[int, int]]) -> DataFrame:
    return rows.withColumns({f"c_{f}": words_between("words", *r) for f, r in columns.items()})


def in_layout(rows: DataFrame, banks: DataFrame, layouts: DataFrame) -> DataFrame:
    """Text of every column of every row, for any number of banks at once: rows with `fields`, a map from field to text.

    `rows` is what `rows_by_anchor` gives, `banks` (doc_id, bank) and `layouts` (bank, field, lo, hi): a word belongs to the
    fields of its document's bank whose range [lo, hi) holds its left edge. A row meets its bank's few ranges as one list, so
    that its words stay together; the lists are written first, so that Spark knows their size. Words without a field and rows
    without such words give nothing.
    """
    fields = layouts.filter("lo < hi").groupBy("bank", "field").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    fields = fields.filter("field is not null").groupBy("bank").agg(F.collect_list(F.struct("field", "ranges")).alias("_fields"))
    documents = stored(banks.select("doc_id", "bank").distinct().join(fields, "bank"), "layouts")

    def texts(f):
        holding = lambda w: F.filter(f["ranges"], lambda r: (w["x0"] >= r["lo"]) & (w["x0"] < r["hi"]))
        return F.flatten(F.transform("words", lambda w: F.transform(holding(w), lambda r: w["text"])))

    found = F.transform("_fields", lambda f: F.struct(f["field"].alias("field"), texts(f).alias("texts")))
    found = F.filter(found, lambda f: F.size(f["texts"]) > 0)
    joined = F.transform("_found", lambda f: F.struct(f["field"].alias("field"), F.array_join(f["texts"], " ").alias("text")))
    got = staged(rows.select("doc_id", "page", "row", "words").join(documents, "doc_id"), _found=found).filter(F.size("_found") > 0)
    return got.select("doc_id", "page", "row", "bank", F.map_from_entries(joined).alias("fields"))


def statement_years(lines: DataFrame) -> DataFrame:
    """(doc_id, stmt_month, stmt_year): the first 'Month 20xx', else the most common year token."""
    named = F.col("text").rlike(MONTH_YEAR)
    first = lines.filter(named).groupBy("doc_id").agg(F.min(F.struct("page", "line_no", F.regexp_extract("text", MONTH_YEAR, 1).alias("m"), F.regexp_extract("text", MONTH_YEAR, 2).alias("y"))).alias("f"))
    years = lines.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(20\d{2})\b"), F.lit(1))).alias("y")).groupBy("doc_id", "y").agg(F.count(F.lit(1)).alias("n"))
    common = years.groupBy("doc_id").agg(F.max_by("y", F.struct("n", "y")).alias("common"))
    month = first_match([(F.col("f.m") == m.capitalize(), i) for i, m in enumerate(p.MONTHS, 1)])
    return common.join(first, "doc_id", "left").select("doc_id", month.alias("stmt_month"), F.coalesce("f.y", "common").cast("int").alias("stmt_year"))


def rolled_date(month: Column, day: Column, stmt_month: Column, stmt_year: Column) -> Column:
    """Date of a month/day line: an early statement month puts October-December in the year before, December puts January-February after."""
    m = month.cast("int")
    year = first_match([((stmt_month <= 3) & (m >= 10), stmt_year - 1), ((stmt_month == 12) & (m <= 2), stmt_year + 1)], stmt_year)
    return _date(year, month, day)


def _date(year: Column, month: Column, day: Column) -> Column:
    """NULL where a part is missing."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")


def _amount(text: Column) -> Column:
    return F.regexp_replace(text, r"[$,]", "").try_cast("decimal(18,2)")


def _out(df: DataFrame, source: str) -> DataFrame:
    """Transaction lines, and in `reason` why a line cannot become a row (a statement without a year gives no date)."""
    row = F.struct("transaction_date", "description", "amount", "parser_type")
    df = staged(df.select("doc_id", "page", "text", row.alias("_made")), _row=F.col("_made")).select("doc_id", "page", "text", "_row.*")
    reason = first_match([
        (F.col("transaction_date").isNull(), "no date"), (F.col("amount").isNull(), "no amount"), (F.trim(F.coalesce("description", F.lit(""))) == "", "no description")])
    return df.select("doc_id", "page", "text", "transaction_date", "description", "amount", "parser_type", F.lit(source).alias("source"), reason.alias("reason"))


def template(judged):
    """A parser that returns the rows of `judged`; its lines that are none are in `parse.rejects`, both in `parse.judged`."""

    @wraps(judged)
    def parse(lines: DataFrame) -> DataFrame:
        return judged(lines).filter("reason is null").drop("reason", "page", "text")

    parse.judged = judged
    parse.rejects = lambda lines: judged(lines).filter("reason is not null").select("doc_id", "page", "text", "source", "reason")
    return parse


def write_judged(judged: DataFrame, path: str) -> dict[str, int]:
    """Write rows and rejected lines in one pass, below rejected=false and rejected=true; the counts come from that pass.

    Read both with `judged_rows` and `quarantine`. Returns the numbers of rows, rejected lines and of each reason.
    """
    seen = Observation()
    reasons = ["no date", "no amount", "no description"]
    counts = [F.count_if(F.col("reason").isNull()).alias("rows"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons]]
    judged.observe(seen, *counts).withColumn("rejected", F.col("reason").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(path)
    return dict(seen.get)


def judged_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    rows = spark.read.schema(StructType([*schema.fields, StructField("rejected", BooleanType())])).parquet(path)
    return rows.filter("not rejected").drop("rejected", "reason", "page", "text")


def quarantine(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    rows = spark.read.schema(StructType([*schema.fields, StructField("rejected", BooleanType())])).parquet(path)
    return rows.filter("rejected").select("doc_id", "page", "text", "source", "reason")


@template
def parse_chase(lines: DataFrame) -> DataFrame:
    low = F.lower(F.trim("text"))
    marker = first_match([
        (low.contains("payments and other credits"), "payments"), (low.contains("purchase") & (F.length(F.trim("text")) < 30), "purchases"),
        (contains_any(low, ["interest charges", "year-to-date"]), "none")])
    rows = carry_forward(lines.withColumn("_m", marker), ["doc_id"], "page", ["line_no"], "_m", "section")
    rows = rows.filter(F.col("_m").isNull() & F.col("section").isin("payments", "purchases")).join(statement_years(lines), "doc_id", "left")
    t = F.trim("text")
    g = lambda i: F.regexp_extract(t, CHASE_LINE, i)
    # A trailing state takes its city along (unless that starts with a digit), then a trailing phone number goes.
    desc = F.regexp_replace(g(3), r"\s+(?:[^\d\s]\S*\s+)?[A-Z]{2}$", "")
    desc = F.trim(F.regexp_replace(desc, r"\s+\d{3}-\d{3}-\d{4}$", ""))
    amt = _amount(g(4))
    rows = rows.filter(t.rlike(CHASE_LINE)).withColumns({"description": desc, "_a": amt, "transaction_date": rolled_date(g(1), g(2), F.col("stmt_month"), F.col("stmt_year"))})
    low_desc = F.lower("description")
    paid = (F.col("section") == "payments") & contains_any(low_desc, PAYMENT_WORDS)
    kind = F.when(paid, "credit_card_payment").when(F.col("_a") < 0, "refund").otherwise("expense")
    rows = rows.filter(~contains_any(low_desc, CHASE_SKIP)).withColumns({"parser_type": kind, "amount": F.when(paid, F.col("_a")).otherwise(-F.col("_a"))})
    return _out(rows, "chase_xy")


@template
def parse_wells_credit(lines: DataFrame) -> DataFrame:
    t = F.trim("text")
    due = r"Payment Due Date\s+(\d{2})/(\d{2})/(\d{4})"
    first = lines.filter(F.col("text").rlike(due)).groupBy("doc_id").agg(F.min(F.struct("page", "line_no", "text")).alias("f"))
    stated = first.select("doc_id", F.regexp_extract("f.text", due, 1).cast("int").alias("due_m"), F.regexp_extract("f.text", due, 3).cast("int").alias("due_y"))
    y = statement_years(lines).join(stated, "doc_id", "left")
    rows = lines.filter(t.rlike(WELLS_CREDIT_LINE) & ~contains_any(F.lower("text"), WELLS_CREDIT_SKIP)).join(y, "doc_id", "left")
    g = lambda i: F.regexp_extract(t, WELLS_CREDIT_LINE, i)
    amt = _amount(g(4))
    return _out(rows.withColumns({"description": F.trim(g(3)), "amount": -amt, "parser_type": F.when(amt < 0, "card_credit").otherwise("expense"),
                                  "transaction_date": rolled_date(g(1), g(2), F.col("due_m"), F.coalesce("due_y", "stmt_year"))}), "wf_credit_xy")


@template
def parse_macys(lines: DataFrame) -> DataFrame:
    t = F.trim("text")
    due = r"Payment Due Date\s+(\w+)\s+\d+,\s+(\d{4})"
    first = lines.filter(F.col("text").rlike(due)).groupBy("doc_id").agg(F.min(F.struct("page", "line_no", "text")).alias("f"))
    number = lambda name: first_match([(F.lower(F.substring(name, 1, 3)) == m[:3], i) for i, m in enumerate(p.MONTHS, 1)])
    stated = first.select("doc_id", number(F.regexp_extract("f.text", due, 1)).alias("due_m"), F.regexp_extract("f.text", due, 2).cast("int").alias("due_y"))
    rows = lines.filter(t.rlike(MACYS_LINE) & ~contains_any(F.lower("text"), MACYS_SKIP)).join(stated, "doc_id", "left")
    g = lambda i: F.regexp_extract(t, MACYS_LINE, i)
    amt, raw = _amount(g(4)), F.trim(g(3))
    paid = F.lower(raw).contains("payment - thank you")
    clean = F.trim(F.regexp_replace(raw, r"\s+[A-Z\s]+\([A-Z]{2}\)$", ""))
    return _out(rows.withColumns({
        "description": F.when(paid | (clean == ""), raw).otherwise(clean), "amount": F.when(paid, amt).otherwise(-amt),
        "parser_type": F.when(paid, "credit_card_payment").when(amt > 0, "expense").otherwise("card_credit"),
        "transaction_date": rolled_date(number(g(1)).cast("string"), g(2), F.col("due_m"), F.col("due_y"))}), "macys_citi_xy")


@template
def parse_discover(words: DataFrame) -> DataFrame:
    """Font-shifted words; the description drops amounts, category labels and trailing noise."""
    w = words.withColumn("text", decode_shifted("text"))
    close = r"OPEN TO CLOSE DATE\s*\d{2}/\d{2}/\d{4}\s*-\s*(\d{2})/\d{2}/(\d{4})"
    dated = lambda text: text.rlike(r"^\d{2}/\d{2}(\s|$)") & ~contains_any(F.lower(text), DISCOVER_SKIP)
    # Written, as the statement's dates and its lines are both read from them.
    rows = rows_by_bucket(w, 5).select("doc_id", "page", "row", "text")
    rows = stored(rows.filter(F.col("text").rlike(close) | dated(join_split_amounts("text"))), "statement-rows")
    first = rows.filter(F.col("text").rlike(close)).groupBy("doc_id").agg(F.min(F.struct("page", "row", "text")).alias("f"))
    y = first.select("doc_id", F.regexp_extract("f.text", close, 1).cast("int").alias("stmt_month"), F.regexp_extract("f.text", close, 2).cast("int").alias("stmt_year"))
    rows = rows.withColumn("text", join_split_amounts("text")).filter(dated(F.col("text"))).join(stored(y, "statement-dates"), "doc_id", "left")
    parts = _from_second(F.split("text", r"\s+"))
    money = r"^-?\$[\d,]+\.\d{2}$"
    amt = _amount(F.try_element_at(F.filter(parts, lambda x: x.rlike(money)), F.lit(-1)))
    desc = F.array_join(F.filter(parts, lambda x: ~x.rlike(money) & ~contains_any(F.lower(x), DISCOVER_LABELS)), " ")
    for cut in DISCOVER_CUTS:
        desc = F.trim(F.regexp_replace(desc, cut, ""))
    return _out(rows.withColumns({
        "description": squash(desc), "amount": F.when(amt < 0, amt).otherwise(-amt), "parser_type": F.when(amt < 0, "credit_card_payment").otherwise("expense"),
        "transaction_date": rolled_date(F.substring("text", 1, 2), F.substring("text", 4, 2), F.col("stmt_month"), F.col("stmt_year"))}).filter(F.length("description") >= 2), "discover_xy")


@template
def parse_amex(words: DataFrame) -> DataFrame:
    rows = in_columns(rows_by_anchor(words), AMEX_COLUMNS)
    low = F.lower("text")
    marker = first_match([
        (low.contains("new charges") & ~low.contains("detail"), "charges"),
        (low.contains("payments and credits") | (low.contains("credits") & ~low.contains("detail") & (F.size("words") < 5)), "credits")])
    rows = carry_forward(rows.withColumn("_m", marker), ["doc_id"], "page", ["row"], "_m", "section")
    rows = rows.filter(F.col("_m").isNull() & ~p.is_layout_noise("text") & F.col("c_date").rlike(FULL_DATE))
    amt, desc = p.parse_layout_amount("c_amount"), F.col("c_description")
    d = F.lower(desc)
    rows = rows.filter(~contains_any(d, ["mobile payment", "thank you", "online payment", "autopay"]))
    credits = F.col("section") == "credits"
    hinted = credits | d.contains("platinum") | d.rlike(r"(^|\s)credit$")
    credit = hinted & ((amt < 0) | (credits & (amt > 0)))
    kind = F.when(credit, "card_credit").when(F.col("section") == "charges", "expense")
    rows = rows.withColumns({"description": desc, "parser_type": kind, "amount": F.when(credit, F.abs(amt)).otherwise(-F.abs(amt)), "transaction_date": p.parse_date("c_date")})
    return _out(rows.filter("parser_type is not null"), "amex_xy")


@template
def parse_bofa(words: DataFrame) -> DataFrame:
    rows = in_columns(rows_by_anchor(words), BOFA_COLUMNS)
    low = F.lower("text")
    marker = first_match([
        (low.contains("deposits and other additions"), "deposits"), (contains_any(low, ["withdrawals and", "atm and debit", "other subtractions"]), "withdrawals"),
        (low.contains("checks") & (F.size("words") < 4), "checks"), (contains_any(low, ["service fees", "ending balance"]), "none")])
    rows = carry_forward(rows.withColumn("_m", marker), ["doc_id"], "page", ["row"], "_m", "section")
    rows = rows.filter(F.col("_m").isNull() & ~p.is_layout_noise("text") & F.col("c_date").rlike(FULL_DATE) & F.col("section").isin("deposits", "withdrawals"))
    rows = rows.filter(~contains_any(F.lower("c_description"), ["total deposits", "total withdrawals", "beginning balance", "ending balance"]))
    amt, deposit = F.abs(p.parse_layout_amount("c_amount")), F.col("section") == "deposits"
    return _out(rows.withColumns({"description": F.col("c_description"), "amount": F.when(deposit, amt).otherwise(-amt), "parser_type": F.when(deposit, "income").otherwise("expense"), "transaction_date": p.parse_date("c_date")}), "bofa_xy")


@template
def parse_wells_bank(words: DataFrame) -> DataFrame:
    """Checking pages: the rightmost amount is the balance, the one before it the movement; its position tells the side."""
    # Written, as the years and the lines are all read from them; what is small then is not met by moving every line.
    rows = stored(rows_by_bucket(words, 4).drop("text"), "statement-rows").withColumn("text", _text_of("words"))
    years = stored(statement_years(rows.withColumnRenamed("row", "line_no")), "statement-years")
    first = F.get("words", F.lit(0))["text"]
    rows = rows.filter(first.rlike(r"^\d{1,2}/\d{1,2}$") & ~contains_any(F.lower("text"), WELLS_BANK_SKIP)).join(years, "doc_id", "left")
    rest = _from_second(F.col("words"))
    is_money = lambda w: F.regexp_replace(w["text"], ",", "").rlike(r"^\d+\.\d{2}$")
    amounts, desc = F.filter(rest, is_money), F.array_join(F.transform(F.filter(rest, lambda w: ~is_money(w)), lambda w: w["text"]), " ")
    rows = rows.withColumns({"_amounts": amounts, "description": desc}).filter((F.size("_amounts") > 0) & (F.length("description") >= 3) & ~F.col("description").rlike(r"^\d{3,6}$"))
    move = F.coalesce(F.try_element_at("_amounts", F.lit(-2)), F.try_element_at("_amounts", F.lit(-1)))
    debit = (F.size("_amounts") < 2) | (move["x0"] > 380)
    low = F.lower("description")
    kind = first_match([
        (contains_any(low, ["zelle to", "transfer to", "withdrawal", "withdrwl"]), "transfer"), (contains_any(low, ["payroll", "direct dep", "zelle from", "deposit"]), "income"),
        (contains_any(low, ["american express", "chase credit", "citi payment", "discover"]), "credit_card_payment"), (debit, "expense")], "income")
    rows = rows.withColumns({"parser_type": kind, "_a": _amount(move["text"])}).withColumn("amount", F.when(F.col("parser_type") == "income", F.col("_a")).otherwise(-F.col("_a")))
    date = _date(F.col("stmt_year"), F.regexp_extract(first, r"^(\d+)/", 1), F.regexp_extract(first, r"/(\d+)$", 1))
    return _out(rows.withColumn("transaction_date", date), "wf_banking_xy")


TEMPLATES = {"chase": parse_chase, "wells_credit": parse_wells_credit, "macys": parse_macys, "discover": parse_discover, "amex": parse_amex, "bofa": parse_bofa, "wells_bank": parse_wells_bank}
