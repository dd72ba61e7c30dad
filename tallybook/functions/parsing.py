"""Parsing of statement text: dates, money, issuers, row filters, masks and small validations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.columns import MONEY, col, contains_any, first_match, lookup, squash
from tallybook.functions import fixed_values as v

# Month names, month and day digits, masks, typo domains.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MM, _DD = r"(1[0-2]|0[1-9]|[1-9])", r"(3[01]|[12]\d|0[1-9]|[1-9])"
MASKED_ACCOUNT = r"\b[X\*x]{3,}[ -]?(\d{4})\b"
LONG_ACCOUNT = r"\b\d{8,}(\d{4})\b"
GROUPED_ACCOUNT = r"\b(?:\d{3,6}[ -]){2,5}\d{3,6}\b"
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
DOMAIN_TYPOS = {
    "gmai.com": "gmail.com", "gmial.com": "gmail.com", "gmal.com": "gmail.com", "gmail.co": "gmail.com",
    "gnail.com": "gmail.com", "gmaill.com": "gmail.com", "yaho.com": "yahoo.com", "yahooo.com": "yahoo.com",
    "yahoo.co": "yahoo.com", "hotmial.com": "hotmail.com", "hotmai.com": "hotmail.com", "hotmil.com": "hotmail.com",
    "outlok.com": "outlook.com", "outloo.com": "outlook.com", "iclod.com": "icloud.com", "icloud.co": "icloud.com",
}
FILE_NAME_ISSUERS = [
    (["discover"], "Discover"), (["chase"], "Chase"), (["citi"], "Citi"), (["wells", "wf"], "Wells Fargo"),
    (["amex", "american"], "American Express"), (["bofa", "bofamerica"], "Bank of America"), (["barclays"], "Barclays"),
    (["capital"], "Capital One"), (["apple card", "applecard", "apple_card"], "Apple Card"),
    (["synchrony"], "Synchrony Bank"), (["sofi"], "SoFi"), (["chime"], "Chime"), (["ally"], "Ally"),
    (["marcus"], "Marcus"), (["macys", "macy"], "Macys-Citi"),
]
HEADER_ISSUERS = [
    (["bank of america"], "Bank of America"), (["apple card"], "Apple Card"),
    (["american express", "amex"], "American Express"), (["wells fargo"], "Wells Fargo"), (["discover"], "Discover"),
    (["citibank", "citi "], "Citi"), (["chase", "jpmorgan"], "Chase"),
]
# Canonical issuer names, so the sign rule knows every spelling the detectors produce.
ISSUER_SYNONYMS = {"Citi": "Citibank", "Barclays": "Barclays US", "Ally": "Ally Bank", "Marcus": "Marcus by Goldman Sachs"}


# Each numeric shape rewritten to year-month-day, and the formats with month names.
ISO_REWRITES = [
    (r"^(\d{1,2})[/-](20\d{2})$", "$2-$1-1"), (r"^(20\d{2})[/-](\d{1,2})$", "$1-$2-1"), (rf"^{_MM}/(\d{{4}})$", "$2-$1-1"),
    (rf"^{_MM}/{_DD}/(\d{{4}})$", "$3-$1-$2"), (rf"^{_MM}-{_DD}-(\d{{4}})$", "$3-$1-$2"),
    (rf"^{_MM}([/-]){_DD}\2(69|[7-9]\d)$", "19$4-$1-$3"), (rf"^{_MM}([/-]){_DD}\2(\d{{2}})$", "20$4-$1-$3"),
    (rf"^(\d{{4}}){_MM}{_DD}$", "$1-$2-$3"),
]
NAMED_FORMATS = ["MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy"]


def parse_date(text: Column | str) -> Column:
    """Date of a statement cell in any of the known shapes; month-only values give day 1; anything else NULL."""
    flat = squash(F.replace(col(text), F.lit(","), F.lit("")))
    iso = reduce(lambda d, pr: F.regexp_replace(d, *pr), ISO_REWRITES, flat)
    numeric = F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), iso.try_cast("date"))
    named = [F.to_date(F.try_to_timestamp(flat, F.lit(f))) for f in NAMED_FORMATS]
    return F.when(flat.rlike("[A-Za-z]"), F.coalesce(*named)).otherwise(numeric)


def _signed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\((.*)\)$", "-$1").try_cast(MONEY)


def parse_amount(text: Column | str) -> Column:
    """Money text to DECIMAL; parentheses are negative; NULL when it is not a number."""
    return _signed(F.regexp_replace(F.trim(col(text)), r"[,$£€]", ""))


def parse_amount_or_zero(text: Column | str) -> Column:
    """The lenient variant: a plus sign is allowed and anything unreadable is 0."""
    return F.coalesce(_signed(F.regexp_replace(F.trim(col(text)), r"[,$+]", "")), F.lit(0).cast(MONEY))


def parse_layout_amount(text: Column | str) -> Column:
    """Amount of a statement line: markers, commas and spaces dropped, no parentheses."""
    return F.regexp_replace(col(text), r"[⧫$,\s]", "").try_cast(MONEY)


# How many characters of a text and of a delimited file's head tell its issuer by default; None takes all.
ISSUER_TEXT_CHARS = 3000
ISSUER_HEAD_CHARS = 1500


def _start(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def issuer_from_text(text: Column | str, chars: int | None = ISSUER_TEXT_CHARS) -> Column:
    """First known issuer keyword (table order) in the first `chars` characters, with None in the whole text."""
    head = F.array(F.lower(_start(col(text), chars)))
    return F.transform(head, lambda h: first_match([(h.contains(k), n) for k, n in v.ISSUER_KEYWORDS.items()], F.lit(None).cast("string")))[0]


def issuer_from_header(text: Column | str, chars: int | None = ISSUER_HEAD_CHARS) -> Column:
    """Account-level signals in the first `chars` characters of a delimited file, with None in all that is given."""
    low = F.lower(col(text))
    head = _start(low, chars)
    cases = [
        (low.contains("extended details") & low.contains("appears on your statement as"), "American Express"),
        (head.contains("beginning balance") & head.contains("ending balance"), "Bank of America"),
    ]
    cases += [(contains_any(head, words), name) for words, name in HEADER_ISSUERS]
    return first_match(cases, F.lit(None).cast("string"))


def issuer_from_file_name(name: Column | str) -> Column:
    low = F.lower(col(name))
    return first_match([(contains_any(low, words), issuer) for words, issuer in FILE_NAME_ISSUERS], F.lit(None).cast("string"))


def issuer_from_sheet(text: Column | str) -> Column:
    low = F.lower(col(text))
    return first_match([(contains_any(low, words), name) for name, words in v.SHEET_MARKERS.items()], F.lit(None).cast("string"))


def detect_issuer(file_name: Column | str, header: Column | str, text: Column | str, whole: bool = False) -> Column:
    """File name first, then the header, then the text, else 'Unknown Bank'; with `whole` beyond the usual characters too."""
    head, body = (None, None) if whole else (ISSUER_HEAD_CHARS, ISSUER_TEXT_CHARS)
    return F.coalesce(issuer_from_file_name(file_name), issuer_from_header(header, head), issuer_from_text(text, body), F.lit("Unknown Bank"))


def canonical_issuer(name: Column | str) -> Column:
    return F.coalesce(lookup(name, ISSUER_SYNONYMS), col(name))


def normalize_sign(amount: Column | str, issuer: Column | str, has_debit_credit: Column | bool = False) -> Column:
    """Negative = money out. Issuers that print charges as positive are negated once, unless debit/credit are split."""
    split = F.lit(has_debit_credit) if isinstance(has_debit_credit, bool) else has_debit_credit
    flip = canonical_issuer(issuer).isin(v.POSITIVE_CHARGE_ISSUERS) & ~split
    return F.when(flip, -col(amount)).otherwise(col(amount))


def sign_by_parser_type(amount: Column | str, parser_type: Column | str, issuer: Column | str) -> Column:
    """Trusted parser types fix the sign; every other row follows the issuer rule."""
    size = F.abs(col(amount))
    return first_match(
        [
            (col(parser_type).isin("refund", "card_credit"), size),
            (col(parser_type).isin("credit_card_payment", "loan_payment"), -size),
        ],
        normalize_sign(amount, issuer),
    )


def direction_amount(amount: Column | str, direction: Column | str) -> Column:
    size = F.abs(col(amount))
    return F.when(col(direction) == "credit", size).otherwise(-size)


def direction_type(description: Column | str, direction: Column | str) -> Column:
    money_back = contains_any(F.lower(F.coalesce(col(description), F.lit(""))), ["refund", "return"])
    credit = F.when(money_back, "refund").otherwise("card_credit")
    return F.when(col(direction) == "credit", credit).otherwise("expense")


def exclusion_of(description: Column | str) -> Column:
    """'financing_fee' or 'statement_summary' for rows that are never transactions, else NULL."""
    low = F.lower(F.coalesce(col(description), F.lit("")))
    return first_match(
        [
            (contains_any(low, v.FEE_KEYWORDS), "financing_fee"),
            (contains_any(low, v.STATEMENT_SUMMARY_KEYWORDS), "statement_summary"),
        ]
    )


def is_statement_credit(description: Column | str) -> Column:
    low = F.lower(F.coalesce(col(description), F.lit("")))
    return low.rlike("|".join(f"(?:{p})" for p in v.STATEMENT_CREDIT_FORMS))


def is_non_transaction(description: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(col(description), F.lit(""))), v.NON_TRANSACTION_PHRASES)


def is_summary_row(cleaned: Column | str, amount: Column | str) -> Column:
    c = col(cleaned)
    return (col(amount) == 0) | contains_any(c, v.SUMMARY_KEYWORDS) | c.rlike("(?i)" + v.PAYMENT_SUMMARY_PATTERN)


def is_layout_noise(text: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(col(text), F.lit(""))), v.LAYOUT_SKIP_SECTIONS)


def is_pending_status(status: Column | str) -> Column:
    return F.lower(F.coalesce(col(status), F.lit("posted"))).contains("pending")


def is_valid_row(date: Column | str, amount: Column | str, description: Column | str) -> Column:
    ok = col(date).isNotNull() & col(amount).isNotNull() & (col(amount) != 0) & (F.trim(col(description)) != "")
    return F.coalesce(ok, F.lit(False))


def account_label(file_name: Column | str, issuer: Column | str) -> Column:
    """Issuer plus account digits of the file name: those right after the issuer, else the first 3+ digit run that is no date."""
    stem = F.regexp_replace(col(file_name), r"\.[^.]*$", "")
    squeezed = F.replace(col(issuer), F.lit(" "), F.lit(""))
    shape = F.concat(F.lit(r"(?i)\Q"), squeezed, F.lit(r"\E[ _-]?(\d{3,6})"))
    near = F.call_function("regexp_extract", stem, shape, F.lit(1))
    runs = F.filter(F.regexp_extract_all(stem, F.lit(r"(\d{3,})"), F.lit(1)), lambda r: F.length(r) != 8)
    digits = F.coalesce(F.nullif(near, F.lit("")), F.get(runs, F.lit(0)))
    return F.when(digits.isNotNull(), F.concat(col(issuer), F.lit(" "), digits)).otherwise(col(issuer))


def mask_accounts(text: Column | str) -> Column:
    """Account and card numbers to ****last4; phone numbers, dates and amounts stay."""
    d = F.regexp_replace(F.regexp_replace(col(text), MASKED_ACCOUNT, "****$1"), LONG_ACCOUNT, "****$1")

    def mask(m: Column) -> Column:
        digits = F.regexp_replace(m, r"\D", "")
        return F.when(F.length(digits).between(13, 19), F.concat(F.lit("****"), F.right(digits, F.lit(4)))).otherwise(m)

    def rejoin(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(f"({GROUPED_ACCOUNT})"), F.lit(1))
        between = F.split(x, GROUPED_ACCOUNT, -1)
        return F.array_join(F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(mask(m), F.lit("")))), "")

    # Texts without a grouped number skip the split.
    return F.transform(F.array(d), lambda x: F.when(x.rlike(GROUPED_ACCOUNT), rejoin(x)).otherwise(x))[0]


def canonical_category(raw: Column | str) -> Column:
    """Issuer category to a canonical one, else Other."""
    name = F.trim(col(raw))
    own = F.when(name.isin(v.CANONICAL_CATEGORIES), name)
    return F.coalesce(lookup(name, v.ISSUER_CATEGORY_MAP), own, F.lit("Other"))


def is_email(text: Column | str) -> Column:
    return col(text).rlike(EMAIL_SHAPE)


def email_suggestion(text: Column | str) -> Column:
    """Corrected address for a known domain typo, else NULL."""
    parts = F.split(col(text), "@")
    fixed = lookup(F.get(parts, F.lit(1)), DOMAIN_TYPOS)
    return F.when(fixed.isNotNull(), F.concat(F.get(parts, F.lit(0)), F.lit("@"), fixed))


EXTRACTION_SCHEMA = (
    "struct<bank_name:string,account_last4:string,statement_period:string,opening_balance:decimal(18,2),"
    "closing_balance:decimal(18,2),transactions:array<struct<date:string,description:string,amount:decimal(18,2),"
    "direction:string,category:string>>>"
)


def parse_extraction(raw: Column | str) -> Column:
    """JSON text, optionally inside a code fence, to a statement struct; NULL fields when it is not JSON."""
    body = F.regexp_replace(F.trim(col(raw)), r"^```(?:json)?", "")
    body = F.trim(F.regexp_replace(F.trim(body), r"```$", ""))
    return F.from_json(body, EXTRACTION_SCHEMA)

