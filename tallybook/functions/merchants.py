"""Merchant text: descriptor cleanup, stems, keys and display names, all as built-in expressions.

Patterns run on lower-cased ASCII descriptors; every function takes a Column (or name) and returns a Column.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.columns import any_of, col, first_match, lookup, squash, title_case, tokens
from tallybook.functions import fixed_values as v

# The shorter processor prefixes used by stems and keys, and noise words of the recurrence key.
STEM_PROCESSOR = r"^(?:sq|tst|toast|dd|dsh|paypal|pp|sp|wpy|gum|fs|ven(?:mo)?)\s*\*+\s*"
KEY_NOISE = ["#", "*", "purchase", "recurring", "autopay", "auto pay", "ach", "checkcard", "debit"]
EXTRACTION_PREFIXES = [
    "recurring debit card purchase", "debit card purchase", "pos purchase", "web pmt recur-", "web pmt-", "web pmt",
    "direct payment - purchase", "direct payment -", "direct payment", "intl purch", "ach", "purchase", "payment",
    "recurring", "debit card", "card",
]
LEARNED_PREFIX = r"^(sp|sq|tst|toast|dd|dsh|pp|paypal|gum|wpy|clkbank)\s+"
LEARNED_SUFFIX = r"\b(us|usa|llc|inc|co|corp|ltd)\b"


def _text(c: Column | str) -> Column:
    return F.trim(F.lower(F.coalesce(col(c), F.lit(""))))


def clean_description(desc: Column | str) -> Column:
    """Lower-cased descriptor without processor prefix, store numbers, places and ACH fields."""
    d = F.regexp_replace(_text(desc), v.PROCESSOR_PREFIX, "")
    d = F.regexp_replace(d, r"([a-z])(\d)", "$1 $2")
    d = F.regexp_replace(d, r"(\d)([a-z])", "$1 $2")
    # A one-element array carries a value into a lambda, so the CASE refers to it without repeating its computation.
    first_alias = lambda x: first_match([(x.contains(a), F.replace(x, F.lit(a), F.lit(r))) for a, r in v.PRE_ALIASES.items()], x)
    d = F.transform(F.array(d), first_alias)[0]
    d = reduce(lambda acc, p: F.regexp_replace(acc, "(?i)" + p, " "), v.STRIP_PATTERNS, d)
    return squash(d)


def merchant_alias(cleaned: Column | str) -> Column:
    """Merchant of a cleaned description: wrappers off, then every alias in table order."""
    d = F.trim(F.regexp_replace(col(cleaned), r"^(sq\s*\*|tst\*?\s+|toast\s+)(?=.)", ""))
    d = F.trim(F.regexp_replace(d, r"^paypal\s*\*\s*(?=.)", ""))
    for alias, merchant in v.ALIASES.items():
        d = F.trim(F.replace(d, F.lit(alias), F.lit(merchant)))
    return d


def _stem_prefixes() -> str:
    return "|".join(re.escape(p) for p in v.STEM_PREFIXES)


def stem_base(desc: Column | str) -> Column:
    """Descriptor without processor and bank prefixes, long digit runs and punctuation."""
    d = F.regexp_replace(_text(desc), STEM_PROCESSOR, "")
    d = F.regexp_replace(d, rf"^(?:[ \-*#]*(?:{_stem_prefixes()}))+", "")
    d = F.regexp_replace(d, r"\d{4,}", "")
    d = F.regexp_replace(d, r"[^a-z0-9 ]", " ")
    return squash(d)


def brand_of(base: Column | str) -> Column:
    """National brand by substring, first brand wins; NULL for the long tail."""
    base = col(base)
    stub = lookup(base, v.BRAND_STUBS)
    return F.coalesce(stub, first_match([(any_of(base.contains(n) for n in needles), b) for b, needles in v.BRANDS.items()]))


def first_words(base: Column | str, n: int = 2, longest: int = 32) -> Column:
    """First n words longer than one letter."""
    words = F.filter(tokens(base), lambda w: F.length(w) > 1)
    return F.trim(F.substring(F.array_join(F.slice(words, 1, n), " "), 1, longest))


def stem_of_base(base: Column | str) -> Column:
    return F.coalesce(brand_of(base), first_words(base))


def merchant_stem(desc: Column | str) -> Column:
    """Parse-stable merchant stem used by the fingerprint."""
    carried = F.transform(F.array(stem_base(desc)), stem_of_base)
    return carried[0]


def recurrence_key(desc: Column | str) -> Column:
    """Merchant key for recurrence: noise words, long digit runs, years and a trailing month removed, 32 chars."""
    d = reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit("")), KEY_NOISE, _text(desc))
    d = F.regexp_replace(d, r"\d{7,}", "")
    d = F.regexp_replace(d, r"\b20\d{2}\b", "")
    d = squash(d)
    d = F.trim(F.regexp_replace(d, rf"(^|\s)(?:{'|'.join(v.MONTH_WORDS)})$", ""))
    return F.trim(F.substring(d, 1, 32))


def key8(desc: Column | str) -> Column:
    return F.substring(recurrence_key(desc), 1, 8)


def dedup_key(desc: Column | str) -> Column:
    """Four letters of the recurrence key (its first four characters when it has no letters)."""
    k = recurrence_key(desc)
    letters = F.substring(F.regexp_replace(k, "[^a-z]", ""), 1, 4)
    return F.when(letters != "", letters).otherwise(F.substring(k, 1, 4))


def three_word_key(desc: Column | str) -> Column:
    d = F.regexp_replace(F.lower(F.coalesce(col(desc), F.lit(""))), STEM_PROCESSOR, "")
    return F.array_join(F.slice(tokens(F.regexp_replace(d, r"[^a-z ]+", " ")), 1, 3), " ")


def prefix_key(desc: Column | str, n: int = 12) -> Column:
    return F.trim(F.lower(F.substring(F.coalesce(col(desc), F.lit("")), 1, n)))


def learned_core(desc: Column | str) -> Column:
    """Stable core of a corrected merchant: cleaned, without processor and legal suffix, 24 chars."""
    cleaned = clean_description(desc)

    def core(c: Column) -> Column:
        k = squash(F.regexp_replace(F.regexp_replace(c, LEARNED_PREFIX, ""), LEARNED_SUFFIX, " "))
        return F.trim(F.substring(F.when(k != "", k).otherwise(c), 1, 24))

    return F.transform(F.array(cleaned), core)[0]


def credit_hint(desc: Column | str) -> Column:
    """Merchant named by a card credit: the text after the first dash, else an inline keyword; NULL if neither."""
    raw = F.coalesce(col(desc), F.lit(""))
    tail = F.substring(F.regexp_replace(F.trim(F.lower(F.regexp_extract(raw, r"-\s*(.+)", 1))), r"\s+", " "), 1, 20)
    low = F.lower(raw)
    inline = first_match([(low.contains(k), h) for k, h in v.CREDIT_INLINE_HINTS.items()])
    return F.when(raw.rlike(r"-\s*(.+)"), tail).otherwise(inline)


def extraction_stem(desc: Column | str) -> Column:
    """Two-word stem of an extracted row; each known prefix is removed at most once, in table order."""
    d = F.regexp_replace(F.lower(F.coalesce(col(desc), F.lit(""))), STEM_PROCESSOR, "")
    d = reduce(lambda acc, p: F.regexp_replace(acc, rf"^[ \-*#]*{re.escape(p)}", ""), EXTRACTION_PREFIXES, d)
    x = F.regexp_replace(F.regexp_replace(d, r"\d{3,}", ""), r"[^a-z0-9 ]", " ")
    words = F.filter(tokens(x), lambda w: F.length(w) > 1)
    return F.array_join(F.slice(words, 1, 2), " ")


def ordinal(day: Column) -> Column:
    """1 -> 1st, 11 -> 11th."""
    last = first_match([(day % 10 == 1, "st"), (day % 10 == 2, "nd"), (day % 10 == 3, "rd")], "th")
    return F.concat(day.cast("string"), F.when((day % 100).between(11, 13), "th").otherwise(last))


# ------------------------------------------------------------------ display names

# Noise removed from a raw descriptor, in order, before the name is cased.
DISPLAY_CUTS = [
    (r"(?i)(\s+des:).*$", ""),
    (r"(?i)\s+(id|indn|co\s?id|ppd|ccd|web|tel|arc)\b.*$", ""),
    (r"(?i)^(?:sq|tst|toast|dd|dsh|pp|paypal|sp|clkbank|wpy|gum)\s+\*?\s*", ""),
    (r"\b[A-Z0-9]*\*[A-Z0-9]+", ""),
    (r"#\d+", ""),
    (r"\b\d{6,}\b", ""),
    (r"(?:\b1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}", ""),
]
DISPLAY_TAIL = [
    (r"\d{1,2}/\d{1,2}(?:/\d{2,4})?", ""),
    (r"\bhttps?://\S+", ""),
    (r"(?i)\b[a-z0-9-]+\.(?:com|net|org|io|co)\b", ""),
    (r"\s+\b[A-Z]{2}\b\s*$", ""),
    (r"[*#]", ""),
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"\s[/\\][\w]*", " "),
    (r"\b[\w]+[/\\]\s", " "),
    (r"\b(\w)[.](\s|$)", "$1$2"),
    (r"(\w)[.,;:!?-]+\s*$", "$1"),
    (r"(?i)\b[A-Z]{2}\b\s*$", ""),
    (r"(?i)\b(withdrwl|withdrawal|bal\s*inq|balance\s*inquiry|atm|pos\s*debit|debit\s*card|purchase)\b", " "),
    (r"(?i)\bs-?\d+\b", " "),
    (r"(?i)\b(llc|inc|co|corp|ltd|usa)\b\.?", " "),
    (r"(?i)_[a-z]{2,}\b", " "),
    (r"[-]+", " "),
]
CODE_TOKEN = r"^(?:[A-Za-z]+\d+[A-Za-z]+\d|\d+[A-Za-z]+\d+[A-Za-z])[A-Za-z0-9]*$"
HOA_NAME = r"\bhoa\b|homeowner.?(assoc|dues)"


def _drop_codes(text: Column) -> Column:
    """Drop six-plus character tokens that switch between letters and digits three times or more."""

    def keep(tok: Column) -> Column:
        core = F.regexp_replace(tok, r"^[.,;:#*\-]+|[.,;:#*\-]+$", "")
        return ~((F.length(core) >= 6) & core.rlike(CODE_TOKEN))

    return F.array_join(F.filter(tokens(text), keep), " ")


def _collapse_repeat(text: Column) -> Column:
    """Cut at a later repetition of the first word, looking furthest out first."""

    def cut(toks: Column) -> Column:
        n = F.size(toks)
        head = F.lower(F.get(toks, F.lit(0)))
        hits = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.lower(F.get(toks, i)) == head)
        at = lambda least: F.get(F.filter(hits, lambda i: i >= least), F.lit(0))
        j = F.coalesce(F.when(n >= 6, at(3)), F.when(n >= 4, at(2)), F.when(n >= 2, at(1)))
        return F.when(j.isNotNull(), F.slice(toks, F.lit(1), F.coalesce(j, F.lit(1)))).otherwise(toks)

    return F.array_join(F.transform(F.array(tokens(text)), cut)[0], " ")


def _display_word(w: Column, i: Column) -> Column:
    core = F.regexp_replace(w, r"[^\w+]+$", "")
    tail = F.substring(w, F.length(core) + 1, F.length(w))
    cased = first_match(
        [
            (F.upper(core).isin(v.ACRONYMS), F.upper(core)),
            ((i > 0) & F.lower(core).isin(v.SMALL_WORDS), F.lower(core)),
        ],
        F.concat(F.upper(F.substring(core, 1, 1)), F.lower(F.substring(core, F.lit(2), F.length(core)))),
    )
    return F.concat(cased, tail)


def display_merchant(desc: Column | str) -> Column:
    """Display name of a raw bank descriptor; falls back to the descriptor itself when nothing is left."""
    raw = F.trim(F.coalesce(col(desc), F.lit("")))
    d = reduce(lambda acc, pr: F.regexp_replace(acc, *pr), DISPLAY_CUTS, raw)
    d = _drop_codes(d)
    d = squash(reduce(lambda acc, pr: F.regexp_replace(acc, *pr), DISPLAY_TAIL, d))
    d = _collapse_repeat(d)

    def name(x: Column) -> Column:
        cased = F.substring(F.array_join(F.transform(tokens(x), _display_word), " "), 1, 50)
        known = F.transform(F.array(cased), lambda c: F.coalesce(lookup(F.lower(F.trim(c)), v.KNOWN_MERCHANTS), c))[0]
        return F.when(F.lower(x).rlike(HOA_NAME), "HOA Payment").otherwise(known)

    named = F.transform(F.array(d), lambda x: F.when(x == "", F.substring(raw, 1, 50)).otherwise(name(x)))[0]
    return F.when(raw == "", F.lit("")).otherwise(named)


def group_display_name(raw: Column | str) -> Column:
    """Short name of a group of fixed items: known key, else three words without codes, months and state tails."""
    low = F.trim(F.lower(F.coalesce(col(raw), F.lit(""))))
    key = F.substring(F.regexp_replace(low, "[^a-z]", ""), 1, 4)
    d = low
    for p in (r"\b20\d{2}\b", r"\d{3}[-.] \d{3}[-.] \d{4}", r"\d{3}[-.]\d{3}[-.]\d{4}", r"\d{6,}", r"[*]"):
        d = F.regexp_replace(d, p, "")
    d = squash(d)
    d = F.trim(F.regexp_replace(d, rf"(^|\s)(?:{'|'.join(v.MONTH_WORDS)})$", ""))
    for _ in range(2):
        d = F.trim(F.regexp_replace(d, r"(^|\s)[a-z]{2}$", ""))
    words = F.slice(F.filter(tokens(title_case(d)), lambda w: F.length(w) > 1), 1, 3)

    def trim_tail(ws: Column) -> Column:
        cut = (F.size(ws) > 0) & (F.length(F.try_element_at(ws, F.lit(-1))) >= 4) & ~F.try_element_at(ws, F.lit(-1)).rlike("[aeiouAEIOU]")
        return F.when(cut, F.slice(ws, F.lit(1), F.size(ws) - 1)).otherwise(ws)

    name = F.array_join(F.transform(F.array(words), trim_tail)[0], " ")
    return F.coalesce(lookup(key, v.DISPLAY_MAP), name)

