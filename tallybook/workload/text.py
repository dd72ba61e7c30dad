"""Text, parsing and classification queries over every distinct descriptor, document and conversation turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook import columns as C
from tallybook.functions import fixed_values as v
from tallybook.functions import merchants as mt
from tallybook.functions import parsing as ps
from tallybook.functions import signals as sg
from tallybook.operators import aggregates as agg
from tallybook.operators import classify as cl
from tallybook.operators import recurrence as rec
from tallybook.operators.dedup import with_fingerprint
from tallybook.workload import sqltext as s
from tallybook.workload.registry import LIVE, SPEND, query, rr, title, usd, usd_plain
from tallybook.workload.summaries import MONTHS, m

q = s.q


def memos(t):
    return t.ledger.select("memo").distinct()


def both_texts(t):
    """Distinct raw and cleaned descriptors."""
    return t.ledger.select(F.explode(F.array("memo", "description")).alias("text")).distinct()


BOTH = "(select memo as text from ledger union select description from ledger)"


@query("c1_clean_description", f"select text, cleaned from (select text, {s.cleaned_cols('text')} from {BOTH})")
def c1(t):
    return both_texts(t).select("text", mt.clean_description("text").alias("cleaned"))


@query("c2_merchant_alias", f"select text, merchant from (select text, {s.cleaned_cols('text')} from {BOTH})")
def c2(t):
    d = both_texts(t).withColumn("cleaned", mt.clean_description("text"))
    return d.select("text", mt.merchant_alias("cleaned").alias("merchant"))


@query("c3_merchant_stem", f"select text, stem from (select text, {s.stem_cols('text')} from {BOTH})")
def c3(t):
    return both_texts(t).select("text", mt.merchant_stem("text").alias("stem"))


AMOUNT_TEXT = "regexp_replace('' || amount, '(\\.\\d)0$', '\\1')"
FP = f"""sha256(case when ext_id is not null then concat_ws('|', bank_source, account_name, ext_id)
 else concat_ws('|', bank_source, account_name, '' || transaction_date, {AMOUNT_TEXT}, stem) end)"""


@query(
    "c4_fingerprint",
    f"""with st as (select text, stem from (select text, {s.stem_cols('text')} from (select distinct memo as text from ledger)))
select transaction_id, {FP} as fingerprint from ledger join st on memo = text""",
)
def c4(t):
    rows = t.ledger.drop("description").withColumnRenamed("memo", "description")
    return with_fingerprint(rows).select("transaction_id", "fingerprint")


@query("c5_recurrence_key", f"select text, {s.recurrence_key('text')} as merchant_key, substr(merchant_key, 1, 8) as key8 from {BOTH}")
def c5(t):
    return both_texts(t).select("text", mt.recurrence_key("text").alias("merchant_key"), mt.key8("text").alias("key8"))


@query("c6_display_merchant", f"select text, shown from {s.display_from(BOTH, 'text')}")
def c6(t):
    return both_texts(t).select("text", mt.display_merchant("text").alias("shown"))


@query("c7_dedup_key", f"select text, dk from (select text, {s.dedup_cols('text')} from {BOTH})")
def c7(t):
    return both_texts(t).select("text", mt.dedup_key("text").alias("dk"))


@query("c8_three_word_key", f"select text, {s.three_word_key('text')} as word_key from {BOTH}")
def c8(t):
    return both_texts(t).select("text", mt.three_word_key("text").alias("word_key"))


@query(
    "c9_prefix_keys",
    f"select text, {', '.join(f'trim(lower(substr(text, 1, {n}))) as k{n}' for n in (10, 12, 15))} from {BOTH}",
)
def c9(t):
    return both_texts(t).select("text", *[mt.prefix_key("text", n).alias(f"k{n}") for n in (10, 12, 15)])


@query("c10_learned_core", f"select text, core from (select text, {s.learned_core_cols('text')} from {BOTH})")
def c10(t):
    return both_texts(t).select("text", mt.learned_core("text").alias("core"))


@query("c11_credit_hint", f"select text, {s.credit_hint('text')} as hint from {BOTH}")
def c11(t):
    return both_texts(t).select("text", mt.credit_hint("text").alias("hint"))


@query(
    "c12_extraction_key",
    f"""with e as (select memo, {s.extraction_stem('memo')} as stem from (select distinct memo from ledger))
select '' || transaction_date as date, cents::bigint as cents, stem, count(*) as n, min(transaction_id) as first_id
 from ledger join e using (memo) group by 1, 2, 3""",
)
def c12(t):
    keyed = t.ledger.withColumn("stem", mt.extraction_stem("memo"))
    return keyed.groupBy(F.col("transaction_date").alias("date"), "cents", "stem").agg(F.count(F.lit(1)).alias("n"), F.min("transaction_id").alias("first_id"))


@query(
    "c13_formats",
    f"""with {MONTHS}, d as (select user_id, ym, max(day(transaction_date)) as dom from ledger where {LIVE} group by 1, 2)
select user_id, ym, {usd('(flexible + committed)')} as money_text, {usd_plain('flexible')} as plain_text,
 strftime((ym || '-01')::date, '%B %Y') as long_label, strftime((ym || '-01')::date, '%b %y') as short_label,
 dom || case when dom between 11 and 13 then 'th' when dom % 10 = 1 then 'st' when dom % 10 = 2 then 'nd' when dom % 10 = 3 then 'rd' else 'th' end as ordinal
 from mt join d using (user_id, ym)""",
)
def c13(t):
    days = agg.with_period(agg.spend(t.ledger)).groupBy("user_id", "ym").agg(F.max(F.dayofmonth("transaction_date")).alias("dom"))
    mc = agg.month_cents(t.ledger).join(days, ["user_id", "ym"])
    return mc.select(
        "user_id", "ym", C.dollars(F.col("flexible") + F.col("committed")).alias("money_text"), C.dollars_plain("flexible").alias("plain_text"),
        C.month_long("ym").alias("long_label"), C.month_short("ym").alias("short_label"), mt.ordinal(F.col("dom")).alias("ordinal"))


@query("c14_group_display_name", f"select text, merchant from (select text, {s.group_name_cols('text')} from {BOTH})")
def c14(t):
    return both_texts(t).select("text", mt.group_display_name("text").alias("merchant"))


# ---------------------------------------------------------------- parsing

DATE_TEXT = """case cents % 13 when 0 then strftime(D, '%m/%d/%Y') when 1 then strftime(D, '%-m/%-d/%y') when 2 then strftime(D, '%Y-%m-%d')
 when 3 then strftime(D, '%m-%d-%Y') when 4 then strftime(D, '%m-%d-%y') when 5 then strftime(D, '%B %d, %Y') when 6 then strftime(D, '%b %d %Y')
 when 7 then strftime(D, '%d %B %Y') when 8 then strftime(D, '%d %b %Y') when 9 then strftime(D, '%m/%Y') when 10 then strftime(D, '%Y%m%d')
 when 11 then strftime(D, '%Y-%m') else '13/45/' || strftime(D, '%Y') end""".replace("cents", "abs(cents)").replace("D,", "transaction_date,")
SPARK_SHAPES = ["MM/dd/yyyy", "M/d/yy", "yyyy-MM-dd", "MM-dd-yyyy", "MM-dd-yy", "MMMM dd, yyyy", "MMM dd yyyy", "dd MMMM yyyy", "dd MMM yyyy", "MM/yyyy", "yyyyMMdd", "yyyy-MM"]


def date_texts(t):
    k = F.abs(F.col("cents")) % 13
    shaped = C.first_match([(k == i, F.date_format("transaction_date", f)) for i, f in enumerate(SPARK_SHAPES)], F.concat(F.lit("13/45/"), F.date_format("transaction_date", "yyyy")))
    return t.ledger.select(shaped.alias("text")).distinct()


@query("b1_parse_date", f"select text, '' || {s.parse_date('text')} as parsed from (select distinct {DATE_TEXT} as text from ledger)")
def b1(t):
    return date_texts(t).select("text", ps.parse_date("text").alias("parsed"))


AMOUNT_CASE = """case abs(cents) % 9 when 0 then '$' || format('{:,}', abs(cents) // 100) || '.50' when 1 then '(' || abs(cents) // 100 || '.25)'
 when 2 then '+' || abs(cents) when 3 then '' when 4 then 'n/a' when 5 then '£' || abs(cents) || '.1' when 6 then ' ' || cents || ' '
 when 7 then '($' || abs(cents) || ')' else '-' || abs(cents) || '.999' end"""


def amount_texts(t):
    k, a = F.abs(F.col("cents")) % 9, F.abs(F.col("cents"))
    whole = C.idiv(a, F.lit(100).cast("long"))
    text = C.first_match(
        [
            (k == 0, F.concat(F.lit("$"), F.format_number(whole, 0), F.lit(".50"))), (k == 1, F.concat(F.lit("("), whole.cast("string"), F.lit(".25)"))),
            (k == 2, F.concat(F.lit("+"), a.cast("string"))), (k == 3, ""), (k == 4, "n/a"), (k == 5, F.concat(F.lit("£"), a.cast("string"), F.lit(".1"))),
            (k == 6, F.concat(F.lit(" "), F.col("cents").cast("string"), F.lit(" "))), (k == 7, F.concat(F.lit("($"), a.cast("string"), F.lit(")"))),
        ],
        F.concat(F.lit("-"), a.cast("string"), F.lit(".999")),
    )
    return t.ledger.select(text.alias("text")).distinct()


def _dec(x: str) -> str:
    return f"try_cast(nullif(regexp_replace({x}, '^\\((.*)\\)$', '-\\1'), '') as decimal(18,2))::double"


@query(
    "b2_parse_amount",
    f"""select text, {_dec("regexp_replace(trim(text), '[,$£€]', '', 'g')")} as amount,
 coalesce({_dec("regexp_replace(trim(text), '[,$+]', '', 'g')")}, 0) as lenient,
 try_cast(nullif(regexp_replace(text, '[⧫$,\\s]', '', 'g'), '') as decimal(18,2))::double as layout from (select distinct {AMOUNT_CASE} as text from ledger)""",
)
def b2(t):
    return amount_texts(t).select("text", ps.parse_amount("text").alias("amount"), ps.parse_amount_or_zero("text").alias("lenient"), ps.parse_layout_amount("text").alias("layout"))


NAMES = ["Chase1087.csv", "my-amex-2024.xlsx", "wf_activity.csv", "statement 20240131.pdf", "bofa_0042.csv", "export.csv", "apple_card.csv", "Macys 123456.pdf"]
FILE_CASE = "case (abs(cents) % 8) " + " ".join(f"when {i} then {q(n)}" for i, n in enumerate(NAMES)) + " end"
HEADS = ["Bank of America summary", "Beginning balance 1 Ending balance 2", "jpmorgan", "Apple Card", "no issuer here", "citi double", "Amex activity", "Discover it"]
HEAD_CASE = "case (abs(cents) // 8 % 8) " + " ".join(f"when {i} then {q(n)}" for i, n in enumerate(HEADS)) + " end"


def _choose(names, k):
    return C.first_match([(k == i, n) for i, n in enumerate(names)])


def files(t):
    a = F.abs(F.col("cents"))
    return t.ledger.select("transaction_id", "amount", "memo", "bank_source", _choose(NAMES, a % 8).alias("file_name"), _choose(HEADS, C.idiv(a, F.lit(8).cast("long")) % 8).alias("header"))


NAME_SQL = s.case([(s.words("lower(file_name)", ws), q(n)) for ws, n in ps.FILE_NAME_ISSUERS], "null")
HEAD_SQL = s.case(
    [("contains(lower(header), 'beginning balance') and contains(lower(header), 'ending balance')", "'Bank of America'")]
    + [(s.words("lower(header)", ws), q(n)) for ws, n in ps.HEADER_ISSUERS], "null")
FILES = f"fl as (select *, {FILE_CASE} as file_name, {HEAD_CASE} as header from ledger)"
TEXT_ISSUERS = "tx as (select memo, " + s.issuer_text("memo") + " as by_text from (select distinct memo from ledger))"


@query(
    "b3_detect_issuer",
    f"""with {FILES}, {TEXT_ISSUERS} select file_name, header, memo, coalesce({NAME_SQL}, {HEAD_SQL}, by_text, 'Unknown Bank') as issuer, count(*) as n
 from fl join tx using (memo) group by all""",
)
def b3(t):
    f = files(t)
    return f.groupBy("file_name", "header", "memo").agg(F.count(F.lit(1)).alias("n")).withColumn("issuer", ps.detect_issuer("file_name", "header", "memo"))


@query(
    "b3_sheet_issuer",
    "select memo || ' ' || bank_source as text, "
    + s.case([(s.words("lower(text)", ws), q(n)) for n, ws in v.SHEET_MARKERS.items()], "null")
    + " as issuer from (select distinct memo, bank_source from ledger)",
)
def b3s(t):
    d = t.ledger.select(F.concat_ws(" ", "memo", "bank_source").alias("text")).distinct()
    return d.select("text", ps.issuer_from_sheet("text").alias("issuer"))


FLIP = f"coalesce({NAME_SQL}, '') in ('American Express', 'Apple Card', 'Citi', 'Discover', 'Synchrony Bank', 'Barclays')"


@query(
    "b4_normalize_sign",
    f"with {FILES} select transaction_id, (case when {FLIP} and not is_pending then -amount else amount end)::double as amount from fl",
)
def b4(t):
    a = F.abs(F.col("cents"))
    f = t.ledger.withColumn("file_name", _choose(NAMES, a % 8))
    return f.select("transaction_id", ps.normalize_sign("amount", ps.issuer_from_file_name("file_name"), F.col("is_pending")).alias("amount"))


@query(
    "b5_row_filters",
    f"""select text, case when {s.words('lower(text)', v.FEE_KEYWORDS)} then 'financing_fee' when {s.words('lower(text)', v.STATEMENT_SUMMARY_KEYWORDS)} then 'statement_summary' end as exclusion,
 {' or '.join(s.has('lower(text)', p) for p in v.STATEMENT_CREDIT_FORMS)} as is_credit, {s.words('lower(text)', v.NON_TRANSACTION_PHRASES)} as is_noise,
 {s.words('lower(text)', v.SUMMARY_KEYWORDS)} or {s.has('lower(text)', '(?i)' + v.PAYMENT_SUMMARY_PATTERN)} as is_summary, {s.words('lower(text)', v.LAYOUT_SKIP_SECTIONS)} as is_layout_noise
 from (select text from {BOTH} union select 'Late Fee ' || memo from ledger union select 'New Balance ' || description from ledger union select 'Total Payments' || substr(memo, 1, 3) from ledger)""",
)
def b5(t):
    more = t.ledger.select(F.explode(F.array(
        F.concat(F.lit("Late Fee "), "memo"), F.concat(F.lit("New Balance "), "description"), F.concat(F.lit("Total Payments"), F.substring("memo", 1, 3)))).alias("text"))
    texts = both_texts(t).unionByName(more).distinct()
    return texts.select(
        "text", ps.exclusion_of("text").alias("exclusion"), ps.is_statement_credit("text").alias("is_credit"), ps.is_non_transaction("text").alias("is_noise"),
        ps.is_summary_row(F.lower("text"), F.lit(1)).alias("is_summary"), ps.is_layout_noise("text").alias("is_layout_noise"))


@query(
    "b6_pending_status",
    "select status, contains(lower(coalesce(status, 'posted')), 'pending') as is_pending, count(*) as n from (select case cents % 4 when 0 then null when 1 then 'Posted' when 2 then 'PENDING auth' else 'cleared' end as status from ledger) group by 1, 2",
)
def b6(t):
    status = F.expr("case cents % 4 when 0 then null when 1 then 'Posted' when 2 then 'PENDING auth' else 'cleared' end")
    return t.ledger.select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("is_pending", ps.is_pending_status("status"))


@query(
    "b8_account_label",
    f"""with {FILES} select file_name, bank_source, count(*) as n, bank_source || coalesce(' ' || coalesce(nullif(regexp_extract(regexp_replace(file_name, '\\.[^.]*$', ''),
 '(?i)' || regexp_replace(bank_source, ' ', '', 'g') || '[ _-]?(\\d{{3,6}})', 1), ''), list_filter(regexp_extract_all(regexp_replace(file_name, '\\.[^.]*$', ''), '\\d{{3,}}'), lambda r: length(r) <> 8)[1]), '') as label
 from (select file_name, case when cents % 3 = 0 then 'Chase' else bank_source end as bank_source from fl) group by all""",
)
def b8(t):
    a = F.abs(F.col("cents"))
    f = t.ledger.select(_choose(NAMES, a % 8).alias("file_name"), F.expr("case when cents % 3 = 0 then 'Chase' else bank_source end").alias("bank_source"))
    g = f.groupBy("file_name", "bank_source").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("label", ps.account_label("file_name", "bank_source"))


CARDS = """select 'd' || doc_id as id, text || ' card ' || (4000000000000000 + doc_id * 7919) || ' or 4' || lpad('' || (doc_id % 1000), 3, '0') || '-1234-5678-9012 xxxx' || lpad('' || (doc_id % 10000), 4, '0') || ' call 555-123-4567' as text from documents
 union all select 'c' || conv_id || '-' || turn, text from conversations"""


@query("b9_mask_accounts", f"select id, masked from (select id, {s.mask_cols('text')} from ({CARDS}))")
def b9(t):
    t.documents.createOrReplaceTempView("documents")
    t.conversations.createOrReplaceTempView("conversations")
    return t.spark.sql(CARDS).select("id", ps.mask_accounts("text").alias("masked"))


RAWCATS = ["Food & Drink", "Gas", "Restaurant-Restaurant", "Travel-Lodging", "Pets", " Groceries ", "Nonsense", "", "Fees & Adjustments"]
RAWCAT_CASE = "case (abs(cents) % 9) " + " ".join(f"when {i} then {q(n)}" for i, n in enumerate(RAWCATS)) + " end"
CANON_SQL = s.case([(f"trim(raw) = {q(k)}", q(c)) for k, c in v.ISSUER_CATEGORY_MAP.items()] + [(f"trim(raw) in ({', '.join(map(q, v.CANONICAL_CATEGORIES))})", "trim(raw)")], "'Other'")


@query("b10_canonical_category", f"select raw, {CANON_SQL} as category, count(*) as n from (select {RAWCAT_CASE} as raw from ledger) group by 1, 2")
def b10(t):
    raw = t.ledger.select(_choose(RAWCATS, F.abs(F.col("cents")) % 9).alias("raw"))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).withColumn("category", ps.canonical_category("raw"))


EMAIL = """select c_custkey, case c_custkey % 5 when 0 then lower(replace(c_name, '#', '.')) || '@gmial.com' when 1 then c_name || '@example.org'
 when 2 then c_name || ' @x.y' when 3 then c_name || '@outlok.com' else c_name end as email from customer"""


@query(
    "b12_email_check",
    f"""select c_custkey, email, regexp_matches(email, {q(ps.EMAIL_SHAPE)}) as is_valid,
 {s.case([(f"split_part(email, '@', 2) = {q(k)}", f"split_part(email, '@', 1) || {q('@' + d)}") for k, d in ps.DOMAIN_TYPOS.items()], 'null')} as suggestion from ({EMAIL})""",
)
def b12(t):
    t.customer.createOrReplaceTempView("customer")
    return t.spark.sql(EMAIL).select("c_custkey", "email", ps.is_email("email").alias("is_valid"), ps.email_suggestion("email").alias("suggestion"))


PTYPE = "case abs(cents) % 6 when 0 then 'refund' when 1 then 'card_credit' when 2 then 'credit_card_payment' when 3 then 'loan_payment' end"


@query(
    "b13_sign_by_parser_type",
    f"""with {FILES} select transaction_id, {PTYPE} as parser_type, (case when parser_type in ('refund', 'card_credit') then abs(amount)
 when parser_type in ('credit_card_payment', 'loan_payment') then -abs(amount) when {FLIP} then -amount else amount end)::double as amount from fl""",
)
def b13(t):
    f = t.ledger.withColumn("file_name", _choose(NAMES, F.abs(F.col("cents")) % 8)).withColumn("parser_type", F.expr(PTYPE))
    return f.select("transaction_id", "parser_type", ps.sign_by_parser_type("amount", "parser_type", ps.issuer_from_file_name("file_name")).alias("amount"))


@query(
    "b14_direction_amount",
    """select transaction_id, (case when cents > 0 then abs(amount) else -abs(amount) end)::double as amount,
 case when cents <= 0 then 'expense' when contains(lower(memo), 'refund') or contains(lower(memo), 'return') then 'refund' else 'card_credit' end as transaction_type from ledger""",
)
def b14(t):
    d = t.ledger.withColumn("direction", F.when(F.col("cents") > 0, "credit").otherwise("debit"))
    return d.select("transaction_id", ps.direction_amount(F.abs("amount"), "direction").alias("amount"), ps.direction_type("memo", "direction").alias("transaction_type"))


@query(
    "b15_extraction_json",
    """select account_name || '|' || ym as stmt_id, bank_source as bank_name, '' || transaction_date as date, description, abs(amount)::double as amount,
 case when cents > 0 then 'credit' else 'debit' end as direction, category from ledger""",
)
def b15(t):
    """One fenced JSON text per ledger row, parsed back and exploded."""
    tx = F.struct(
        F.col("transaction_date").cast("string").alias("date"), F.col("description"), F.abs("amount").alias("amount"),
        F.when(F.col("cents") > 0, "credit").otherwise("debit").alias("direction"), F.col("category"))
    doc = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("bank_source").alias("bank_name"), F.array(tx).alias("transactions"))), F.lit("\n```"))
    d = t.ledger.select(F.concat_ws("|", "account_name", "ym").alias("stmt_id"), doc.alias("raw")).withColumn("x", ps.parse_extraction("raw"))
    return d.select("stmt_id", "x.bank_name", F.explode("x.transactions").alias("t")).select("stmt_id", "bank_name", "t.date", "t.description", "t.amount", "t.direction", "t.category")


# ---------------------------------------------------------------- classification

PROF = s.profile_ctes("select memo as description from ledger")
NORULE = "null::bigint as rule_id, null::varchar as rule_type, null::varchar as rule_category, null::varchar as rule_confidence"


@query(
    "d1_transaction_type",
    f"""with {PROF}, x as (select transaction_id, bank_source, cents, case when cents > 0 then rule_in else rule_out end as rl from ledger join prof on memo = prof.description)
select transaction_id, {s.typed('rl', 'cents > 0', 'bank_source')[0]} as transaction_type, {s.typed('rl', 'cents > 0', 'bank_source')[1]} as reason from x""",
)
def d1(t):
    texts = C.distinct_texts(t.ledger, "memo", "memo").withColumn("cleaned", mt.clean_description("memo"))
    texts = texts.select("memo", cl._type_rules(F.col("cleaned"), True).alias("rule_in"), cl._type_rules(F.col("cleaned"), False).alias("rule_out"))
    x = t.ledger.join(texts, "memo").withColumn("r", cl.resolve_type("rule_in", "rule_out", "amount", "bank_source"))
    return x.select("transaction_id", F.col("r.type").alias("transaction_type"), F.col("r.reason").alias("reason"))


@query(
    "d2_category_scores",
    f"""with {PROF} select p.description, c.category, sum(c.score)::bigint as score, min(c.i)::bigint as first_pattern from prof p,
 (values {', '.join(f"({i}, {sc}, {q(c)})" for i, (_, sc, c) in enumerate(v.CATEGORY_PATTERNS))}) c(i, score, category) where list_contains(p.hits, c.i) group by 1, 2""",
)
def d2(t):
    prof = cl.text_profile(t.ledger, "memo").select("description", F.explode_outer("scores").alias("s")).filter("s is not null")
    return prof.select("description", "s.category", "s.score", F.col("s.ord").alias("first_pattern"))


@query("d3_adjusted_scores", f"with {PROF} select description, r.c as category, (-r.n)::bigint as score from (select description, unnest(ranked) as r from prof)")
def d3(t):
    prof = cl.text_profile(t.ledger, "memo").select("description", F.explode_outer("adjusted").alias("s")).filter("s is not null")
    return prof.select("description", "s.category", "s.score")


@query(
    "d4_category_verdict",
    f"with {PROF} select description, best_category as category, best_confidence as confidence, best_review as needs_review, best_reason as reason from prof",
)
def d4(t):
    return cl.text_profile(t.ledger, "memo").select(
        "description", F.col("best_category").alias("category"), F.col("best_confidence").alias("confidence"), F.col("best_review").alias("needs_review"), F.col("best_reason").alias("reason"))


# One rule per part and match type; every fifth belongs to everyone.
RULES = """select p_partkey as id, case when p_partkey % 5 = 0 then null else 'u' || lpad('' || (p_partkey % 25), 2, '0') end as user_id,
 case when p_partkey % 7 = 0 then 'description' else 'merchant' end as match_field,
 case p_partkey % 4 when 0 then p_name when 1 then substr(p_name, 1, 6) when 2 then substr(p_name, 3, 5) else case when p_partkey % 8 = 3 then '^' || substr(p_name, 1, 4) || '.*t' else '(' || substr(p_name, 2, 4) || '|' || substr(p_name, 4, 5) || ').*t' end end as match_value,
 case p_partkey % 4 when 0 then 'exact' when 1 then 'starts_with' when 2 then 'contains' else 'regex' end as match_type,
 'expense' as transaction_type, 'Cat ' || p_brand as category, cast(p_size as bigint) as priority, p_size / 50.0e0 as confidence_override, p_partkey % 11 <> 0 as is_active from part"""
# Equal pieces of rule and text first: the whole value, a start, any substring; the plain start or alternatives of a pattern, then the pattern.
MATCHED = f"""rules as materialized (select *, match_type as how, case match_type when 'regex' then lower(substr(match_value, 2, 4)) else lower(match_value) end as piece from ({RULES}) where is_active and match_value not like '(%'
  union all select *, 'contains' as how, lower(unnest(string_split(substr(match_value, 2, position(')' in match_value) - 2), '|'))) as piece from ({RULES}) where is_active and match_value like '(%'),
 tg as materialized (select description, 'merchant' as f, merchant as target from prof union all select description, 'description', cleaned from prof),
 sizes as (select distinct how as match_type, length(piece) as n from rules),
 keyed as (select description, f, target, 'exact' as match_type, target as piece from tg
  union all select description, f, target, match_type, substr(target, 1, n) from tg cross join sizes where match_type in ('starts_with', 'regex')
  union all select distinct description, f, target, match_type, substr(target, i, n) from (select *, unnest(range(1, length(target) - n + 2)) as i from tg cross join sizes where match_type = 'contains')),
 hit as (select r.id, r.user_id as rule_user, r.category as rule_category, case when confidence_override >= 0.8 then 'high' else 'medium' end as rule_confidence, k.description,
  row_number() over (partition by r.user_id, k.description order by priority desc, case r.match_type when 'exact' then 0 when 'starts_with' then 1 when 'contains' then 2 else 3 end, id) as rn
  from rules r join keyed k on k.f = r.match_field and k.match_type = r.how and k.piece = r.piece where r.match_type <> 'regex' or regexp_matches(k.target, '(?i)' || lower(match_value))),
 best as (select * from hit where rn = 1)"""


def merchant_rules(t):
    t.part.createOrReplaceTempView("part")
    return t.spark.sql(RULES)


@query(
    "d5_rule_matching",
    f"""with {PROF}, {MATCHED} select transaction_id, coalesce(o.id, g.id) as rule_id, case when o.id is not null then 'user' else 'global' end as scope, coalesce(o.rule_category, g.rule_category) as category,
 coalesce(o.rule_confidence, g.rule_confidence) as confidence from ledger l left join best o on o.rule_user = l.user_id and o.description = memo left join best g on g.rule_user is null and g.description = memo
 where coalesce(o.id, g.id) is not null""",
)
def d5(t):
    pairs = cl.user_texts(t.ledger, "memo")
    rows = cl.with_best_rule(t.ledger, cl.named_texts(pairs), merchant_rules(t), "memo", pairs).filter("best is not null")
    return rows.select("transaction_id", "best.rule_id", F.col("rule_scope").alias("scope"), F.col("best.rule_category").alias("category"), F.col("best.rule_confidence").alias("confidence"))


@query(
    "d6_classification",
    f"""with {PROF}, {MATCHED}, x as (select l.transaction_id, l.bank_source, l.cents, p.*, coalesce(o.id, g.id) as rule_id, 'expense' as rule_type, coalesce(o.rule_category, g.rule_category) as rule_category,
 coalesce(o.rule_confidence, g.rule_confidence) as rule_confidence from ledger l join prof p on p.description = memo left join best o on o.rule_user = l.user_id and o.description = memo
 left join best g on g.rule_user is null and g.description = memo), y as (select *, {s.decided()} from x)
select transaction_id, o_type as transaction_type, o_category as category, o_confidence as confidence, o_review as needs_review, o_reason as review_reason, o_hint as recurring_hint from y""",
)
def d6(t):
    return cl.classify(t.ledger, merchant_rules(t), "memo").select("transaction_id", *cl.RESULT)


@query("d7_recurring_hint", f"select category, category in ({', '.join(map(q, v.RECURRING_HINT_CATEGORIES))}) as is_recurring, count(*) as n from ledger group by 1")
def d7(t):
    return t.ledger.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("is_recurring", sg.is_recurring_hint("category"))


@query("d8_outside_spending", f"select transaction_type, transaction_type in ({', '.join(map(q, sg.NON_SPENDING_TYPES))}) as is_outside, count(*) as n from ledger group by 1")
def d8(t):
    return t.ledger.groupBy("transaction_type").agg(F.count(F.lit(1)).alias("n")).withColumn("is_outside", sg.is_outside_spending("transaction_type"))


CATSIG = f"""case when lower(trim(x)) in ({', '.join(map(q, v.FIXED_CATEGORIES))}) then 'fixed' when lower(trim(x)) in ({', '.join(map(q, v.SEMI_FIXED_CATEGORIES))}) then 'fixed'
 when lower(trim(x)) in ({', '.join(map(q, v.VARIABLE_CATEGORIES))}) then 'variable' else 'unknown' end"""
CATCONF = f"""case when lower(trim(x)) in ({', '.join(map(q, v.FIXED_CATEGORIES))}) then 85 when lower(trim(x)) in ({', '.join(map(q, v.SEMI_FIXED_CATEGORIES))}) then 75
 when lower(trim(x)) in ({', '.join(map(q, v.VARIABLE_CATEGORIES))}) then 85 else 0 end"""
WIDE_CATS = "case abs(cents) % 7 when 0 then 'Gas' when 1 then 'Parking' when 2 then ' Water ' when 3 then 'Hobbies' when 4 then 'Unheard' else category end"


@query("d9_category_signal", f"select x as category, {CATSIG} as label, {CATCONF}::bigint as confidence, count(*) as n from (select {WIDE_CATS} as x from ledger) group by 1")
def d9(t):
    c = t.ledger.select(F.expr(WIDE_CATS).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("s", sg.category_signal("category"))
    return c.select("category", F.col("s.label").alias("label"), F.col("s.conf").alias("confidence"), "n")


KEYFIXED = "(" + " or ".join(s.has("lower(x)", p) for p in v.KEYWORD_FIXED_PATTERNS) + ")"
HARDFIXED = f"lower(trim(category)) in ({', '.join(map(q, v.HARD_FIXED_CATEGORIES))})"


@query("d10_fixed_overrides", f"select x as text, category, {KEYFIXED} as by_keyword, {HARDFIXED} as by_category, count(*) as n from (select memo as x, category from ledger) group by 1, 2")
def d10(t):
    g = t.ledger.groupBy(F.col("memo").alias("text"), "category").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumns({"by_keyword": sg.is_keyword_fixed("text"), "by_category": sg.is_hard_fixed("category")})


def sd(n, tot, sq):
    return f"case when {n} > 1 then sqrt(({n} * {sq} - {tot} * {tot})::double / ({n} * ({n} - 1))::double) end"


EXPENSES = f"""k8 as (select description, substr({s.recurrence_key('description')}, 1, 8) as key8 from (select distinct description from ledger)),
 ex as (select l.*, key8, -cents as spent, substr(ym, 1, 4)::int * 12 + substr(ym, 6, 2)::int as idx from ledger l join k8 using (description) where {SPEND})"""
RECUR = f"""{EXPENSES}, tm as (select user_id, count(distinct ym) as total_months, count(*) as a_n, sum(spent)::double / count(*) as a_mean,
 {sd('count(*)', 'sum(spent)', 'sum((spent * spent)::hugeint)')} as a_sd from ex group by 1),
 pk as (select user_id, key8, count(distinct ym) as present, count(*) as n, sum(spent) as total, sum((spent * spent)::hugeint) as sq, max(idx) - min(idx) as span from ex where key8 <> '' group by 1, 2),
 rv as (select pk.*, total_months, case when n < 2 then 0.0 when total > 0 then {sd('n', 'total', 'sq')} / (total::double / n) else 1.0 end as variation from pk join tm using (user_id)),
 rs as (select *, total_months < 2 or present < 2 as sparse, case when sparse and n = 1 and total >= 20000 and total % 5000 = 0 then 'fixed' when sparse then 'unknown'
  when total_months >= 3 and span * 2 between (present - 1) * 5 and (present - 1) * 7 then 'fixed' when total_months >= 3 and span * 2 between (present - 1) * 11 and (present - 1) * 13 then 'fixed'
  when total_months >= 3 and span * 2 between (present - 1) * 22 and (present - 1) * 26 then 'fixed' when present * 5 >= total_months * 3 then 'fixed' else 'variable' end as rec_label,
  case when sparse and n = 1 and total >= 20000 and total % 5000 = 0 then 65 when sparse then 0
  when total_months >= 3 and span * 2 between (present - 1) * 5 and (present - 1) * 7 then 80 when total_months >= 3 and span * 2 between (present - 1) * 11 and (present - 1) * 13 then 75
  when total_months >= 3 and span * 2 between (present - 1) * 22 and (present - 1) * 26 then 75 when present * 5 >= total_months * 4 and variation < 0.05 then 95
  when present * 5 >= total_months * 4 and variation < 0.25 then 80 else 65 end as rec_conf from rv)"""


@query("d11_recurrence_signal", f"with {RECUR} select user_id, key8, present, total_months, n, variation::double as variation, rec_label, rec_conf::bigint as rec_conf from rs")
def d11(t):
    return rec.recurrence_signals(t.ledger)


AMT = """case when spent = 0 then 'unknown' when a_n >= 3 and a_sd > 0 and spent > a_mean + a_sd * 2.5 then 'irregular' when spent >= 10000 and spent % 5000 = 0 then 'fixed' when spent >= 5000 and spent % 2500 = 0 then 'fixed' else 'unknown' end as amt_label,
 case when spent = 0 then 0 when a_n >= 3 and a_sd > 0 and spent > a_mean + a_sd * 2.5 then 80 when spent >= 10000 and spent % 5000 = 0 then 60 when spent >= 5000 and spent % 2500 = 0 then 55 else 0 end as amt_conf"""


@query("d12_amount_signal", f"with {RECUR} select transaction_id, {AMT.replace(' as amt_conf', '::bigint as amt_conf').replace('end::bigint', 'end::bigint')} from ex join tm using (user_id)")
def d12(t):
    return rec.with_amount_signal(t.ledger).select("transaction_id", F.col("amt.label").alias("amt_label"), F.col("amt.conf").alias("amt_conf"))


CONFIRMED = "select user_id, key8, bool_or(cents % 2 = 0) as is_fixed from ex where needs_review and cents % 97 = 0 group by 1, 2"


def fixed_sql(confirmed: bool) -> str:
    dec = f"left join ({CONFIRMED}) cf using (user_id, key8)" if confirmed else "left join (select null::varchar as user_id, null::varchar as key8, null::boolean as is_fixed) cf using (user_id, key8)"
    return f"""with {RECUR}, z as (select ex.* exclude (is_fixed), a_n, a_mean, a_sd, {AMT}, rec_label, coalesce(rec_conf, 0) as rc, cf.is_fixed as decision, category as x from ex join tm using (user_id) left join rs using (user_id, key8) {dec}),
 y as (select *, {CATSIG} as cat_label, {CATCONF} as cat_conf, rc > 0 and coalesce(rec_label = 'fixed', false) as rf,
  case when cat_label = 'fixed' and rf then cat_conf / 100.0e0 * 0.6e0 + rc / 100.0e0 * 0.4e0 when cat_label = 'fixed' then cat_conf / 100.0e0 else 0.0e0 end as bycat,
  case when rf then rc / 100.0e0 * 0.7e0 else 0.0e0 end as rp, amt_conf / 100.0e0 * 0.3e0 as ap,
  case when rc > 0 and amt_conf > 0 then rp + ap when rc > 0 then rp / 0.7e0 when amt_conf > 0 then ap / 0.3e0 else 0.0e0 end as bysig,
  case when decision is not null then 1.0e0 when {KEYFIXED.replace('lower(x)', 'lower(description)')} or {HARDFIXED} then 0.95e0 when amt_label = 'irregular' then 0.8e0 when cat_conf >= 85 then bycat else bysig end as score,
  case when decision is not null then 'user_confirmed' when {KEYFIXED.replace('lower(x)', 'lower(description)')} then 'keyword_override' when {HARDFIXED} then 'category_override' when amt_label = 'irregular' then 'amount_pattern'
   when cat_conf >= 85 then 'category_rule' when rc = 0 and amt_conf = 0 then 'none' when rc > 0 then 'recurrence' else 'amount_pattern' end as source,
  case when decision is not null then decision when source = 'amount_pattern' and amt_label = 'irregular' then false else score >= 0.75 end as yes from y0)
 select user_id, transaction_id, key8, yes as is_fixed, (round_even(score, 2))::double as confidence, source, case when source = 'amount_pattern' and amt_label = 'irregular' then 'irregular' when yes then 'fixed' else 'variable' end as label from y""".replace("from y0)", "from z)")


@query("d13_fixed_or_variable", fixed_sql(False))
def d13(t):
    return rec.fixed_or_variable(t.ledger)


@query("d14_fixed_with_confirmations", fixed_sql(True))
def d14(t):
    ex = rec.keyed_expenses(t.ledger).filter("needs_review and cents % 97 = 0")
    confirmed = ex.groupBy("user_id", "key8").agg(F.bool_or(F.expr("cents % 2 = 0")).alias("is_fixed"))
    return rec.fixed_or_variable(t.ledger, confirmed)


def subs_sql(x: str, ws) -> str:
    return f"(lower(category) in ('subscription', 'subscriptions', 'streaming') or {s.words(f'lower({x})', ws)})"


@query(
    "d15_subscription_flag",
    f"select memo as text, category, {subs_sql('memo', v.SUBSCRIPTION_KEYWORDS)} as is_subscription, {subs_sql('memo', v.INSIGHT_SUBSCRIPTION_KEYWORDS)} as is_insight_subscription, count(*) as n from ledger group by 1, 2",
)
def d15(t):
    g = t.ledger.groupBy(F.col("memo").alias("text"), "category").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumns({"is_subscription": sg.is_subscription("category", "text"), "is_insight_subscription": sg.is_subscription("category", "text", v.INSIGHT_SUBSCRIPTION_KEYWORDS)})


@query(
    "d17_client_flags",
    f"""select transaction_id, transaction_type = 'card_credit' or ({s.words('lower(memo)', agg.CARD_CREDIT_PHRASES)} and cents > 0) as is_card_credit,
 is_fixed or lower(category) in {tuple(agg.CLIENT_FIXED_CATEGORIES)} as is_client_fixed,
 transaction_type in ('credit_card_payment', 'loan_payment') or {s.words('lower(memo)', sg.AUTO_EXCLUDED_WORDS)} as is_auto_excluded from ledger""",
)
def d17(t):
    rows = t.ledger.drop("description").withColumnRenamed("memo", "description")
    return rows.select("transaction_id", agg.is_card_credit().alias("is_card_credit"), agg.is_client_fixed().alias("is_client_fixed"), sg.is_auto_excluded("transaction_type", "description").alias("is_auto_excluded"))


@query(
    "d18_card_only_users",
    f"""with l as (select *, case when user_id < 'u12' then 'Citi ' || bank_source else bank_source end as src from ledger),
 f as (select user_id, bool_and({s.words('lower(src)', sg.CARD_SOURCE_WORDS)}) as all_cards, bool_or({s.words('lower(description)', sg.HOUSING_WORDS)}) as has_housing from l group by 1)
select *, all_cards and not has_housing as card_only from f""",
)
def d18(t):
    return agg.card_only_users(t.ledger.withColumn("bank_source", F.expr("case when user_id < 'u12' then 'Citi ' || bank_source else bank_source end")))


# ---------------------------------------------------------------- fixed and subscription summaries

def fixedsum(by: str = "user_id") -> str:
    return f"""fk as (select description, {s.dedup_cols('description')} from (select distinct description from ledger)),
 fg as (select {by}, dk, count(*) as n, sum(abs(cents)) as total, sum((cents * cents)::hugeint) as sq, arg_max(description, (-length(description), seq)) as raw
  from ledger join fk using (description) where {LIVE} and is_fixed group by {by}, dk),
 fixsum as (select {by}, dk, merchant, {m('total')} as amount, {m(rr('total', 'n'))} as avg, total, n > 1 and total > 0 and coalesce({sd('n', 'total', 'sq')} / (total::double / n) > 0.05, false) as varies, n as occurrences
  from (select *, {s.group_name_cols('raw')} from fg))"""


FIXEDSUM = fixedsum()


@query("g7_fixed_summary", f"with {FIXEDSUM} select * exclude (total) from fixsum")
def g7(t):
    return rec.fixed_summary(t.ledger)


@query("f8_newly_recurring", f"with {fixedsum('user_id, ym')} select f.* exclude (total) from fixsum f where occurrences = 2")
def f8(t):
    return rec.newly_recurring(t.ledger)


SUBSUM = f"""sk as (select description, {s.dedup_cols('description')} from (select distinct description from ledger)),
 sgp as (select user_id, dk, {rr('sum(-cents)', 'count(*)')} as avg, arg_max(trim(description), (-length(trim(description)), seq)) as raw from ledger join sk using (description) where {LIVE} and {subs_sql('description', v.SUBSCRIPTION_KEYWORDS)} group by 1, 2),
 subsum as (select user_id, dk, array_to_string({s.toks(title('raw'))}[1:2], ' ') as name, avg from sgp)"""


@query(
    "g8_subscription_summary",
    f"with {SUBSUM} select user_id, dk, name, {m('avg')} as amount, count(*) over (partition by user_id) as subscription_count, {m('sum(avg) over (partition by user_id)')} as total from subsum",
)
def g8(t):
    return rec.subscription_summary(t.ledger)
