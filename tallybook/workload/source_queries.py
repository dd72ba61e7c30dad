"""Statement sources: the ledger is printed as files, words or lines and parsed back; the reference is the ledger itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybook.functions import fixed_values as v
from tallybook.sources import delimited as dl
from tallybook.sources import files as fl
from tallybook.sources import layout as lo
from tallybook.sources import ranges as rg
from tallybook.sources.ofx import parse_ofx
from tallybook.sources.sinks import scratch_path, stored
from tallybook.workload import sqltext as s
from tallybook.workload.registry import query

q = s.q
DOC = "account_name || '|' || ym"


def frame(t, text: str):
    t.ledger.createOrReplaceTempView("ledger")
    return t.spark.sql(text)


# ---------------------------------------------------------------- files and delimited text

BODIES = ["%PDF-1.7 x", "PK34 zip", "Date,Amount", "a;b, c", "OFXHEADER:100", "<OFX><X>", "plain words", "no comma"]
NAMES = ["a.csv", "b.bin", "c.txt", "d", "e.txt", "f.dat", "g.QFX", "h.doc"]
KINDS = ["pdf", "xlsx", "csv", "csv", "ofx", "ofx", "qfx", "unknown"]
pick = lambda xs: "case abs(cents) % 8 " + " ".join(f"when {i} then {q(x)}" for i, x in enumerate(xs)) + " end"


@query("a1_file_routing", f"select transaction_id, {pick(KINDS)} as kind from ledger")
def a1(t):
    f = t.ledger.select("transaction_id", F.encode(F.expr(pick(BODIES)), "UTF-8").alias("content"), F.expr(pick(NAMES)).alias("name"))
    return f.select("transaction_id", fl.file_type("content", "name").alias("kind"))


PATH = "case when bank_source = 'BUILDING' then 'discover_' else 'export_' end || account_name || '_' || ym || '.csv'"
HEADS = {
    "0": ["Transaction Date,Description,Category,Amount"],
    "1": ["Date,Description,Debit,Credit"],
    "2": ["Description,,Summary Amt.", 'Beginning balance as of 01/01/2000,,"1,000.00"', "Date,Description,Amount,Running Bal.,Status"],
}
# Text of a printed row: quoted description with a comma, amounts with separators, sign as the issuer prints it.
PRINTED = f"""select {PATH} as path, right(account_name, 1) as layout, date_format(transaction_date, 'MM/dd/yyyy') as d, '"' || description || ', INC"' as x, category,
 format_number(case when bank_source = 'BUILDING' then -amount else amount end, 2) as a, format_number(abs(amount), 2) as b, cents, is_pending from ledger"""
ROW = """case layout when '0' then concat_ws(',', d, x, category, '"' || a || '"') when '1' then concat_ws(',', d, x, case when cents < 0 then '"' || b || '"' else '' end, case when cents > 0 then '"' || b || '"' else '' end)
 else concat_ws(',', d, x, '"' || a || '"', '0.00', case when is_pending then 'Pending' else 'Posted' end) end"""


def csv_lines(t):
    rows = frame(t, PRINTED)
    data = rows.select("path", F.lit(100).alias("line_no"), F.expr(ROW).alias("line"))
    heads = F.create_map(*[x for k, ls in HEADS.items() for x in (F.lit(k), F.array(*[F.lit(line) for line in ls]))])
    top = rows.select("path", "layout").distinct().select("path", F.posexplode(F.element_at(heads, F.col("layout"))).alias("line_no", "line"))
    return top.unionByName(data)


@query(
    "a2_header_row",
    f"select distinct {PATH} as path, (case right(account_name, 1) when '2' then 2 else 0 end)::bigint as header_no from ledger",
)
def a2(t):
    return dl.headers(csv_lines(t)).select("path", "header_no")


ROLES = {"0": "date|description|raw_category|amount", "1": "date|description|debit|credit", "2": "date|description|amount||status"}


@query(
    "a3_column_roles",
    f"select distinct {PATH} as path, case right(account_name, 1) " + " ".join(f"when '{k}' then '{r}'" for k, r in ROLES.items()) + " end as roles from ledger",
)
def a3(t):
    return dl.headers(csv_lines(t)).select("path", F.array_join("roles", "|").alias("roles"))


@query(
    "a4_delimited_rows",
    f"""select {PATH} as path, case when bank_source = 'BUILDING' then 'Discover' else 'Unknown Bank' end as bank_source, '' || transaction_date as transaction_date, description || ', INC' as description, amount::double as amount,
 case when right(account_name, 1) = '0' then category else '' end as raw_category, is_pending and right(account_name, 1) = '2' as is_pending from ledger""",
)
def a4(t):
    """The lines are written once, as they are read three times."""
    return dl.parse_delimited(stored(csv_lines(t), "csv-lines")).select("path", "bank_source", "transaction_date", "description", "amount", "raw_category", "is_pending")


# One quoted text with a line break, stray quotes inside an unquoted one.
BROKEN = """transaction_id || ',"' || description || '\n""' || category || '"", INC",5" ' || abs(cents) || ' "x'"""


@query(
    "a4_lines_by_range",
    """select transaction_id, description || ' "' || category || '", INC' as text, '5" ' || abs(cents) || ' "x' as rest, 3::bigint as n_cells from ledger where category is not null""",
)
def a4_lines(t):
    """Text files written from the ledger and read back in byte ranges."""
    path = scratch_path(t.spark, "delimited")
    t.ledger.filter("category is not null").select(F.expr(BROKEN).alias("value")).write.text(path)
    cells = dl.cells("line")
    return rg.text_lines(t.spark, path).select(cells[0].alias("transaction_id"), cells[1].alias("text"), cells[2].alias("rest"), F.size(cells).alias("n_cells"))


FIDS = ["10898", "3101", "815", "", "1176"]
OFX_BANKS = ["Chase", "American Express", "Discover", "Wells Fargo", "Bank of America"]
TYPES = list(v.OFX_TYPES)
five = lambda xs: "case abs(cents) % 5 " + " ".join(f"when {i} then {q(x)}" for i, x in enumerate(xs)) + " end"
kinds = lambda xs: f"case abs(cents) % {len(TYPES) + 1} " + " ".join(f"when {i} then {q(x)}" for i, x in enumerate(xs)) + " else 'unknown' end"


@query(
    "a5_ofx_transactions",
    f"""select transaction_id as path, {five(OFX_BANKS)} as bank_source, '' || transaction_date as transaction_date, memo as description, (case when abs(cents) % 5 in (1, 2) then -amount else amount end)::double as amount,
 {kinds(v.OFX_TYPES.values())} as type_hint, 'OFX-' || transaction_id as ext_id from ledger""",
)
def a5(t):
    block = f"""'<STMTTRN><TRNTYPE>' || upper({kinds(TYPES)}) || '\n<DTPOSTED>' || date_format(transaction_date, 'yyyyMMdd') || '120000\n<TRNAMT>' || amount || '\n<FITID>OFX-' || transaction_id || '\n<NAME>' || memo || '\n</STMTTRN>'"""
    zero = "'<STMTTRN><TRNTYPE>FEE\n<DTPOSTED>20010101\n<TRNAMT>0.00\n<FITID>z\n<NAME>nothing\n</STMTTRN>'"
    bal = "'<STMTTRN><TRNTYPE>FEE\n<DTPOSTED>20010101\n<TRNAMT>5.00\n<FITID>y\n<NAME>Ending Balance\n</STMTTRN>'"
    text = f"'OFXHEADER:100\n<OFX><FI><ORG>Wells Fargo NA\n<FID>' || {five(FIDS)} || '\n</FI>' || {zero} || {block} || {bal} || '</OFX>'"
    f = t.ledger.select(F.col("transaction_id").alias("path"), F.expr(text).alias("text"))
    return parse_ofx(f).select("path", "bank_source", "transaction_date", "description", "amount", "type_hint", "ext_id")


@query(
    "a6_toll_rows",
    f"""select {DOC} as path, '' || transaction_date as transaction_date, case when cents % 9 = 0 then 'Toll - Toll' else 'Toll - ' || description end as description, amount::double as amount, transaction_id as ext_id from ledger where cents % 2 = 0""",
)
def a6(t):
    rows = frame(t, f"""select {DOC} as path, case when cents % 2 = 0 then ' toll' else 'PAYMENT' end as transaction_type, case abs(cents) % 3 when 0 then date_format(transaction_date, 'MM/dd/yyyy') || ' 10:20:30' when 1 then date_format(transaction_date, 'MM/dd/yyyy')
 else '' || transaction_date end as exit_time, case when cents % 9 = 0 then 'nan' else description end as location, '$' || amount as amount, transaction_id from ledger""")
    return dl.parse_toll(rows)


@query(
    "a7_sheet_rows",
    f"""select {DOC} as path, case when bank_source = 'BUILDING' then 'Discover' else 'Unknown Bank' end as bank_source, '' || transaction_date as transaction_date, description, amount::double as amount from ledger
 where right(account_name, 1) <> '1' or cents < 0""",
)
def a7(t):
    """Exports with debit and credit columns keep only their debits: the alias 'cr' also sits in 'Description'."""
    rows = frame(t, f"""select {DOC} as path, bank_source, right(account_name, 1) as layout, 100 as row_no, case when right(account_name, 1) = '1' then array('' || transaction_date, description, case when cents < 0 then '' || abs(amount) else '' end, case when cents > 0 then '' || amount else '' end)
 else array(date_format(transaction_date, 'MM/dd/yyyy'), description, '$' || case when bank_source = 'BUILDING' then -amount else amount end) end as cells from ledger""")
    tops = rows.select("path", "bank_source", "layout").distinct()
    first = tops.select("path", F.lit(0).alias("row_no"), F.array(F.expr("case when bank_source = 'BUILDING' then 'Discover it' else 'export file' end")).alias("cells"))
    head = tops.select("path", F.lit(3).alias("row_no"), F.expr("case when layout = '1' then array('Date', 'Description', 'Debit', 'Credit') else array('Posted Date', 'Description', 'Amount') end").alias("cells"))
    out = dl.parse_sheet(rows.select("path", "row_no", "cells").unionByName(first).unionByName(head))
    return out.select("path", "bank_source", "transaction_date", "description", "amount")


@query(
    "a14_cell_roles",
    f"select {DOC} as path, '' || transaction_date as transaction_date, description, amount::double as amount from ledger",
)
def a14(t):
    rows = frame(t, f"select {DOC} as path, 1 as row_no, array('12', date_format(transaction_date, 'MM/dd/yyyy'), 'abcd', description, null, '' || amount) as cells from ledger")
    return dl.cell_roles(rows).select("path", "transaction_date", "description", "amount")


# ---------------------------------------------------------------- positioned words and lines

# Statements are printed ten years later, because year tokens are only read from 2000 on.
SHIFTED = "add_months(transaction_date, 120)"
SHIFTED_SQL = "(transaction_date + interval 10 year)::date"
NEXT = f"add_months(trunc({SHIFTED}, 'month'), 1)"
BASE = f"select {DOC} as doc_id, transaction_id, seq, {SHIFTED} as d, {NEXT} as close, day({SHIFTED}) as page, description, cents, format_number(abs(amount), 2) as a from ledger"


def printed(t):
    rows = frame(t, BASE)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")))


def words_of(rows, date_format: str, date_x: int, amount, amount_x, extra=None):
    """One printed row as words: a date, the description's words, an amount and optionally a balance."""
    w = lambda x, text: F.struct(F.lit(x).cast("double").alias("x0") if not hasattr(x, "cast") else x.cast("double").alias("x0"), text.alias("text"))
    desc = F.transform(F.split("description", " "), lambda x, i: F.struct((i * 20 + 100).cast("double").alias("x0"), x.alias("text")))
    parts = F.concat(F.array(w(date_x, F.date_format("d", date_format))), desc, F.array(w(amount_x, amount), *([extra] if extra is not None else [])))
    out = rows.select("doc_id", "page", "n", F.posexplode(parts).alias("i", "w"))
    return out.select("doc_id", "page", (F.col("n") * 20 + F.col("i") % 2).cast("double").alias("top"), "w.x0", "w.text")


def heading(rows, page: int, text, x: float = 60.0):
    """A heading row at the top of one page of every document."""
    h = rows.select("doc_id", "close").distinct().select("doc_id", F.lit(page).alias("page"), F.posexplode(F.split(text, " ")).alias("i", "text"))
    return h.select("doc_id", "page", F.lit(5.0).alias("top"), (F.col("i") * 15.0 + x).alias("x0"), "text")


def sided(rows, up_page: int):
    """Positive amounts move to a second block of pages."""
    return rows.withColumn("page", F.when(F.col("cents") > 0, F.col("page") + up_page).otherwise(F.col("page")))


ROW_TEXT = f"strftime({SHIFTED_SQL}, '%m/%d/%Y') || ' ' || description || ' ' || format('{{:,.2f}}', abs(cents) / 100.0)"


@query("a8_rows_by_bucket", f"select {DOC} as doc_id, day({SHIFTED_SQL}) as page, {ROW_TEXT} as text from ledger")
def a8(t):
    w = words_of(printed(t), "MM/dd/yyyy", 50, F.col("a"), 500)
    return lo.rows_by_bucket(w, 4).select("doc_id", "page", "text")


@query("a8_rows_by_anchor", f"select {DOC} as doc_id, day({SHIFTED_SQL}) as page, {ROW_TEXT} as text from ledger")
def a8b(t):
    w = words_of(printed(t), "MM/dd/yyyy", 50, F.col("a"), 500)
    return lo.rows_by_anchor(w).select("doc_id", "page", "text")


@query("a9_words_in_columns", f"select {DOC} as doc_id, strftime({SHIFTED_SQL}, '%m/%d/%Y') as c_date, description as c_description, format('{{:,.2f}}', abs(cents) / 100.0) as c_amount from ledger")
def a9(t):
    w = words_of(printed(t), "MM/dd/yyyy", 50, F.col("a"), 500)
    return lo.in_columns(lo.rows_by_anchor(w), lo.AMEX_COLUMNS).select("doc_id", "c_date", "c_description", "c_amount")


@query(
    "a9_words_in_layouts",
    f"""select {DOC} as doc_id, bank, strftime({SHIFTED_SQL}, '%m/%d/%Y') as c_date, description as c_description, format('{{:,.2f}}', abs(cents) / 100.0) as c_amount
 from (select *, case when abs(hash_) % 2 = 0 then 'wide' else 'narrow' end as bank from (select *, length({DOC}) + month({SHIFTED_SQL}) as hash_ from ledger))""",
)
def a9_layouts(t):
    """Two banks whose amounts stand at different places, read by one plan from a table of layouts."""
    rows = printed(t)
    w = words_of(rows, "MM/dd/yyyy", 50, F.col("a"), F.when((F.length("doc_id") + F.month("d")) % 2 == 0, 700).otherwise(500))
    bank = F.when((F.length("doc_id") + F.month("d")) % 2 == 0, "wide").otherwise("narrow")
    layouts = [("narrow", f, *map(float, r)) for f, r in lo.AMEX_COLUMNS.items()] + [("wide", "date", 45.0, 95.0), ("wide", "description", 95.0, 650.0), ("wide", "amount", 650.0, 750.5)]
    table = t.spark.createDataFrame(layouts, "bank string, field string, lo double, hi double")
    got = lo.in_layout(lo.rows_by_anchor(w), rows.select("doc_id", bank.alias("bank")).distinct(), table)
    return got.select("doc_id", "bank", *[F.col("fields")[f].alias(f"c_{f}") for f in ("date", "description", "amount")])


def expected(kind_in: str, amount: str = "amount", desc: str = "description", kind_out: str = "expense") -> str:
    return f"select {DOC} as doc_id, '' || {SHIFTED_SQL} as transaction_date, {desc} as description, ({amount})::double as amount, case when cents > 0 then '{kind_in}' else '{kind_out}' end as parser_type from ledger"


OUT = ["doc_id", "transaction_date", "description", "amount", "parser_type"]


@query("a10_amex_statement", expected("card_credit"))
def a10_amex(t):
    rows = printed(t)
    w = words_of(sided(rows, 100), "MM/dd/yyyy", 50, F.concat(F.lit("$"), F.col("a")), 500)
    w = w.unionByName(heading(rows, 0, F.lit("New Charges"))).unionByName(heading(rows, 99, F.lit("Payments and Credits")))
    return lo.parse_amex(w).select(*OUT)


@query("a10_bofa_statement", expected("income"))
def a10_bofa(t):
    rows = printed(t)
    w = words_of(sided(rows, 100), "MM/dd/yy", 40, F.col("a"), 530)
    w = w.unionByName(heading(rows, 0, F.lit("Withdrawals and other subtractions"))).unionByName(heading(rows, 99, F.lit("Deposits and other additions")))
    return lo.parse_bofa(w).select(*OUT)


@query("a10_wells_bank_statement", expected("income"))
def a10_wells_bank(t):
    rows = printed(t)
    x = F.when(F.col("cents") > 0, 360).otherwise(430)
    w = words_of(rows, "M/d", 30, F.col("a"), x, F.struct(F.lit(520.0).alias("x0"), F.lit("1,000.00").alias("text")))
    return lo.parse_wells_bank(w.unionByName(heading(rows, 0, F.date_format(F.add_months("close", -1), "MMMM yyyy")))).select(*OUT)


@query("a10_discover_statement", expected("credit_card_payment", "-abs(amount)", "case when description = 'AMZN MKTP US' then 'AMZN MKTP' else description end"))
def a10_discover(t):
    rows = printed(t)
    w = words_of(rows, "MM/dd", 50, F.concat(F.when(F.col("cents") > 0, "-$").otherwise("$"), F.col("a")), 500)
    span = F.concat(F.lit("OPEN TO CLOSE DATE "), F.date_format(F.add_months("close", -1), "MM/dd/yyyy"), F.lit(" - "), F.date_format("close", "MM/dd/yyyy"))
    w = w.unionByName(heading(rows, 0, span))
    up, down = "".join(chr(i + lo.SHIFT) for i in range(1, 127)), "".join(chr(i) for i in range(1, 127))
    return lo.parse_discover(w.withColumn("text", F.translate("text", up, down))).select(*OUT)


def as_lines(rows, line_no, text, heads):
    """Printed lines below (line_no, text) headings repeated in every document."""
    data = rows.select("doc_id", F.lit(1).alias("page"), line_no.alias("line_no"), text.alias("text"))
    docs = rows.select("doc_id", "close").distinct()
    for n, h in heads:
        data = data.unionByName(docs.select("doc_id", F.lit(1).alias("page"), F.lit(n).alias("line_no"), h.alias("text")))
    return data


@query("a10_chase_statement", expected("refund", "amount", "case when description = 'AMZN MKTP US' then 'AMZN' else description end"))
def a10_chase(t):
    rows, up = printed(t), F.col("cents") > 0
    text = F.concat_ws(" ", F.date_format("d", "MM/dd"), "description", F.concat(F.when(up, "-").otherwise(""), F.col("a")))
    heads = [(0, F.concat(F.lit("Statement "), F.date_format("close", "MMMM yyyy"))), (1, F.lit("PAYMENTS AND OTHER CREDITS")), (10, F.lit("PURCHASE")), (30, F.lit("INTEREST CHARGES"))]
    return lo.parse_chase(as_lines(rows, F.when(up, 5).otherwise(20), text, heads)).select(*OUT)


UNDATED = f"month({SHIFTED_SQL}) % 3 = 0"


@query(
    "a10_rejected_lines",
    f"""select {DOC} as doc_id, day({SHIFTED_SQL}) as page, strftime({SHIFTED_SQL}, '%-m/%-d') || ' ' || description || ' ' || format('{{:,.2f}}', abs(cents) / 100.0) || ' 1,000.00' as text, 'no date' as reason from ledger where {UNDATED}
 union all select {DOC}, day({SHIFTED_SQL}), '' || {SHIFTED_SQL}, null from ledger where not ({UNDATED})""",
)
def a10_rejects(t):
    """Every third month's statements print no year: their lines go to quarantine, all others become rows; one pass writes both."""
    rows = printed(t)
    x = F.when(F.col("cents") > 0, 360).otherwise(430)
    w = words_of(rows, "M/d", 30, F.col("a"), x, F.struct(F.lit(520.0).alias("x0"), F.lit("1,000.00").alias("text")))
    dated = rows.filter(F.month("d") % 3 != 0)
    judged = lo.parse_wells_bank.judged(w.unionByName(heading(dated, 0, F.date_format(F.add_months("close", -1), "MMMM yyyy"))))
    path = scratch_path(t.spark, "judged")
    lo.write_judged(judged, path)
    kept = lo.judged_rows(t.spark, path, judged.schema)
    day = F.dayofmonth("transaction_date")
    return lo.quarantine(t.spark, path, judged.schema).select("doc_id", "page", "text", "reason").unionByName(
        kept.select("doc_id", day.alias("page"), F.col("transaction_date").cast("string").alias("text"), F.lit(None).cast("string").alias("reason")))


@query("a10_wells_credit_statement", expected("card_credit"))
def a10_wells_credit(t):
    rows = printed(t)
    text = F.concat_ws(" ", F.date_format("d", "MM/dd"), F.date_format("d", "MM/dd"), F.lit("12345 REFX"), "description", F.concat(F.lit("$"), F.when(F.col("cents") > 0, "-").otherwise(""), F.col("a")))
    return lo.parse_wells_credit(as_lines(rows, F.lit(20), text, [(0, F.concat(F.lit("Payment Due Date "), F.date_format("close", "MM/dd/yyyy"))), (40, F.lit("Total Fees $0.00"))])).select(*OUT)


@query("a10_macys_statement", expected("card_credit", "amount", "regexp_replace(description || ' VALLEY FAIR (CA)', '\\s+[A-Z\\s]+\\([A-Z]{2}\\)$', '')"))
def a10_macys(t):
    rows = printed(t)
    text = F.concat_ws(" ", F.date_format("d", "MMM d"), "description", F.lit("VALLEY FAIR (CA)"), F.concat(F.when(F.col("cents") > 0, "-$").otherwise("$"), F.col("a")))
    return lo.parse_macys(as_lines(rows, F.lit(20), text, [(0, F.concat(F.lit("Payment Due Date "), F.date_format("close", "MMMM d, yyyy")))])).select(*OUT)


@query(
    "a11_section_carry",
    f"select transaction_id, (last_value(case when cents % 5 = 0 then transaction_id end ignore nulls) over (partition by {DOC} order by day(transaction_date), seq rows between unbounded preceding and current row)) as section from ledger",
)
def a11(t):
    rows = frame(t, f"select {DOC} as doc_id, day(transaction_date) as page, seq, transaction_id, case when cents % 5 = 0 then transaction_id end as marker from ledger")
    return lo.carry_forward(rows, ["doc_id"], "page", ["seq"], "marker", "section").select("transaction_id", "section")


@query(
    "a12_statement_year",
    f"""with x as (select {DOC} as doc_id, seq, {SHIFTED_SQL} as d, cents % 50 = 0 as named from ledger),
 f as (select doc_id, arg_min(d, seq) as fd from x where named group by 1), c as (select doc_id, y, count(*) as n from (select doc_id, year(d) as y from x union all select doc_id, 2000 + day(d) from x where not named) group by 1, 2),
 k as (select doc_id, arg_max(y, (n, y)) as y from c group by 1)
select doc_id, month(fd)::bigint as stmt_month, coalesce(year(fd), y)::bigint as stmt_year from k left join f using (doc_id)""",
)
def a12(t):
    rows = frame(t, f"select {DOC} as doc_id, 1 as page, seq as line_no, case when cents % 50 = 0 then date_format({SHIFTED}, 'MMMM yyyy') else 'on ' || year({SHIFTED}) || ' and ' || (2000 + day({SHIFTED})) end as text from ledger")
    return lo.statement_years(rows)


@query("a13_decoded_text", "select transaction_id, memo as text, '$' || (abs(cents) // 100) || '.' || lpad('' || (abs(cents) % 100), 2, '0') || ' x' as joined from ledger")
def a13(t):
    up, down = "".join(chr(i + lo.SHIFT) for i in range(1, 127)), "".join(chr(i) for i in range(1, 127))
    shifted = t.ledger.withColumn("raw", F.translate("memo", up, down)).withColumn("parts", F.expr("'$' || (abs(cents) div 100) || ' .' || lpad('' || (abs(cents) % 100), 2, '0') || ' x'"))
    return shifted.select("transaction_id", lo.decode_shifted("raw").alias("text"), lo.join_split_amounts("parts").alias("joined"))
