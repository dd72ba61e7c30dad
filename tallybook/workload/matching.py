"""Dedup, credit matching and project queries over the whole ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions import fixed_values as v
from tallybook.operators import credits as cr
from tallybook.operators import dedup as dd
from tallybook.operators import projects as pj
from tallybook.operators import recurrence as rec
from tallybook.operators import statements as st
from tallybook.schema import category_dimension
from tallybook.sources.sinks import scratch_path
from tallybook.sources.versions import commit_run, read_runs
from tallybook.workload import derived as d
from tallybook.workload import sqltext as s
from tallybook.workload.registry import AS_OF, LIVE, SPEND, query, rr
from tallybook.workload.summaries import CATEGORY_SQL, js, m
from tallybook.workload.text import AMOUNT_TEXT, FIXEDSUM, fixedsum

q = s.q

# ---------------------------------------------------------------- dedup: every row comes in again four ways

VARIANTS = [("same", 0, "description"), ("drift", 2, "description"), ("late", 4, "description"), ("reworded", 1, "'POS PURCHASE ' || description")]
INCOMING = " union all ".join(
    f"select '{k}' as variant, user_id, transaction_id || '/{k}' as transaction_id, transaction_date + {n} as transaction_date, amount, cents, {text} as description,"
    f" bank_source, account_name, category, is_pending, {'ext_id' if k == 'same' else 'null'} as ext_id, seq || '/{i}' as seq from ledger"
    for i, (k, n, text) in enumerate(VARIANTS))
ST = f"st as (select text, stem from (select text, {s.stem_cols('text')} from (select description as text from ledger union select 'POS PURCHASE ' || description from ledger)))"
FPX = f"""sha256(case when coalesce(ext_id, '') <> '' then concat_ws('|', bank_source, account_name, ext_id)
 else concat_ws('|', bank_source, account_name, '' || transaction_date, {AMOUNT_TEXT}, stem) end)"""
INC = f"inc as ({INCOMING}), hist as (select * from ledger where cents % 2 = 0), {ST}"


def incoming(t):
    """The rows of INCOMING from one read of the ledger."""
    rows = t.ledger.withColumn("_v", F.explode(F.array(*[
        F.struct(F.lit(k).alias("variant"), F.date_add("transaction_date", n).alias("day"), F.expr(text).alias("text"), (F.col("ext_id") if k == "same" else F.lit(None).cast("string")).alias("id"), F.lit(f"/{i}").alias("part"))
        for i, (k, n, text) in enumerate(VARIANTS)])))
    return rows.select(
        "_v.variant", "user_id", F.concat("transaction_id", F.lit("/"), "_v.variant").alias("transaction_id"), F.col("_v.day").alias("transaction_date"), "amount", "cents",
        F.col("_v.text").alias("description"), "bank_source", "account_name", "category", "is_pending", F.col("_v.id").alias("ext_id"), F.concat("seq", "_v.part").alias("seq"))


def history(t):
    return t.ledger.filter("cents % 2 = 0")


HISTORY_COLUMNS = ["user_id", "transaction_date", "amount", "cents", "description", "bank_source", "account_name", "ext_id"]


def history_beside(t):
    """What the checks read of `history`, chosen behind the ledger's joins: they are the joins of `incoming` then, whose rows move once for both."""
    rows = t.ledger.select(F.explode_outer(F.array(F.struct(*HISTORY_COLUMNS, F.expr("cents % 2 = 0").alias("_old")))).alias("_r")).select("_r.*")
    return rows.filter("_old").drop("_old")


@query(
    "e1_external_id_dedup",
    f"with {INC} select i.user_id, i.transaction_id from inc i where not exists (select 1 from hist h where h.user_id = i.user_id and trim(h.ext_id) = trim(i.ext_id) and length(trim(i.ext_id)) > 5)",
)
def e1(t):
    return dd.new_by_external_id(incoming(t), history(t)).select("user_id", "transaction_id")


@query(
    "e2_fingerprint_dedup",
    f"""with {INC}, fi as (select i.*, {FPX} as fp from inc i join st on description = text), fh as (select distinct user_id, {FPX} as fp from hist join st on description = text)
select user_id, transaction_id from (select *, row_number() over (partition by user_id, fp order by seq) as rn from fi where not exists (select 1 from fh where fh.user_id = fi.user_id and fh.fp = fi.fp)) where rn = 1""",
)
def e2(t):
    return dd.new_by_fingerprint(dd.with_fingerprint(incoming(t)), dd.with_fingerprint(history(t))).select("user_id", "transaction_id")


@query(
    "e3_fuzzy_dedup_history",
    f"""with {INC} select i.user_id, i.transaction_id from inc i where not exists (select 1 from hist h where h.user_id = i.user_id and h.account_name = i.account_name and h.cents = i.cents
 and lower(trim(h.description)) = lower(trim(i.description)) and abs(h.transaction_date - i.transaction_date) <= 3)""",
)
def e3(t):
    return dd.new_by_similarity(incoming(t), history_beside(t)).select("user_id", "transaction_id")


#: The batch rule as a fold over the rows of one account, amount and stem in their order; the SQL keeps lists of kept rows.
FOLD = """list_reduce(list_transform(list({'seq': seq, 'day': transaction_date, 'text': lower(trim(description)), 'fp': fp, 'variant': variant, 'id': transaction_id} order by seq), lambda r: [r]),
 lambda kept, x: case when len(list_filter(kept, lambda k: k.fp = x[1].fp or (k.text = x[1].text and abs(k.day - x[1].day) <= 3))) > 0 then kept else list_concat(kept, x) end)"""


def _fold_sql(rows):
    return f"""firsts as (select * from {rows} where coalesce(ext_id, '') = '' union all select * from {rows} where coalesce(ext_id, '') <> '' qualify row_number() over (partition by user_id, fp order by seq) = 1),
folded as (select user_id, unnest({FOLD}) k from firsts group by user_id, account_name, cents, stem) select user_id, k.variant as variant, k.id as transaction_id from folded"""


@query("e3_fuzzy_dedup_batch", f"with {INC}, fi as (select i.*, stem, {FPX} as fp from inc i join st on description = text), {_fold_sql('fi')}")
def e3b(t):
    """Order-dependent inside the batch; also compared with a brute-force loop in the tests."""
    return dd.first_in_batch(dd.with_fingerprint(incoming(t).drop("cents", "category")).drop("bank_source"), columns=["user_id", "variant", "transaction_id"])


@query(
    "e3_dedupe_batch_against_history",
    f"""with {INC}, fi as (select i.*, stem, {FPX} as fp from inc i join st on description = text), fh as (select user_id, account_name, cents, transaction_date as d, lower(trim(description)) as text, trim(ext_id) as id, {FPX} as fp from hist join st on description = text),
fresh as (select * from fi where not is_pending and not exists (select 1 from fh where fh.user_id = fi.user_id and fh.id = trim(fi.ext_id) and length(fh.id) > 5) and not exists (select 1 from fh where fh.user_id = fi.user_id and fh.fp = fi.fp)
 and not exists (select 1 from fh where fh.user_id = fi.user_id and fh.account_name = fi.account_name and fh.cents = fi.cents and fh.text = lower(trim(fi.description)) and abs(fh.d - fi.transaction_date) <= 3)), {_fold_sql('fresh')}""",
)
def e3c(t):
    return dd.dedupe(incoming(t).drop("cents", "category"), history(t), columns=["user_id", "variant", "transaction_id"])


@query(
    "a17_manifest_of_an_upload",
    f"""with {INC}, fi as (select i.*, stem, {FPX} as fp from inc i join st on description = text), fh as (select user_id, account_name, cents, transaction_date as d, lower(trim(description)) as text, trim(ext_id) as id, {FPX} as fp from hist join st on description = text),
fresh as (select * from fi where not is_pending and not exists (select 1 from fh where fh.user_id = fi.user_id and fh.id = trim(fi.ext_id) and length(fh.id) > 5) and not exists (select 1 from fh where fh.user_id = fi.user_id and fh.fp = fi.fp)
 and not exists (select 1 from fh where fh.user_id = fi.user_id and fh.account_name = fi.account_name and fh.cents = fi.cents and fh.text = lower(trim(fi.description)) and abs(fh.d - fi.transaction_date) <= 3)),
kept as ({_fold_sql('fresh').replace('firsts as', 'with firsts as', 1)}),
o as (select inc.user_id, account_name || '|' || inc.variant as file, case when is_pending then 'pending' when k.transaction_id is not null then 'saved' else 'duplicate' end as outcome, cents % 7 = 0 as needs_review, bank_source as bank
 from inc left join kept k on k.user_id = inc.user_id and k.transaction_id = inc.transaction_id)
select user_id, file, count(*) filter (outcome = 'saved') as transactions_extracted, count(*) filter (outcome = 'duplicate') as duplicates_skipped, count(*) filter (outcome = 'pending') as pending_skipped,
 count(*) filter (outcome = 'saved' and needs_review) as needs_review, max(bank) as bank, case when max(bank) <> 'Unknown Bank' then 0.9::double else 0.6::double end as parse_confidence, 'complete' as upload_status from o group by 1, 2""",
)
def a17_upload(t):
    """Counts of what the duplicate checks made of every row of an upload."""
    rows = incoming(t).withColumns({"file": F.concat_ws("|", "account_name", "variant"), "needs_review": F.col("cents") % 7 == 0, "bank": F.col("bank_source")})
    return st.upload_manifest(st.outcomes(rows, history(t)))


REPEATED = " union all ".join(
    f"select user_id, transaction_id || '#{i}' as transaction_id, transaction_date, amount, cents, description, bank_source, account_name, case when cents % 5 = 0 then ext_id end as ext_id, seq || '/{i}' as seq from ledger where cents % 3 >= {i}"
    for i in range(3))


OWN_ID = "case when cents % 5 = 0 then ext_id end"


def repeated(t):
    """The rows of REPEATED from one read of the ledger."""
    copy = F.explode(F.array_compact(F.array(*[F.when(F.expr(f"cents % 3 >= {i}"), F.lit(str(i))) for i in range(3)])))
    return t.ledger.withColumn("ext_id", F.expr(OWN_ID)).withColumn("_i", copy).select(
        "user_id", F.concat("transaction_id", F.lit("#"), "_i").alias("transaction_id"), "transaction_date", "amount", "cents", "description", "bank_source", "account_name", "ext_id", F.concat("seq", F.lit("/"), "_i").alias("seq"))


@query(
    "e2_repeated_purchases",
    f"""with inc as ({REPEATED}), old as (select user_id, transaction_date, amount, description, bank_source, account_name, case when cents % 5 = 0 then ext_id end as ext_id from ledger where cents % 2 = 0
 union all select user_id, transaction_date, amount, description, bank_source, account_name, null from ledger where cents % 4 = 0), {ST},
fi as (select i.*, {FPX} as fp from inc i join st on description = text), fh as (select user_id, {FPX} as fp, count(*) as n from old join st on description = text group by 1, 2)
select user_id, transaction_id from (select fi.user_id, transaction_id, coalesce(ext_id, '') <> '' as has_id, coalesce(n, 0) as known, row_number() over (partition by fi.user_id, fi.fp order by seq) as copy
 from fi left join fh on fh.user_id = fi.user_id and fh.fp = fi.fp) where case when has_id then known = 0 and copy = 1 else copy > known end""",
)
def e2_repeats(t):
    """Every row comes in one to three times; the history has it not at all, once or twice."""
    own, none = F.expr(OWN_ID), F.lit(None).cast("string")
    ids = F.array(F.struct(own.alias("ext_id")), F.when(F.expr("cents % 4 = 0"), F.struct(none.alias("ext_id"))))
    old = t.ledger.filter("cents % 2 = 0").withColumn("_id", F.explode(F.array_compact(ids))).withColumn("ext_id", F.col("_id.ext_id")).drop("_id")
    return dd.new_by_occurrence(dd.with_fingerprint(repeated(t)), dd.with_fingerprint(old)).select("user_id", "transaction_id")


@query(
    "e4_pending_superseded",
    """select user_id, transaction_id from ledger p where not is_pending or not exists (select 1 from ledger o where not o.is_pending and o.user_id = p.user_id
 and o.cents = p.cents and lower(o.description[1:8]) = lower(p.description[1:8]))""",
)
def e4(t):
    return dd.drop_superseded_pending(t.ledger).select("user_id", "transaction_id")


CHUNKS = """select account_name || '|' || ym as stmt_id, 1 + day(transaction_date) // 10 as chunk, seq as position, '' || transaction_date as date, amount, memo as description, bank_source,
 cents from ledger union all select account_name || '|' || ym, 2 + day(transaction_date) // 10, seq, '' || transaction_date, amount, memo, bank_source, cents from ledger where day(transaction_date) % 10 > 6"""
HEADS = """select account_name || '|' || ym as stmt_id, 1 + day(transaction_date) // 10 as chunk, case when min(cents) % 3 = 0 then max(bank_source) end as bank_name, case when max(cents) % 4 = 0 then '1234' end as account_last4,
 case when day(min(transaction_date)) > 12 then min(ym) end as statement_period, case when min(cents) % 2 = 0 then min(amount) end as opening_balance, case when max(cents) % 2 = 0 then max(amount) end as closing_balance from ledger group by 1, 2"""


def _chunked(t):
    t.ledger.createOrReplaceTempView("ledger")
    heads, rows = (t.spark.sql(x.replace("//", "div")) for x in (HEADS, CHUNKS))
    return dd.merge_chunks(heads, rows)


@query(
    "e5_merged_chunk_headers",
    f"""with h as ({HEADS}) select stmt_id, {', '.join(f"first({c} order by chunk) filter ({c} is not null) as {c}" for c in ('bank_name', 'account_last4', 'statement_period'))},
 (first(opening_balance order by chunk) filter (opening_balance is not null))::double as opening_balance, (last(closing_balance order by chunk) filter (closing_balance is not null))::double as closing_balance from h group by 1""",
)
def e5(t):
    return _chunked(t)[0]


@query(
    "e5_merged_chunk_rows",
    f"""with c as ({CHUNKS}), st as (select description, {s.extraction_stem('description')} as stem from (select distinct memo as description from ledger))
select stmt_id, chunk::bigint as chunk, position from (select *, row_number() over (partition by stmt_id, date, amount, stem order by chunk, position) as rn from c join st using (description)) where rn = 1""",
)
def e5b(t):
    return _chunked(t)[1].select("stmt_id", F.col("chunk").cast("long").alias("chunk"), "position")


# ---------------------------------------------------------------- credits


def credit_case(x: str, pick) -> str:
    pairs = [(s.has(x, v.CREDIT_INELIGIBLE_PATTERN), pick("cashback", False, None, None, None, "low"))]
    for k, (c, b, f) in v.CREDIT_PROGRAMS.items():
        pairs.append((f"contains({x}, {q(k)})", pick("subscription" if b == "committed" else "purchase", True, c, b, k, f)))
    for p, kind, c, b in v.CREDIT_TYPE_PATTERNS:
        pairs.append((s.has(x, p), pick(kind, kind != "cashback", c, b, None, "medium")))
    return s.case(pairs, pick("unknown", True, None, None, None, "low"))


def _lit(x):
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else q(x)


CREDIT_FIELDS = ["credit_type", "eligible", "target_category", "target_bucket", "program", "confidence"]


def credit_cols(x: str) -> str:
    return ", ".join(f"{credit_case(x, lambda *a, i=i: _lit(a[i]))} as {f}" for i, f in enumerate(CREDIT_FIELDS))


CREDIT_TEXT = """case abs(cents) % 8 when 0 then 'Amex Platinum Dining Credit' when 1 then 'Cash back reward' when 2 then 'Gold Uber Cash - Uber Eats' when 3 then 'Streaming credit'
 when 4 then 'Platinum Walmart Credit' when 5 then 'Saks thank you' when 6 then 'Statement Credit' else description end"""


@query("d16_classify_credit", f"select text, {credit_cols('lower(trim(text))')} from (select distinct {CREDIT_TEXT} as text from ledger union select memo from ledger)")
def d16(t):
    texts = t.ledger.select(F.expr(CREDIT_TEXT).alias("text")).union(t.ledger.select("memo")).distinct()
    return texts.withColumn("k", cr.classify_credit("text")).select("text", "k.*")


# Credits carry varied program texts so that every matching level occurs.
CL = f"cl as (select * replace (case when transaction_type = 'card_credit' then {CREDIT_TEXT} else description end as description) from ledger)"


def credit_ledger(t):
    return t.ledger.withColumn("description", F.expr(f"case when transaction_type = 'card_credit' then {CREDIT_TEXT} else description end"))


MATCH = f"""{CL}, c0 as (select user_id, ym, cents as credit, transaction_id as credit_id, description as credit_text, seq from (select *, row_number() over (partition by user_id, ym, cents, lower(description[1:30]) order by seq) as rn from cl where transaction_type = 'card_credit') where rn = 1),
 ct as (select text, {credit_cols('lower(trim(text))')}, trim(substr({s.credit_hint('text')}, 1, 8)) as hint from (select distinct credit_text as text from c0)),
 c1 as (select * from c0 join ct on credit_text = text), ex as (select * from cl where {LIVE}),
 l1 as (select credit_id, e.transaction_id, -e.cents as spent, e.category, row_number() over (partition by credit_id order by e.seq) as rn from c1 join ex e on eligible and hint <> '' and e.user_id = c1.user_id and e.ym = c1.ym and contains(lower(e.description), hint)),
 l2 as (select credit_id, e.transaction_id, -e.cents as spent, row_number() over (partition by credit_id order by abs(-e.cents - credit), e.seq) as rn from c1 join ex e on eligible and e.user_id = c1.user_id and e.ym = c1.ym and e.category = target_category),
 off as (select user_id, ym as statement_period, c1.credit_id, credit_text, {m('credit')} as credit_amount, coalesce(l1.transaction_id, l2.transaction_id) as expense_id,
  case when eligible then coalesce(target_category, l1.category) end as matched_category, credit_type, eligible, {m('coalesce(least(credit, coalesce(l1.spent, l2.spent)), 0)')} as applied_amount,
  {m('credit - coalesce(least(credit, coalesce(l1.spent, l2.spent)), 0)')} as unapplied_amount,
  case when l1.credit_id is not null then 'high' when l2.credit_id is not null then case when confidence = 'high' then 'high' else 'medium' end else 'none' end as match_confidence,
  case when not eligible then 'ineligible' when l1.credit_id is not null then 'exact_merchant' when l2.credit_id is not null then case when confidence = 'high' then 'program_mapping' else 'category_window' end else 'unmatched' end as match_method,
  coalesce(least(credit, case when coalesce(l1.spent, l2.spent) is not null then coalesce(l1.spent, l2.spent) end), 0) * (coalesce(l1.spent, l2.spent) is not null)::int as applied
  from c1 left join (select * from l1 where rn = 1) l1 using (credit_id) left join (select * from l2 where rn = 1) l2 using (credit_id))""".replace(
    "coalesce(least(credit, coalesce(l1.spent, l2.spent)), 0)", "case when coalesce(l1.spent, l2.spent) is null then 0 else least(credit, coalesce(l1.spent, l2.spent)) end")


@query("e6_credit_expense_match", f"with {MATCH} select credit_id, expense_id, match_method, match_confidence from off where expense_id is not null")
def e6(t):
    return cr.match_credits(credit_ledger(t)).filter("expense_id is not null").select("credit_id", "expense_id", "match_method", "match_confidence")


@query("e7_credit_matching_run", f"with {MATCH} select * exclude (applied) from off")
def e7(t):
    return cr.match_credits(credit_ledger(t))


@query(
    "e7_superseded_runs",
    f"""with {MATCH}
select run, run = 2 as is_active, user_id, statement_period, credit_id, expense_id, applied_amount, match_method from off, (select unnest([1::bigint, 2::bigint]) as run) where run = 2 or statement_period < '1998-01'""",
)
def e7_runs(t):
    """A first run over the credits until 1997, then one over all; only the second counts."""
    path = scratch_path(t.spark, "credit-runs")
    led = credit_ledger(t)
    for run, rows in ((1, led.filter("transaction_date < date'1998-01-01'")), (2, led)):
        commit_run(cr.match_credits(rows), path, run)
    return read_runs(t.spark, path).select("run", "is_active", "user_id", "statement_period", "credit_id", "expense_id", "applied_amount", "match_method")


@query(
    "e10_credit_offset_listing",
    f"with {MATCH} select off.* exclude (applied), description, amount::double as ledger_amount from off join (select transaction_id as credit_id, description, amount from cl) using (credit_id)",
)
def e10(t):
    led = credit_ledger(t)
    return cr.offset_listing(cr.match_credits(led), led)


@query(
    "e10_credit_offset_totals",
    f"with {MATCH} select user_id, statement_period, count(*) as n_offsets, {m('coalesce(sum(applied) filter (eligible), 0)')} as total_applied, (sum(round(unapplied_amount * 100)::bigint) / 100.0)::double as total_unapplied from off group by 1, 2",
)
def e10b(t):
    return cr.offset_totals(cr.match_credits(credit_ledger(t)))


@query(
    "e13_net_category_spend",
    f"""with {MATCH}, g as (select user_id, ym, category, sum(-cents) as gross from cl where {LIVE} group by 1, 2, 3),
 cc as (select user_id, statement_period as ym, matched_category as category, sum(applied) as credit from off where applied > 0 and matched_category is not null group by 1, 2, 3)
select user_id, ym, category, {m('gross')} as gross_spend, {m('coalesce(credit, 0)')} as credit_applied, {m('greatest(0, gross - coalesce(credit, 0))')} as net_spend from g left join cc using (user_id, ym, category)""",
)
def e13(t):
    led = credit_ledger(t)
    return cr.net_category_spend(led, cr.match_credits(led))


CMAP = """cmap as (select user_id, lower(trim(regexp_extract(description, '-\\s*(.+)', 1))[1:10]) as ck, sum(cents) as credit, min(seq) as fs from ledger
 where transaction_type = 'card_credit' and regexp_matches(description, '-\\s*(.+)') group by 1, 2)"""


@query(
    "e8_credit_cover",
    f"""with {CMAP}, x as (select distinct user_id, lower(description[1:10]) as mk from ledger where {SPEND}),
 hit as (select x.user_id, mk, ck, credit, row_number() over (partition by x.user_id, mk order by fs) as rn from x join cmap c on c.user_id = x.user_id and (contains(mk, ck[1:6]) or contains(ck, mk[1:6])))
select l.user_id, transaction_id, ck as credit_key, {m('least(credit, -cents)')} as credit_applied, {m('-cents - least(credit, -cents)')} as net_amount
 from ledger l join hit on hit.user_id = l.user_id and mk = lower(description[1:10]) and rn = 1 where {SPEND} and least(credit, -cents) > 0""",
)
def e8(t):
    return cr.covered_expenses(t.ledger)


@query(
    "e9_credit_covered_expenses",
    f"""with k as (select user_id, trim(lower(trim(regexp_extract(description, '-\\s*(.+)', 1))[1:10])) as ck, max(cents) as credit from ledger where transaction_type = 'card_credit' and regexp_matches(description, '-\\s*(.+)') group by 1, 2),
 hit as (select k.user_id, ck, credit, transaction_id, -cents as spent, row_number() over (partition by k.user_id, ck order by seq) as rn from k join ledger l on l.user_id = k.user_id and {LIVE} and contains(lower(description), ck) where ck <> '')
select distinct user_id, transaction_id from hit where rn = 1 and spent <= credit""",
)
def e9(t):
    return cr.exclude_covered(t.ledger).filter("transaction_type = 'excluded'").select("user_id", "transaction_id")


@query(
    "e12_category_lookup",
    f"select user_id, id::bigint as category_id, count(*) as n, {m('sum(cents)')} as total from ledger left join {CATEGORY_SQL} on category = name group by 1, 2",
)
def e12(t):
    dim = category_dimension(t.spark).select("category_id", F.col("category_name").alias("category"))
    sums = t.ledger.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("c"))
    out = sums.join(dim, "category", "left").groupBy("user_id", "category_id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return out.select("user_id", "category_id", "n", (F.col("c") / 100).alias("total"))


G9 = FIXEDSUM.replace(f"where {LIVE} and is_fixed", f"where is_fixed and (({LIVE}) or exclusion_reason = 'credit_covered')")
ITEMS = f"""{G9}, {CMAP}, xk as (select distinct user_id, lower(merchant[1:10]) as mk from fixsum),
 hit as (select xk.user_id, mk, credit, row_number() over (partition by xk.user_id, mk order by fs) as rn from xk join cmap c on c.user_id = xk.user_id and (contains(mk, ck[1:6]) or contains(ck, mk[1:6]))),
 items as (select user_id, merchant, total, varies, occurrences, false as manual, least(coalesce(credit, 0), total) as covered from fixsum left join (select * from hit where rn = 1) h using (user_id) where h.mk is null or true)"""
ITEMS = ITEMS.replace(" from fixsum left join (select * from hit where rn = 1) h using (user_id) where h.mk is null or true", " from fixsum f left join (select user_id as hu, mk, credit from hit where rn = 1) h on hu = f.user_id and mk = lower(merchant[1:10])")
ITEMS += f", alli as (select * from items union all select user_id, name, amount_cents, false, 1, true, 0 from ({d.MANUAL_SQL}))"


@query(
    "g9_fixed_with_cover",
    f"with {ITEMS} select user_id, merchant, {m('total')} as amount, varies, occurrences::bigint as occurrences, manual, {m('covered')} as credit_covered, {m('total - covered')} as net_amount from alli",
)
def g9(t):
    return cr.fixed_with_cover(t.ledger, d.manual_items(t))


@query(
    "g9_fixed_totals",
    f"with {ITEMS} select user_id, {m('sum(total)')} as total, {m('sum(covered)')} as credit_covered_total, {m('sum(total - covered)')} as net_fixed_total, count(*) as n_items from alli group by 1",
)
def g9b(t):
    return cr.fixed_totals(cr.fixed_with_cover(t.ledger, d.manual_items(t)))


MONTHLY = fixedsum("user_id, ym").replace(f"where {LIVE} and is_fixed", f"where is_fixed and (({LIVE}) or exclusion_reason = 'credit_covered')")


def monthly_sql(credit_scope: str) -> str:
    """Items of every user and month; credits of the same month, or of any."""
    same = "and c.ym = xk.ym" if credit_scope == "ym" else ""
    cmap = CMAP if credit_scope == "user" else CMAP.replace("select user_id, lower", "select user_id, ym, lower").replace("group by 1, 2", "group by 1, 2, 3")
    return f"""with {MONTHLY}, {cmap}, xk as (select distinct user_id, ym, lower(merchant[1:10]) as mk from fixsum),
 hit as (select xk.user_id, xk.ym, mk, credit, row_number() over (partition by xk.user_id, xk.ym, mk order by fs) as rn from xk join cmap c on c.user_id = xk.user_id {same} and (contains(mk, ck[1:6]) or contains(ck, mk[1:6]))),
 alli as (select f.user_id, f.ym, merchant, total, varies, occurrences, false as manual, least(coalesce(credit, 0), total) as covered from fixsum f left join hit on rn = 1 and hit.user_id = f.user_id and hit.ym = f.ym and mk = lower(merchant[1:10])
  union all select user_id, ym, name, amount_cents, false, 1, true, 0 from ({d.MANUAL_SQL}) join (select distinct user_id, ym from ledger) using (user_id))
select user_id, ym, merchant, {m('total')} as amount, varies, occurrences::bigint as occurrences, manual, {m('covered')} as credit_covered, {m('total - covered')} as net_amount from alli"""


@query("g9_fixed_by_month", monthly_sql("ym"))
def g9c(t):
    """Each month's items against the credits of that month."""
    return cr.fixed_with_cover(t.ledger, d.manual_items(t), by_month=True, credits_of="month")


@query("g9_fixed_by_month_all_credits", monthly_sql("user"))
def g9d(t):
    return cr.fixed_with_cover(t.ledger, d.manual_items(t), by_month=True)


# ---------------------------------------------------------------- projects: one per customer

PROJECTS = """select c_custkey as id, 'u' || lpad('' || c_nationkey, 2, '0') as user_id, case c_custkey % 3 when 0 then 'savings' when 1 then 'debt' else 'custom' end as type,
 cast(cast(floor(abs(c_acctbal) / 4) as bigint) as decimal(18,2)) as target_amount, case when c_custkey % 4 > 0 then date '2001-12-31' + cast(c_custkey % 90 as int) end as target_date,
 date '1998-01-01' + cast(c_custkey % 700 as int) as created_at, c_custkey % 10 = 0 as is_archived,
 case when c_custkey % 2 = 0 then c_mktsegment end as acct, case when c_custkey % 3 > 0 then 'Travel' end as cat,
 case when c_custkey % 5 > 0 then date '1996-01-01' + cast(c_custkey * 7 % 1500 as int) end as filter_start_date,
 date '1996-01-01' + cast(c_custkey * 7 % 1500 + 20 + c_custkey % 200 as int) as filter_end_date from customer"""


def projects(t):
    t.customer.createOrReplaceTempView("customer")
    p = t.spark.sql(PROJECTS)
    wrap = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    return p.withColumns({"filter_accounts": wrap("acct"), "filter_categories": wrap("cat")})


ASSIGN = f"""pr as ({PROJECTS}), tagged as (select l.*, id as project_id from (select l.*, p.id, row_number() over (partition by l.transaction_id order by p.created_at, p.id) as rn from ledger l join pr p
 on p.user_id = l.user_id and not is_pending and transaction_type in ('expense', 'refund', 'transfer', 'cash') and (acct is null or acct = bank_source) and (cat is null or cat = category)
 and (filter_start_date is null or transaction_date >= filter_start_date) and transaction_date <= filter_end_date) l where rn = 1)"""


def tagged(t):
    led = t.ledger
    return led.join(pj.assign(led, projects(t)), ["user_id", "transaction_id"])


@query("e11_project_assignment", f"with {ASSIGN} select user_id, transaction_id, project_id from tagged")
def e11(t):
    return pj.assign(t.ledger, projects(t))


DAYS = "date_diff('day', created_at, target_date)"
PROGRESS = f"""{ASSIGN}, ps as (select project_id, coalesce(sum(-cents) filter (cents < 0), 0) as o, coalesce(sum(cents) filter (cents > 0), 0) as i, count(*) as n from tagged group by 1),
 pg as (select pr.*, case when type = 'debt' then coalesce(o, 0) else coalesce(i, 0) end as current, (target_amount * 100)::bigint as target, coalesce(n, 0) as n from pr left join ps on project_id = id)"""
PROGRESS_COLS = f"""id, user_id, type, {m('target')} as target_amount, {m('current')} as current_amount, case when target > 0 then (least({rr('current', 'target', 1000)}, 1000) / 10.0)::double else 0.0::double end as percentage,
 case when target > 0 then {m('greatest(target - current, 0)')} end as remaining, case when target > 0 and {DAYS} > 0 then current * {DAYS} * 10 >= date_diff('day', created_at, date '{AS_OF}') * target * 9 end as on_track, n as transaction_count"""


@query("g15_project_progress", f"with {PROGRESS} select {PROGRESS_COLS} from pg")
def g15(t):
    return pj.progress(projects(t), tagged(t), AS_OF)


@query("f10_projects", f"with {PROGRESS} select {PROGRESS_COLS}, '' || created_at as created_at from pg where not is_archived")
def f10(t):
    return pj.listing(projects(t), tagged(t), AS_OF)


@query(
    "g16_project_spend_card",
    f"""with {ASSIGN}, c as (select project_id, category, sum(-cents) as val, count(*) as n, min(seq) as s from tagged where {SPEND} group by 1, 2),
 r as (select *, sum(val) over (partition by project_id) as total, sum(n) over (partition by project_id) as cnt, row_number() over (partition by project_id order by val desc, s) as rank from c)
select project_id, {m('total')} as total, cnt::bigint as count, rank, category, {m('val')} as amount, {js('val', 'total', 100)} as pct from r where rank <= 4""",
)
def g16(t):
    return pj.spend_cards(tagged(t))
