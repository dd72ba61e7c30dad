"""Corrections, statement checks, manifests and chunking over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.adapter import LEDGER_COLUMNS
from tallybook.functions import fixed_values as v
from tallybook.functions.merchants import display_merchant, prefix_key
from tallybook.functions.signals import is_subscription
from tallybook.operators import classify as cl
from tallybook.operators import corrections as co
from tallybook.operators import statements as st
from tallybook.operators.periods import spend
from tallybook.schema import DEFAULT_CATEGORIES, category_dimension
from tallybook.workload import derived as d
from tallybook.workload import sqltext as s
from tallybook.workload.registry import LIVE, query, rr
from tallybook.workload.summaries import CATEGORY_SQL, m
from tallybook.workload.text import PROF, RAWCAT_CASE, RULES, merchant_rules, subs_sql
from tallybook.workload.text import CANON_SQL

q = s.q


def sql(t, text: str):
    """A frame from SQL text over the given tables and the ledger."""
    t.ledger.createOrReplaceTempView("ledger")
    d.views(t)
    return t.spark.sql(text)


# Two corrections per reviewed row, the later one partial.
CORR = """select user_id, transaction_id, case abs(cents) % 4 when 0 then 'Payment' when 1 then 'Transfer' when 2 then 'Pets' end as category, case when cents % 3 = 0 then 'Corrected ' || description end as description,
 cast(null as varchar(9)) as transaction_type, 1 as updated_at from ledger where needs_review
 union all select user_id, transaction_id, 'Education', null, 'expense', 2 from ledger where needs_review and cents % 5 = 0"""


@query(
    "k1_apply_corrections",
    f"""with c as ({CORR}), n as (select user_id, transaction_id, arg_max((category, description, transaction_type), updated_at) as r, max(updated_at) as u from c group by 1, 2),
 x as (select user_id, transaction_id, category, description, transaction_type from c join (select user_id, transaction_id, u from n) using (user_id, transaction_id) where updated_at = u)
select l.user_id, l.transaction_id, coalesce(case when x.category in ('Payment', 'Credit Card Payment') then 'Credit Card Payment' else x.category end, l.category) as category, coalesce(x.description, l.description) as description,
 coalesce(case when x.category = 'Transfer' then 'transfer' when x.category in ('Payment', 'Credit Card Payment') then 'credit_card_payment' else x.transaction_type end, l.transaction_type) as transaction_type,
 needs_review and x.user_id is null as needs_review, x.user_id is not null as is_edited from ledger l left join x using (user_id, transaction_id)""",
)
def k1(t):
    out = co.apply_corrections(t.ledger, sql(t, CORR))
    return out.select("user_id", "transaction_id", "category", "description", "transaction_type", "needs_review", "is_edited")


EXISTING = "select 'u' || lpad('' || (p_partkey % 25), 2, '0') as user_id, p_name as match_value, 'Old' as category, 0 as updated_at from part group by 1, 2"
LEARN_CORR = "select user_id, transaction_id, case when cents % 2 = 0 then 'Pets' else 'Gifts & Donations' end as category, cast(null as varchar(9)) as transaction_type, seq as updated_at from ledger where needs_review"


@query(
    "k2_learned_rules",
    f"""with c as ({LEARN_CORR}), cr as (select description, core from (select description, {s.learned_core_cols('description')} from (select distinct memo as description from ledger))),
 n as (select l.user_id, core as match_value, c.category, c.updated_at from ledger l join c using (user_id, transaction_id) join cr on memo = cr.description where l.category <> c.category and core <> ''),
 a as (select user_id, match_value, category, updated_at from n union all select user_id, match_value, category, '' || updated_at from ({EXISTING}))
select user_id, match_value, category from (select *, row_number() over (partition by user_id, match_value order by updated_at desc) as rn from a) where rn = 1""",
)
def k2(t):
    t.part.createOrReplaceTempView("part")
    existing = t.spark.sql(EXISTING).withColumn("updated_at", F.col("updated_at").cast("string"))
    rows = t.ledger.drop("description").withColumnRenamed("memo", "description")
    return co.learn_rules(rows, sql(t, LEARN_CORR), existing).select("user_id", "match_value", "category")


DECIDE = "select user_id, transaction_id, cents % 2 = 0 as is_fixed, seq as updated_at from ledger where needs_review"


@query(
    "k3_confirmed_fixed",
    f"""with k as (select description, substr({s.recurrence_key('description')}, 1, 8) as key8 from (select distinct memo as description from ledger)),
 x as (select user_id, key8, cents % 2 = 0 as is_fixed, seq as u from ledger join k on memo = k.description where needs_review and key8 <> '')
select user_id, key8, arg_max(is_fixed, u) as is_fixed, max(u) as updated_at from x group by 1, 2""",
)
def k3(t):
    rows = t.ledger.drop("description").withColumnRenamed("memo", "description")
    none = t.spark.createDataFrame([], "user_id string, key8 string, is_fixed boolean, updated_at string")
    return co.confirm_fixed(rows, sql(t, DECIDE), none)


MANUAL = "select user_id, 'manual-' || transaction_id as transaction_id, transaction_date, abs(amount) as amount, 'Cash tip ' || description as description, category, 'expense' as transaction_type from ledger where transaction_type = 'cash'"


@query(
    "k4_manual_entries",
    f"""with mn as ({MANUAL}), st as (select text, stem from (select text, {s.stem_cols('text')} from (select distinct description as text from mn)))
select transaction_id, sha256(concat_ws('|', 'manual', '', '' || transaction_date, regexp_replace('' || amount, '(\\.\\d)0$', '\\1'), stem)) as fingerprint, amount::double as amount from mn join st on text = description
union all select transaction_id, null, amount::double from ledger""",
)
def k4(t):
    rows = t.ledger.select("user_id", "transaction_id", "transaction_date", "amount", "description", "category", "transaction_type", F.lit(None).cast("string").alias("fingerprint"))
    return co.add_manual(rows, sql(t, MANUAL)).select("transaction_id", "fingerprint", "amount")


BUDGET_CHANGES = f"select {d.USER} as user_id, substr('' || cast(o_orderdate as date), 1, 7) as ym, cast(floor(o_totalprice) as bigint) as budget, o_orderkey as updated_at from orders join customer on o_custkey = c_custkey"


@query("k5_budget_snapshots", f"select user_id, ym, arg_max(budget, updated_at) as budget from ({BUDGET_CHANGES}) group by 1, 2")
def k5(t):
    none = t.spark.createDataFrame([], "user_id string, ym string, budget bigint, updated_at bigint")
    return co.snapshot_budget(none, sql(t, BUDGET_CHANGES)).select("user_id", "ym", "budget")


@query(
    "k6_deletions",
    """with g as (select user_id from ledger group by 1 having sum(cents) % 3 = 0), l as (select *, abs(cents) % 6 as project_id from ledger)
select user_id, transaction_id, case when project_id <> 4 then project_id end as project_id from l where user_id not in (select user_id from g) and not (needs_review and cents % 2 = 0)""",
)
def k6(t):
    led = t.ledger.withColumn("project_id", F.expr("abs(cents) % 6"))
    users = led.groupBy("user_id").agg(F.sum("cents").alias("c")).filter("c % 3 = 0")
    rows = led.filter("needs_review and cents % 2 = 0")
    gone = led.select("user_id", F.lit(4).cast("long").alias("id")).distinct()
    out = co.unlink_projects(co.delete_rows(co.delete_users(led, users), rows), gone)
    return out.select("user_id", "transaction_id", "project_id")


@query("k6_deleted_from_the_stored_ledger", "select ym, transaction_id from ledger where not (ym like '%-03' or (ym = '1996-07' and cents % 2 = 0))")
def k6_stored(t):
    """Deletions from the stored ledger: whole months and part of one; other months keep their files."""
    from tallybook.sources.sinks import append_ledger, delete_from_ledger, scratch_path

    path = scratch_path(t.spark, "ledger")
    append_ledger(t.ledger.select(*[c for c in LEDGER_COLUMNS if c not in ("ym", "cents")]), path)
    delete_from_ledger(path, t.ledger.filter("ym like '%-03' or (ym = '1996-07' and cents % 2 = 0)"))
    return t.spark.read.parquet(path).select("ym", "transaction_id")


TAGS = "select user_id, transaction_id, cents % 3 as project_id, 1 as updated_at from ledger where cents % 2 = 0 union all select user_id, transaction_id, null, 2 from ledger where cents % 4 = 0"


@query(
    "k7_project_tags",
    "select user_id, transaction_id, (case when cents % 4 = 0 then null when cents % 2 = 0 then cents % 3 else 99 end)::bigint as project_id from ledger",
)
def k7(t):
    return co.tag_projects(t.ledger.withColumn("project_id", F.lit(99).cast("long")), sql(t, TAGS)).select("user_id", "transaction_id", "project_id")


@query("k8_union_with_covered", f"select transaction_id from ledger where {LIVE} union all select transaction_id from ledger where exclusion_reason = 'credit_covered' and is_fixed")
def k8(t):
    return co.with_covered(spend(t.ledger), t.ledger).select("transaction_id")


SK = f"sk as (select distinct user_id, ym, trim(lower(substr(description, 1, 10))) as key from ledger where {subs_sql('description', v.INSIGHT_SUBSCRIPTION_KEYWORDS)})"


@query(
    "k9_lapsed_keys",
    f"""with {SK}, si as (select user_id, key, substr(ym, 1, 4)::int * 12 + substr(ym, 6, 2)::int as idx from sk), um as (select distinct user_id, ym, substr(ym, 1, 4)::int * 12 + substr(ym, 6, 2)::int as idx from ledger)
select um.user_id, um.ym, b.key from um join si b on b.user_id = um.user_id and b.idx = um.idx - 2 join si l on l.user_id = um.user_id and l.key = b.key and l.idx = um.idx - 1
 where not exists (select 1 from si n where n.user_id = um.user_id and n.key = b.key and n.idx = um.idx)""",
)
def k9(t):
    subs = t.ledger.filter(is_subscription("category", "description", v.INSIGHT_SUBSCRIPTION_KEYWORDS))
    seen = subs.select("user_id", "ym", prefix_key("description", 10).alias("key"))
    return co.lapsed_by_month(seen, t.ledger.select("user_id", "ym").distinct())


@query("k10_active_rules", f"select id, user_id, match_value, priority from ({RULES}) where is_active")
def k10(t):
    return co.active_rules(merchant_rules(t)).select("id", "user_id", "match_value", "priority")


@query(
    "a15_load_rules",
    f"select coalesce(user_id, '*') as for_user, id, priority, match_type from ({RULES}) where is_active and (user_id is null or user_id in (select user_id from ledger))",
)
def a15(t):
    return co.load_rules(merchant_rules(t), t.ledger.select("user_id").distinct())


TEXTS = """select 'd' || doc_id as id, case when doc_id % 3 = 0 then replace(text, '. ', '.' || chr(10) || '06/15 ') else replace(text, ' ', chr(10)) end as text from documents
 union all select 'c' || conv_id || '-' || turn, text from conversations"""


@query(
    "k11_text_chunks",
    f"""with recursive tx as (select id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as ln from ({TEXTS})),
 dt as (select id, ln, len(ln) as n, list_filter(list_transform(ln, lambda x, i: case when regexp_matches(x, {q(st.DATED_LINE)}) then i - 1 end), lambda i: i is not null) as ds from tx),
 ct as (select id, 0::bigint as position, 0::bigint as a, least(n, least(55, n) + 25, coalesce(list_min(list_filter(ds, lambda x: x >= least(55, n))), n))::bigint as b from dt
  union all select ct.id, position + 1, b, least(n, least(b + 55, n) + 25, coalesce(list_min(list_filter(ds, lambda x: x >= least(b + 55, n))), n))::bigint from ct join dt on dt.id = ct.id where b < n)
select ct.id, position, greatest(0, a - 6)::bigint as first_line, b as end_line, array_to_string(ln[greatest(0, a - 6) + 1:b], chr(10)) as chunk from ct join dt on dt.id = ct.id
 where trim(regexp_replace(array_to_string(ln[greatest(0, a - 6) + 1:b], chr(10)), '\\s+', ' ', 'g')) <> ''""",
)
def k11(t):
    t.documents.createOrReplaceTempView("documents")
    t.conversations.createOrReplaceTempView("conversations")
    return st.chunk_text(t.spark.sql(TEXTS.replace("chr(10)", "char(10)")))


@query(
    "k12_category_choices",
    f"select category, coalesce(n, 0)::bigint as tagged from (select name as category from {CATEGORY_SQL} union select category from ledger) left join (select category, count(*) as n from ledger where cents % 7 = 0 group by 1) using (category)",
)
def k12(t):
    names = category_dimension(t.spark).select(F.col("category_name").alias("category"))
    tagged = t.ledger.groupBy("category").agg(F.count_if(F.expr("cents % 7 = 0")).alias("tagged"))
    return co.category_choices(names, t.ledger).join(tagged, "category", "left").fillna(0, ["tagged"])


# ---------------------------------------------------------------- statement checks

MODES = "case abs(cents) % 5 when 0 then 'template' when 1 then 'generic_table' when 2 then 'generic_text' when 3 then 'ocr' else 'csv' end"
QROWS = f"select account_name || '|' || ym as file, {MODES} as mode, case when cents % 11 <> 0 then transaction_date end as transaction_date, case when cents % 13 <> 0 then amount end as amount, case when cents % 17 = 0 then ' ' else description end as description from ledger"
THRESH = "case mode when 'template' then 90 when 'generic_table' then 80 when 'ocr' then 65 else 75 end"


@query(
    "b7_parse_quality",
    f"""with x as ({QROWS}), g as (select file, mode, count(*) as n, count(*) filter (transaction_date is not null and amount is not null and trim(description) <> '') as valid from x group by 1, 2)
select file, mode, n, valid, ({rr('valid', 'n', 100)} / 100.0)::double as ratio, valid * 100 >= n * {THRESH} as passed from g""",
)
def b7(t):
    return st.parse_quality(sql(t, QROWS))


RAW = f"""select transaction_id, user_id, bank_source, cents, amount, memo as description, {RAWCAT_CASE} as raw_category, case abs(cents) % 10 when 0 then 'refund' when 1 then 'card_credit' when 2 then 'loan_payment' end as parser_type,
 case abs(cents) % 6 when 0 then 'income' when 1 then 'unknown' when 2 then 'expense' end as type_hint, case when cents % 4 = 0 then 'amex_xy' else 'csv' end as source from ledger"""


@query(
    "b11_enriched_rows",
    f"""with {PROF}, w as ({RAW}), x as (select w.* exclude (description), raw_category as raw, p.*, null::bigint as rule_id, null::varchar as rule_type, null::varchar as rule_category, null::varchar as rule_confidence from w join prof p using (description)),
 y as (select *, {s.decided()} from x), z as (select *, {s.case([(s.words('lower(description)', v.FEE_KEYWORDS), "'financing_fee'"), (s.words('lower(description)', v.STATEMENT_SUMMARY_KEYWORDS), "'statement_summary'")], 'null')} as excl,
  {' or '.join(s.has('lower(description)', p) for p in v.STATEMENT_CREDIT_FORMS)} as sc, source = 'amex_xy' and coalesce(parser_type = 'card_credit', false) as lc, lc or (excl is null and sc) as credit,
  parser_type in ('refund', 'card_credit', 'credit_card_payment', 'loan_payment') as tr0, case when coalesce(tr0, false) then parser_type else o_type end as t1, case when coalesce(tr0, false) then 'high' else o_confidence end as c1,
  coalesce(type_hint <> 'unknown', false) and c1 <> 'high' as hinted, case when hinted then type_hint else t1 end as t2, case when hinted then 'high' else c1 end as c2, {CANON_SQL} as own, raw <> '' and t2 = 'expense' and c2 <> 'high' and own <> 'Other' as use_own from y)
select transaction_id, case when credit then 'card_credit' when excl is not null then 'excluded' else t2 end as transaction_type, case when credit then 'Card Credit' when excl is not null then null when use_own then own else o_category end as category,
 case when credit or excl is not null then null when use_own then 'medium' else c2 end as confidence, case when credit then 'statement_credit' else excl end as exclusion_reason, (case when credit and not lc then abs(amount) else amount end)::double as amount,
 case when credit or excl is not null then false else o_review end as needs_review from z""",
)
def b11(t):
    return cl.enrich(sql(t, RAW)).select("transaction_id", "transaction_type", "category", "confidence", "exclusion_reason", "amount", "needs_review")


STMT = """select stmt_id, cast(case when k = 3 then null else 1000 end as decimal(18,2)) as opening_balance, cast(case k when 0 then 1000 + net when 1 then 1000 - net when 2 then 1000 + net + 7 else 5 end as decimal(18,2)) as closing_balance
 from (select account_name || '|' || ym as stmt_id, sum(amount) as net, abs(sum(cents)) % 4 as k from ledger group by account_name, ym)"""
SROWS = "select account_name || '|' || ym as stmt_id, transaction_id, case when cents % 19 = 0 then null else '' || transaction_date end as date, abs(amount) as amount, memo as description, case when cents > 0 then 'credit' else 'debit' end as direction, case when cents % 6 = 0 then 'Refund' else category end as category from ledger"
RECON = f"""stx as ({STMT}), sr as ({SROWS}), sm as (select stmt_id, coalesce(sum(amount) filter (direction = 'credit'), 0) as cr, coalesce(sum(amount) filter (direction = 'debit'), 0) as db from sr group by 1),
 dl as (select *, abs(opening_balance + cr - db - closing_balance) as bank, abs(opening_balance + db - cr - closing_balance) as card from stx join sm using (stmt_id)),
 rc as (select stmt_id, case when bank is null then 'no_balances_printed' when bank <= 0.05 or card <= 0.05 then 'reconciled' else 'MISMATCH' end as status,
  case when bank is null then null when bank <= 0.05 then 'bank/asset' when card <= 0.05 then 'card/liability' when bank <= card then 'bank/asset (closest)' else 'card/liability (closest)' end as convention,
  (case when bank is null then null when bank <= 0.05 then bank when card <= 0.05 then card else least(bank, card) end)::double as delta, cr::double as sum_credits, db::double as sum_debits from dl)"""


@query("g17_reconciliation", f"with {RECON} select * from rc")
def g17(t):
    return st.reconcile(sql(t, STMT), sql(t, SROWS))


@query(
    "g18_review_flags",
    f"""with {RECON}, f as (select sr.stmt_id, transaction_id, case when category in ({', '.join(map(q, v.EXTRACTION_CATEGORIES))}) then category else 'Other' end as category, concat_ws('; ', case when date is null then 'incomplete data' end,
 case when direction = 'debit' and (sr.category = 'Refund' or contains(lower(description), 'refund') or contains(lower(description), 'return')) then 'refund marked as debit - likely wrong sign' end,
 case when status <> 'reconciled' and (direction = 'credit' or {s.words('lower(description)', v.SIGN_TRAP_WORDS)}) then 'verify debit/credit sign' end) as why from sr join rc using (stmt_id))
select stmt_id, transaction_id, category, why <> '' as review, nullif(why, '') as review_reason from f""",
)
def g18(t):
    rows = sql(t, SROWS)
    status = st.reconcile(sql(t, STMT), rows)
    return st.review_flags(rows, status).select("stmt_id", "transaction_id", "category", "review", "review_reason")


OUTCOME = "select user_id, account_name || '|' || ym as file, case when is_pending then 'pending' when cents % 9 = 0 then 'duplicate' else 'saved' end as outcome, needs_review, case when bank_source = 'BUILDING' then 'Unknown Bank' else bank_source end as bank from ledger"
MANIFEST = f"""mf as (select user_id, file, count(*) filter (outcome = 'saved') as transactions_extracted, count(*) filter (outcome = 'duplicate') as duplicates_skipped, count(*) filter (outcome = 'pending') as pending_skipped,
 count(*) filter (outcome = 'saved' and needs_review) as needs_review, max(bank) as bank, case when max(bank) <> 'Unknown Bank' then 0.9::double else 0.6::double end as parse_confidence, 'complete' as upload_status from ({OUTCOME}) group by 1, 2)"""


@query("a17_upload_manifest", f"with {MANIFEST} select * from mf")
def a17(t):
    return st.upload_manifest(sql(t, OUTCOME))


@query("g23_upload_totals", f"with {MANIFEST} select user_id, count(*) as files, sum(transactions_extracted)::bigint as imported, sum(duplicates_skipped)::bigint as skipped from mf group by 1")
def g23(t):
    return st.upload_totals(st.upload_manifest(sql(t, OUTCOME)))


@query(
    "a18_output_record",
    f"""with nm as (select description, shown from {s.display_from('(select distinct memo as description from ledger)', 'description')})
select transaction_id, '' || transaction_date as date, memo as description, coalesce(nullif(shown, ''), memo, '') as merchant, amount::double as amount, 'USD' as currency, category, transaction_type, bank_source, coalesce(is_fixed, false) as is_fixed from ledger join nm on memo = nm.description""",
)
def a18(t):
    from tallybook.sources.sinks import output_record

    return output_record(t.ledger.drop("description").withColumnRenamed("memo", "description"))


@query(
    "a19_category_dimension",
    f"select grp as category_group, count(distinct name) as categories, count(l.category) as n_rows from {CATEGORY_SQL} left join ledger l on l.category = name group by 1",
)
def a19(t):
    dim = category_dimension(t.spark)
    used = t.ledger.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(used, dim.category_name == used.category, "left").groupBy("category_group").agg(F.count(F.lit(1)).alias("categories"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_rows"))


@query("a16_ledger_append", "select ym, count(*) as n, (sum(cents) / 100.0)::double as total from ledger group by 1")
def a16(t):
    """Append twice-partitioned output to the shared folder and read it back."""
    from tallybook.sources.sinks import append_ledger, scratch_path

    path = scratch_path(t.spark, "ledger")
    append_ledger(t.ledger.select(*[c for c in LEDGER_COLUMNS if c not in ("ym", "cents")]), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("ym").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
