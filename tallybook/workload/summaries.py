"""Period selection, aggregates and trends over the whole ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallybook.operators import aggregates as agg
from tallybook.operators import periods as per
from tallybook.operators import trends as tr
from tallybook.schema import DEFAULT_CATEGORIES, category_dimension
from tallybook.workload import derived as d
from tallybook.workload.registry import AS_OF, LIVE, SPEND, pct, query, rr, usd

YM = AS_OF.strftime("%Y-%m")
CATEGORY_SQL = "(values " + ", ".join(f"({i}, '{n}', '{g}')" for i, (n, g) in enumerate(DEFAULT_CATEGORIES)) + ") c(id, name, grp)"


def m(c: str) -> str:
    return f"(({c}) / 100.0)::double"


SLIM = ["user_id", "transaction_id", "amount"]

# ---------------------------------------------------------------- filters and periods


@query("f1_spend", f"select user_id, transaction_id, amount::double as amount from ledger where {LIVE}")
def f1(t):
    return per.spend(t.ledger).select(*SLIM)


FLEX = f"{SPEND} and not is_fixed and category not in ('Transfer', 'Payment', 'Income')"


@query("f2_flexible_spend", f"select user_id, transaction_id, amount::double as amount from ledger where {FLEX}")
def f2(t):
    return per.flexible_spend(t.ledger).select(*SLIM)


@query(
    "f3_period_selection",
    """with mm as (select distinct user_id, ym from ledger),
 r as (select *, row_number() over (partition by user_id order by ym desc) as n from mm)
select l.user_id, '3m' as period, count(*) as n, sum(cents)::bigint as cents from ledger l join r using (user_id, ym)
 where r.n <= 3 group by 1
union all select l.user_id, 'latest', count(*), sum(cents)::bigint from ledger l join r using (user_id, ym)
 where r.n = 1 group by 1
union all select user_id, 'custom', count(*), sum(cents)::bigint from ledger
 where transaction_date between date '1997-02-10' and date '1998-03-05' group by 1
union all select user_id, '1999-07', count(*), sum(cents)::bigint from ledger where ym = '1999-07' group by 1""",
)
def f3(t):
    parts = [
        per.select_period(t.ledger, p, "1997-02-10", "1998-03-05").groupBy("user_id").agg(
            F.lit(p).alias("period"), F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
        for p in ("3m", "latest", "custom", "1999-07")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "f4_month_set",
    """select user_id, transaction_id, cents::bigint as cents, is_pending from ledger
 where (ym in ('1997-03', '1999-11') or is_pending) and bank_source = 'BUILDING'""",
)
def f4(t):
    undated = t.ledger.withColumn("transaction_date", F.when(~F.col("is_pending"), F.col("transaction_date")))
    return per.month_set(undated, ["1997-03", "1999-11"], "BUILDING").select("user_id", "transaction_id", "cents", "is_pending")


PROJECT_TAG = "case when cents % 7 = 0 then abs(cents) % 5 end"


@query(
    "f5_ledger_search",
    f"""with l as (select *, {PROJECT_TAG} as project_id from ledger)
select 'tagged' as kind, transaction_id from l where category = 'Shopping' and project_id is not null and lower(description) like '%eats%'
union all select 'untagged', transaction_id from l where ym = '1998-05' and bank_source = 'MACHINERY' and project_id is null
union all select 'id', transaction_id from l where project_id = 3""",
)
def f5(t):
    tagged = t.ledger.withColumn("project_id", F.expr(PROJECT_TAG))
    pick = lambda kind, df: df.select(F.lit(kind).alias("kind"), "transaction_id")
    return (
        pick("tagged", per.search(tagged, category="Shopping", project="tagged", text="Eats"))
        .unionByName(pick("untagged", per.search(tagged, account="MACHINERY", month="1998-05", project="untagged")))
        .unionByName(pick("id", per.search(tagged, project=3)))
    )


@query("f6_review_queue", "select user_id, transaction_id, amount::double as amount from ledger where needs_review and not is_pending")
def f6(t):
    return per.review_queue(t.ledger).select(*SLIM)


@query("f7_posted_ledger", "select user_id, transaction_id, amount::double as amount from ledger where not is_pending")
def f7(t):
    return per.posted(t.ledger).select(*SLIM)


@query(
    "f9_active_categories",
    f"""select id::bigint as category_id, name as category_name, grp as category_group, coalesce(n, 0)::bigint as n_rows
 from {CATEGORY_SQL} left join (select category, count(*) as n from ledger group by 1) on category = name""",
)
def f9(t):
    used = t.ledger.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))
    dim = per.active_categories(category_dimension(t.spark))
    out = dim.join(used, dim.category_name == used.category, "left").fillna(0, ["n_rows"])
    return out.select("category_id", "category_name", "category_group", "n_rows")


# ---------------------------------------------------------------- aggregates

MONTHS = f"""mt as (select user_id, ym, coalesce(sum(-cents) filter (not is_fixed), 0) as flexible,
 coalesce(sum(-cents) filter (is_fixed), 0) as committed, count(*) as txn_count from ledger where {LIVE} group by 1, 2)"""


@query(
    "g1_month_totals",
    f"""with {MONTHS} select user_id, ym, {m('flexible + committed')} as total, {m('flexible')} as flexible,
 {m('committed')} as committed, txn_count from mt""",
)
def g1(t):
    return agg.month_totals(t.ledger)


CATS = f"""cats as (select user_id, ym, category, is_fixed, sum(-cents) as spent, count(*) as n, min(seq) as first_seq
 from ledger where {LIVE} group by 1, 2, 3, 4)"""


@query(
    "g2_category_drilldown",
    f"""with {CATS}, f as (select *, sum(spent) over (partition by user_id, ym) as flex from cats where not is_fixed)
select user_id, ym, category, {m('spent')} as amount, {pct('spent', 'flex', 1)} as pct_of_flexible, n as txn_count,
 {m(rr('spent', 'n'))} as avg_amount from f""",
)
def g2(t):
    return agg.category_drilldown(t.ledger)


TOPCAT = f"""{CATS}, d as (select *, sum(spent) over (partition by user_id, ym) as flex,
 row_number() over (partition by user_id, ym order by spent desc, first_seq) as rn from cats where not is_fixed),
 fx as (select *, row_number() over (partition by user_id, ym order by spent desc, first_seq) as rn from cats where is_fixed),
 topcat as (select coalesce(d.user_id, fx.user_id) as user_id, coalesce(d.ym, fx.ym) as ym, d.category as top_category,
 {m('d.spent')} as top_amount, {pct('d.spent', 'd.flex', 1)} as top_pct, d.n as top_count,
 fx.category as fixed_category, {m('fx.spent')} as fixed_amount
 from (select * from d where rn = 1) d full join (select * from fx where rn = 1) fx using (user_id, ym))"""


@query("g3_top_category", f"with {TOPCAT} select * from topcat")
def g3(t):
    return agg.top_categories(t.ledger)


BIGGEST = f"""big as (select user_id, ym, description, '' || transaction_date as date, category, {m('-cents')} as amount from (
 select *, row_number() over (partition by user_id, ym order by cents, seq) as rn from ledger where {LIVE} and not is_fixed) where rn = 1)"""


@query("g4_biggest_charge", f"with {BIGGEST} select * from big")
def g4(t):
    return agg.biggest_charge(t.ledger)


FLOW = """flow as (select *, gross_expenses - card_credit as net_expenses, income + refunds + transfers_in as money_in,
 gross_expenses - card_credit + cash + transfers_out as money_out,
 income + refunds + transfers_in - (gross_expenses - card_credit + cash + transfers_out) as net from (
 select user_id, ym, count(*) as n_rows,
 coalesce(sum(cents) filter (transaction_type = 'income' and cents > 0), 0) as income,
 coalesce(sum(abs(cents)) filter (transaction_type = 'refund'), 0) as refunds,
 coalesce(sum(abs(cents)) filter (transaction_type = 'card_credit'), 0) as card_credit,
 coalesce(sum(cents) filter (transaction_type = 'transfer' and cents > 0), 0) as transfers_in,
 coalesce(sum(-cents) filter (transaction_type = 'transfer' and cents <= 0), 0) as transfers_out,
 coalesce(sum(abs(cents)) filter (transaction_type = 'cash'), 0) as cash,
 coalesce(sum(abs(cents)) filter (transaction_type = 'expense'), 0) as gross_expenses,
 string_agg(distinct bank_source, ', ' order by bank_source) as accounts from ledger group by 1, 2))"""


@query(
    "g5_cash_flow_summary",
    f"""with {FLOW}, ec as (select user_id, ym, category, sum(abs(cents)) as spent, min(seq) as s from ledger where transaction_type = 'expense' group by 1, 2, 3),
 tc as (select user_id, ym, string_agg(category, '; ' order by spent desc, s) as top_cats from ec group by 1, 2),
 te as (select user_id, ym, string_agg(description || ' [' || category || ']', '; ' order by rn) as top_expenses from (
  select *, row_number() over (partition by user_id, ym order by abs(cents) desc, seq) as rn from ledger where transaction_type = 'expense')
  where rn <= 5 group by 1, 2)
select user_id, ym, {', '.join(f'{m(c)} as {c}' for c in agg.FLOW_COLUMNS)}, accounts,
 coalesce(top_cats, '') as top_cats, coalesce(top_expenses, '') as top_expenses
from flow left join tc using (user_id, ym) left join te using (user_id, ym)""",
)
def g5(t):
    return agg.cash_flow_summary(t.ledger)


@query("g6_months_with_data", "select user_id, ym, count(*) as n from ledger group by 1, 2 having count(*) >= 3")
def g6(t):
    return agg.months_with_data(t.ledger)


TYPES = ["card_credit", "transfer", "credit_card_payment", "refund"]


@query(
    "g10_totals_by_type",
    "select user_id, ym, "
    + ", ".join(
        f"(coalesce(sum(abs(cents)) filter (transaction_type = '{x}'), 0) / 100.0)::double as {x}_total,"
        f" count(*) filter (transaction_type = '{x}') as {x}_count" for x in TYPES)
    + f" from ledger where transaction_type in {tuple(TYPES)} group by 1, 2",
)
def g10(t):
    return agg.totals_by_type(t.ledger)


CLIENT_FIXED = f"(is_fixed or lower(category) in {tuple(agg.CLIENT_FIXED_CATEGORIES)})"
CLIENT = f"""cm as (select user_id, ym, coalesce(sum(-cents) filter (not {CLIENT_FIXED}), 0) as variable,
 coalesce(sum(-cents) filter ({CLIENT_FIXED}), 0) as fixed, count(*) as n_rows from ledger where {LIVE} group by 1, 2)"""


def js(num: str, den: str, scale: int) -> str:
    """Halves-up rounding in SQL."""
    top, two = f"(({num}) * {2 * scale} + ({den}))::hugeint", f"(({den}) * 2)::hugeint"
    return f"((({top}) - ((({top}) % ({two})) + ({two})) % ({two})) // ({two}))::bigint"


@query(
    "g11_discretionary_share",
    f"""with {CLIENT} select user_id, ym, {m('variable')} as discretionary, {m('fixed')} as fixed,
 {js('variable', '(variable + fixed)', 100)} as discretionary_pct, 100 - {js('variable', '(variable + fixed)', 100)} as fixed_pct,
 n_rows as txn_count from cm""",
)
def g11(t):
    return agg.spending_share(t.ledger)


FULL = """fm as (select user_id, ym, count(*) as n, max(day(transaction_date)) - min(day(transaction_date)) as span from ledger group by 1, 2),
 fl as (select *, case when n < 2 then n >= 5 else span >= 20 end as is_full from fm)"""


@query("g12_full_months", f"with {FULL} select user_id, ym, n as txn_count, span::bigint as span, is_full from fl")
def g12(t):
    return agg.full_months(t.ledger)


@query(
    "g12_budget_multiplier",
    f"""with {FULL}, a as (select user_id, count(*) filter (is_full) as n_full, count(*) as n_months from fl group by 1)
select user_id, n_full, n_months, least(3, case when n_full > 0 then n_full else n_months end)::bigint as x3m,
 greatest(1, case when n_full > 0 then n_full else n_months end)::bigint as xall from a""",
)
def g12b(t):
    return agg.budget_multiplier(t.ledger)


BUDGETS = f"""bh as ({d.BUDGET_HISTORY_SQL}), pf as ({d.PROFILE_SQL}),
 bm as (select cm.*, coalesce(nullif(bh.budget, 0), pf.budget, 0) as budget from cm left join bh using (user_id, ym) left join pf using (user_id))"""


@query(
    "e14_budget_as_of_month",
    f"with {CLIENT}, {BUDGETS} select user_id, ym, {m('budget')} as budget from bm",
)
def e14(t):
    months = agg.client_month_cents(t.ledger).select("user_id", "ym")
    out = agg.budget_for_month(months, d.budget_history(t), d.profile(t))
    return out.select("user_id", "ym", (F.col("budget") / 100).alias("budget"))


@query(
    "g13_budget_use",
    f"""with {CLIENT}, {BUDGETS} select user_id, ym, {m('budget')} as budget, {m('variable')} as variable,
 case when budget > 0 then least({js('variable', 'budget', 100)}, 100) else 0 end::bigint as used_pct,
 case when budget > 0 then {m('(budget - variable)')} end as left_to_spend, budget > 0 and variable > budget as is_over,
 case when ym = '{YM}' and budget > 0 then {m(rr('variable * 30', '15'))} end as projected,
 case when ym = '{YM}' and budget > 0 then 15::bigint end as days_left,
 case when ym = '{YM}' and budget > 0 then variable * 300 <= budget * 15 * 11 end as on_track from bm""",
)
def g13(t):
    return agg.budget_use(t.ledger, d.budget_history(t), d.profile(t), AS_OF)


@query(
    "g14_partial_month",
    f"""select user_id, '{YM}' as ym, '' || min(transaction_date) as earliest, '' || max(transaction_date) as latest,
 day(min(transaction_date)) > 1 as is_partial from ledger where ym = '{YM}' group by 1""",
)
def g14(t):
    return agg.partial_month(t.ledger, AS_OF)


@query(
    "g19_usage_against_cap",
    """select user_id::varchar as user_id, count(*) as used, 10::bigint as cap, count(*) >= 10 as capped from events
 where ts >= timestamp '2024-01-01' group by 1""",
)
def g19(t):
    return agg.usage_against_cap(d.request_log(t), dt.date(2024, 1, 20))


@query(
    "g20_spending_impact",
    f"""with inc as ({d.INCOME_SQL}), c as (select user_id, category, sum(-cents) as spent, min(seq) as s from ledger
 where {SPEND} and not is_fixed and ym = '{YM}' group by 1, 2),
 ev as (select user_id, sum(spent) as expenses from c group by 1),
 n as (select *, {js('spent', '100', 1)} as val from c where category not in ('Transfer', 'Payment', 'Other', 'Income')),
 r as (select *, row_number() over (partition by user_id order by val desc, s) as rk from n),
 f as (select user_id, max(category) filter (rk = 1) as c1, max(val) filter (rk = 1) as v1, max(category) filter (rk = 2) as c2,
  max(val) filter (rk = 2) as v2, max(val) filter (category = 'Subscriptions' and rk <= 6) as subs from r group by 1),
 x as (select ev.user_id, expenses, income, c1, v1, c2, v2, subs from ev left join f using (user_id) left join inc using (user_id)),
 facts as (
  select user_id, 1 as ord, 'You spent $' || format('{{:,}}', v1) || ' on ' || c1 || ' — cutting 20% saves ~$' || format('{{:,}}', {js('v1', '5', 1)}) || '/mo' as fact from x where v1 > 50
  union all select user_id, 2, 'Subscriptions total $' || format('{{:,}}', subs) || '/mo — auditing unused ones is quick savings' from x where subs > 30
  union all select user_id, 3, 'Your spending is ' || {js('expenses', 'income', 100)} || '% of take-home pay this month' from x where income > 0 and expenses > 0
  union all select user_id, 4, c1 || ' + ' || c2 || ' make up most of your discretionary spending — $' || format('{{:,}}', v1 + v2) || '/mo' from x where c2 is not null)
select user_id, position, fact from (select user_id, fact, row_number() over (partition by user_id order by ord) - 1 as position from facts) where position < 3""",
)
def g20(t):
    return agg.spending_impact(t.ledger, d.income(t), AS_OF)


@query(
    "g21_manual_fixed_total",
    f"""with {CLIENT}, mf as (select user_id, sum(amount_cents) as manual from ({d.MANUAL_SQL}) group by 1)
select user_id, ym, {m('fixed')} as fixed, {m('coalesce(manual, 0)')} as manual_fixed, {m('(fixed + coalesce(manual, 0))')} as fixed_all
 from cm left join mf using (user_id)""",
)
def g21(t):
    return agg.with_manual_fixed(t.ledger, d.manual_items(t))


@query("g22_accounts", "select distinct user_id, bank_source from ledger")
def g22(t):
    return per.accounts(t.ledger)


@query("g22_accounts_in_month", "select distinct user_id, ym, bank_source from ledger")
def g22b(t):
    return agg.accounts_in_months(t.ledger)


# ---------------------------------------------------------------- trends

DENSE = f"""{MONTHS}, um as (select distinct user_id, ym, substr(ym, 1, 4)::int * 12 + substr(ym, 6, 2)::int - 1 as idx from ledger),
 dense as (select um.user_id, um.ym, um.idx, coalesce(flexible, 0) as flexible, coalesce(committed, 0) as committed,
 coalesce(txn_count, 0) as txn_count, count(*) over (partition by um.user_id) as n_months,
 row_number() over (partition by um.user_id order by um.ym) as position from um left join mt using (user_id, ym))"""
COMPARE = f"""{DENSE}, cmp0 as (select a.*, b.user_id is not null as has, b.flexible as pf, b.txn_count as pn,
 case when a.n_months <= 1 then 'not_enough_months' when b.user_id is null then 'no_previous_month' when b.flexible <= 0 then 'zero_baseline'
 when b.txn_count < 10 or b.flexible < 20000 then 'prev_month_incomplete' end as why
 from dense a left join dense b on a.user_id = b.user_id and b.idx = a.idx - 1),
 cmp as (select user_id, ym, coalesce(why, '') as reason, case when why is not null then 'unavailable' when n_months = 2 then 'absolute' else 'percentage' end as status,
 case when why is null then {m('(flexible - pf)')} end as delta_abs,
 case when why is null and n_months > 2 then ({rr('(flexible - pf)', 'pf', 1000)} / 10.0)::double end as delta_pct,
 case when why is null then case when flexible > pf then 'up' when flexible < pf then 'down' else 'flat' end end as direction from cmp0)"""


@query("h1_month_comparison", f"with {COMPARE} select * from cmp")
def h1(t):
    return tr.month_comparison(t.ledger)


@query(
    "h2_trend_chart",
    f"""with {DENSE} select a.user_id, a.ym as current_ym, b.ym, strftime((b.ym || '-01')::date, '%b %y') as label,
 {m('b.flexible')} as flexible, {m('b.committed')} as committed from dense a join dense b
 on a.user_id = b.user_id and b.position between a.position - 5 and a.position where a.n_months > 1""",
)
def h2(t):
    return tr.trend_chart(t.ledger)


@query(
    "h3_spending_trend",
    f"""with {CLIENT}, um as (select distinct user_id, ym, substr(ym, 1, 4)::int * 12 + substr(ym, 6, 2)::int - 1 as idx from ledger),
 a as (select um.*, coalesce(variable, 0) as variable, coalesce(fixed, 0) as fixed from um left join cm using (user_id, ym)),
 b as (select *, variable + fixed as total, lag(variable + fixed) over w as pt, lag(idx) over w as pi from a window w as (partition by user_id order by idx))
select user_id, ym, strftime((ym || '-01')::date, '%b %y') as label, {m('variable')} as variable, {m('fixed')} as fixed, {m('total')} as total,
 case when pi = idx - 1 and pt > 5000 and total > 5000 then {js('(total - pt)', 'pt', 100)} end as pct_change from b""",
)
def h3(t):
    return tr.spending_trend(t.ledger)


@query(
    "h4_dashboard_summary",
    f"""with {COMPARE}, {TOPCAT}, {BIGGEST}
select d0.user_id, d0.ym, strftime((d0.ym || '-01')::date, '%B %Y') as label, least(n_months, 3)::bigint as data_tier, n_months as months_available,
 strftime((d0.ym || '-01')::date - interval 1 month, '%Y-%m') as previous_ym, {m('(flexible + committed)')} as total, {m('flexible')} as flexible,
 {m('committed')} as committed, txn_count, reason, status, delta_abs, delta_pct, direction, top_category, top_amount, top_pct,
 big.description as biggest, big.amount as biggest_amount
from dense d0 join cmp using (user_id, ym) left join topcat using (user_id, ym) left join big using (user_id, ym)""",
)
def h4(t):
    return tr.dashboard_summary(t.ledger)


@query(
    "h7_top_transactions",
    f"""select user_id, ym, category, rank, '' || transaction_date as date, description, {m('-cents')} as amount from (
 select *, row_number() over (partition by user_id, ym, category order by cents, seq) as rank from ledger where {LIVE} and not is_fixed) where rank <= 5""",
)
def h7(t):
    return tr.top_transactions(t.ledger)


@query(
    "h8_largest_expenses",
    f"""select user_id, rank, transaction_id, description, {m('-cents')} as amount from (
 select *, row_number() over (partition by user_id order by cents, seq) as rank from ledger where {LIVE}) where rank <= 10""",
)
def h8(t):
    return tr.largest_expenses(t.ledger)


@query(
    "h9_ledger_page",
    "select user_id, transaction_id, amount::double as amount from ledger where not is_pending order by transaction_date desc, seq limit 25 offset 50",
)
def h9(t):
    rows = t.ledger.filter(~F.col("is_pending"))
    return per.page(rows, 3, [F.desc("transaction_date"), F.col("seq")]).select(*SLIM)


# Every user's merchant is a history of its own here: whole users have no month without rows.
GAP_LEDGER = "(select * replace (user_id || '|' || description as user_id) from ledger)"
GAPS = f"""um as (select distinct user_id, ym, substr(ym, 1, 4)::int * 12 + substr(ym, 6, 2)::int - 1 as idx from {GAP_LEDGER}),
 nx as (select *, lead(idx) over (partition by user_id order by idx) as nxt, lead(ym) over (partition by user_id order by idx) as nym from um),
 gaps as (select user_id, ym as gap_after, nym as gap_before, (nxt - idx - 1)::bigint as n_missing,
 list_transform(range(idx + 1, nxt), lambda i: strftime(make_date((i // 12)::int, (i % 12 + 1)::int, 1), '%B %Y')) as names from nx where nxt - idx > 1)"""


def gappy(t):
    return t.ledger.withColumn("user_id", F.concat_ws("|", "user_id", "description"))


@query("h10_month_gaps", f"with {GAPS} select user_id, gap_after, gap_before, n_missing, array_to_string(names, ', ') as missing from gaps")
def h10(t):
    return tr.month_gaps(gappy(t))


@query(
    "h10_first_gap_note",
    f"""with {GAPS} select user_id, 'Heads up: your history jumps from ' || strftime((gap_after || '-01')::date, '%B %Y') || ' to ' ||
 strftime((gap_before || '-01')::date, '%B %Y') || ', so the months in between (' ||
 case when len(names) = 1 then names[1] else names[1] || '–' || names[-1] end || ') are missing — uploading those will make this noticeably more accurate.' as gap_note
 from (select *, row_number() over (partition by user_id order by gap_after) as rn from gaps) where rn = 1""",
)
def h10b(t):
    return tr.first_gap_note(gappy(t))


@query(
    "h11_category_listing",
    f"""select user_id, transaction_id, '' || transaction_date as transaction_date, description, bank_source, {m('-cents')} as amount,
 {m('sum(-cents) over (partition by user_id)')} as category_total, count(*) over (partition by user_id) as category_count
 from ledger where category = 'Travel' and {SPEND}""",
)
def h11(t):
    return tr.category_listing(t.ledger, "Travel")


@query(
    "h12_flexible_change",
    f"""with {CLIENT}, um as (select distinct user_id, ym from ledger),
 part as (select user_id from ledger where ym = '{YM}' group by 1 having day(min(transaction_date)) > 1),
 a as (select um.*, coalesce(variable, 0) as variable, coalesce(n_rows, 0) as n_rows,
  lag(coalesce(variable, 0) + coalesce(fixed, 0)) over (partition by um.user_id order by um.ym) as before from um left join cm using (user_id, ym)),
 b as (select a.*, case when before > 0 then ({rr('(variable - before)', 'before', 1000)} / 10.0)::double end as change_pct from a)
select user_id, ym, {m('variable')} as variable, change_pct,
 change_pct is not null and n_rows >= 10 and not (ym = '{YM}' and user_id in (select user_id from part)) as is_shown from b""",
)
def h12(t):
    return tr.flexible_change(t.ledger, AS_OF)
