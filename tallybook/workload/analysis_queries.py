"""Category sentences, burst windows and the curated analyses over the whole ledger."""

from __future__ import annotations

from tallybook.functions import fixed_values as v
from tallybook.operators import category_insight as ci
from tallybook.plans import analyses as an
from tallybook.workload import sqltext as s
from tallybook.workload.registry import LIVE, query, rr, usd
from tallybook.workload.summaries import FLOW, m

q = s.q
lst = lambda ws: "(" + ", ".join(map(q, ws)) + ")"

BURST = f"""fr as (select * from ledger where {LIVE} and not is_fixed), dy as (select user_id, ym, category, transaction_date as d, sum(-cents) as spent, count(*) as n from fr group by 1, 2, 3, 4),
 wn as (select *, sum(spent) over w as ws, max(d) over w as we from dy window w as (partition by user_id, ym, category order by d range between interval 0 days preceding and interval 2 days following)),
 bw as (select user_id, ym, category, arg_min(d, (-ws, d)) as bs, arg_min(we, (-ws, d)) as be, max(ws) as bsum, sum(n)::bigint as n, sum(spent)::bigint as total, coalesce(sum(spent) filter (isodow(d) > 5), 0)::bigint as weekend from wn group by 1, 2, 3)"""


@query("h5_burst_window", f"with {BURST} select user_id, ym, category, '' || bs as burst_start, '' || be as burst_end, bsum::bigint as burst_sum, n, total, weekend from bw")
def h5(t):
    return ci.burst_windows(t.ledger)


NAMES = f"nm as (select description, case when shown = '' then 'Unknown' else shown end as name from {s.display_from('(select distinct description from ledger)', 'description')})"


@query(
    "h6_category_insight",
    f"""with {BURST}, {NAMES}, mg as (select user_id, ym, category, name, count(*) as n, sum(-cents) as spent, min(seq) as s, max(-cents) as hi, min(-cents) as lo, min((cents, seq)) as top from fr join nm using (description) group by 1, 2, 3, 4),
 rk as (select *, row_number() over (partition by user_id, ym, category order by spent desc, s) as r1, row_number() over (partition by user_id, ym, category order by n desc, spent desc, s) as r2, row_number() over (partition by user_id, ym, category order by top) as r3 from mg),
 g as (select user_id, ym, category, count(*) as nm, max(hi) as hi, min(lo) as lo, max(name) filter (r1 = 1) as m1, max(spent) filter (r1 = 1) as s1, max(name) filter (r1 = 2) as m2, max(spent) filter (r1 = 2) as s2,
  max(name) filter (r2 = 1) as rname, max(n) filter (r2 = 1) as rn, max(name) filter (r3 = 1) as tname from rk group by 1, 2, 3),
 x as (select *, case when nm = 1 then 1 when hi * 2 > total and n > 1 then 2 when n >= 2 and bsum * 10 >= total * 4 and bs <> be then 3 when rn >= 3 then 4 when weekend * 10 >= total * 7 then 5 when (s1 + s2) * 10 > total * 4 then 6 else 7 end as k from g join bw using (user_id, ym, category))
select user_id, ym, category, ['single_merchant', 'dominance', 'burst', 'repeat_merchant', 'weekend', 'concentration', 'fallback'][k] as template,
 case k when 1 then 'All from one merchant: ' || m1 || '.' when 2 then 'One purchase made up most of this category: ' || tname || ' was ' || {rr('hi', 'total', 100)} || '% of ' || category || ' spend.'
 when 3 then 'Most spend happened in a 2-day burst around ' || strftime(bs, '%b %-d') || '–' || strftime(be, '%-d') || '.' when 4 then 'You visited ' || rname || ' ' || rn || ' times this month.'
 when 5 then 'Most ' || category || ' spend happened on weekends.' when 6 then 'Most spend was at ' || m1 || ' and ' || m2 || '.'
 else 'Purchases ranged from $' || {rr('lo', '100')} || ' to $' || {rr('hi', '100')} || ', averaging $' || {rr('total', 'n * 100')} || '.' end as text from x""",
)
def h6(t):
    return ci.category_insights(t.ledger)


POSTED = "pl as (select * from ledger where not is_pending)"
PFLOW = FLOW.replace("from ledger group by", "from pl group by")
line = lambda label, c: f"case when {c} <> 0 then '• {label} — ' || {usd(c)} end"


@query(
    "j1_net_cash_flow",
    f"""with {POSTED}, {PFLOW} select user_id, ym, {m('net')} as net, case when net >= 0 then 'In ' || strftime((ym || '-01')::date, '%B %Y') || ' you came out ahead by ' || {usd('net')} || '.'
 else 'In ' || strftime((ym || '-01')::date, '%B %Y') || ' you spent ' || {usd('net')} || ' more than came in.' end || chr(10) || chr(10) || 'Money in — ' || {usd('money_in')} || chr(10)
 || concat_ws(chr(10), {line('Income', 'income')}, {line('Refunds', 'refunds')}, {line('Transfers in', 'transfers_in')}) || chr(10) || chr(10) || 'Money out — ' || {usd('money_out')} || chr(10)
 || concat_ws(chr(10), case when net_expenses <> 0 then '• Spending — ' || {usd('net_expenses')} || case when card_credit <> 0 then ' (after ' || {usd('card_credit')} || ' in card credits)' else '' end end, {line('Cash withdrawn', 'cash')}, {line('Transfers out', 'transfers_out')})
 || chr(10) || chr(10) || 'Credit card payments are left out so spending isn''t counted twice.' as answer from flow""",
)
def j1(t):
    return an.net_cash_flow(t.ledger)


CM = "cmn as (select user_id, ym, category, sum(abs(cents)) as spent, count(*) as n, min(seq) as s from pl where transaction_type = 'expense' and category in {} group by 1, 2, 3), mo as (select user_id, ym from pl group by 1, 2 having count(*) >= 3)"
TRIM = CM.format(lst(v.TRIMMABLE_CATEGORIES))
BUY = 15000


@query(
    "j2_purchase_affordability",
    f"""with {POSTED}, {TRIM}, pr as (select c.user_id, c.ym, c.category, c.spent, sum(o.spent) as ps, count(*) as pn, min(o.spent) as low from cmn c join cmn o on o.user_id = c.user_id and o.category = c.category and o.ym <> c.ym
  join mo on mo.user_id = o.user_id and mo.ym = o.ym group by 1, 2, 3, 4),
 rs as (select *, spent - low as room, row_number() over (partition by user_id, ym order by spent - low desc, category desc) as rank from pr where spent * pn * 100 > ps * 105),
 bf as (select *, coalesce(sum(room) over (partition by user_id, ym order by rank rows between unbounded preceding and 1 preceding), 0) as before from rs where rank <= 3)
select user_id, ym, rank, category, {m('spent')} as current, {m('low')} as low, {m(f'least(room, {BUY} - before)')} as frees, before + least(room, {BUY} - before) >= {BUY} as covers from bf where before < {BUY}""",
)
def j2(t):
    return an.affordability(t.ledger, BUY)


J3 = """g as (select user_id, ym, list({'c': category, 's': spent, 'n': n} order by rank) as it from (select *, row_number() over (partition by user_id, ym order by spent desc, s) as rank from cmn where n >= 2) where rank <= 3 group by 1, 2)"""


def j3_sql(amount: int) -> str:
    cut = lambda i: f"case when it[{i}] is not null and d{i - 1} < {amount} then greatest(1, least(ceil(({amount}::double - d{i - 1}) / (it[{i}].s::double / it[{i}].n))::bigint, greatest(1, it[{i}].n // 3))) end"
    steps = "a0 as (select *, 0.0::double as d0 from g)"
    for i in (1, 2, 3):
        steps += f", a{i} as (select *, coalesce(d{i - 1} + c{i} * (it[{i}].s::double / it[{i}].n), d{i - 1}) as d{i} from (select *, {cut(i)} as c{i} from a{i - 1}))"
    rows = " union all ".join(f"select user_id, ym, {i}::bigint as k, it[{i}].c as category, c{i}::bigint as cut, it[{i}].n::bigint as visits, it[{i}].s::bigint as spent from a3 where c{i} is not null" for i in (1, 2, 3))
    return f"with {POSTED}, {TRIM}, {J3}, {steps} select user_id, ym, row_number() over (partition by user_id, ym order by k) - 1 as position, category, cut, visits, {m(rr('spent * cut', 'visits'))} as saves from ({rows})"


@query("j3_single_month_trims", j3_sql(BUY))
def j3(t):
    return an.single_month_trims(t.ledger, BUY)


DISC = CM.format(lst(v.DISCRETIONARY_CATEGORIES))


@query(
    "j4_lifestyle_creep",
    f"""with {POSTED}, {DISC}, sp as (select user_id, max(ym) as latest, count(*) - 1 as k from mo group by 1 having count(*) >= 3),
 g as (select c.user_id, latest, k, category, sum(spent) filter (c.ym = latest) as cur, coalesce(sum(spent) filter (c.ym <> latest), 0) as old from cmn c join mo using (user_id, ym) join sp using (user_id) group by 1, 2, 3, 4),
 b as (select *, cur * k - old as dk, row_number() over (partition by user_id order by cur * k - old desc, category desc) as rank from g where cur * k > old and cur >= 3000)
select user_id, latest as ym, rank, category, {m('cur')} as current, {m(rr('old', 'k'))} as average, case when old > 0 then category || ' is up $' || format('{{:,}}', {rr('dk', 'k * 100')}) || ' (' || {rr('dk', 'old', 100)} || '% over your $' || format('{{:,}}', {rr('old', 'k * 100')}) || ' average)'
 else category || ' is new this month at ' || {usd('cur')} end as fact from b where rank <= 3""",
)
def j4(t):
    return an.lifestyle_creep(t.ledger)


KEYED = f"kk as (select distinct description, {s.three_word_key('description')} as key from ledger), ek as (select p.*, key from pl p join kk using (description) where transaction_type = 'expense' and key <> '')"


@query(
    "j5_recurring_charges",
    f"""with {POSTED}, {KEYED}, nm as (select user_id, count(distinct ym) as n_months from ek group by 1), bm as (select user_id, key, ym, count(*) as n, arg_min(abs(cents), seq) as a, min(seq) as s, arg_min(category, seq) as category, arg_min(description, seq) as text from ek group by 1, 2, 3),
 g as (select user_id, key, count(*) as months, max(n) as most, min(a) as lo, max(a) as hi, arg_min(category, s) as category, arg_min(text, s) as text, arg_max(a, ym) as latest, sum(a) as tot from bm group by 1, 2),
 x as (select *, tot - latest as earlier, months - 1 as k from g join nm using (user_id) where months >= 2 and n_months >= 2 and (category in ('Subscriptions', 'Insurance', 'Bills & Utilities') or (most = 1 and lo > 0 and (hi - lo) * 100 <= lo * 8)))
select user_id, key, text[1:28] as name, category, months, {m('latest')} as latest, {m(rr('earlier', 'k'))} as earlier_average, earlier > 0 and latest * k * 100 > earlier * 105 and latest * k - earlier >= k * 100 as price_rise, category not in ('Rent/Mortgage', 'Loan Payment') as is_listed from x""",
)
def j5(t):
    return an.recurring_charges(t.ledger)


@query(
    "j5_duplicate_charges",
    f"with {POSTED}, {KEYED} select user_id, key, '' || transaction_date as date, {m('abs(cents)')} as amount, count(*) as times from ek where abs(cents) >= 500 group by user_id, key, transaction_date, abs(cents) having count(*) > 1",
)
def j5b(t):
    return an.duplicate_charges(t.ledger)


HALVES = f"{usd('fst')} || ' in the first half, ' || {usd('(total - fst)')} || ' in the second.'"


@query(
    "j6_spending_velocity",
    f"""with {POSTED}, dd as (select user_id, ym, transaction_date as d, sum(abs(cents)) as spent, min(seq) as s from pl where transaction_type = 'expense' and category not in {lst(v.OBLIGATION_CATEGORIES)} group by 1, 2, 3),
 g as (select user_id, ym, sum(spent) as total, count(*) as days, coalesce(sum(spent) filter (day(d) <= 15), 0) as fst, arg_min(d, (-spent, s)) as pd, max(spent) as ps, day(pd) as pdom from dd group by 1, 2)
select user_id, ym, {m('total')} as total, days, '' || pd as peak_day, {m('ps')} as peak, 'In ' || strftime((ym || '-01')::date, '%B %Y') || ' your day-to-day spending came to ' || {usd('total')} || ' across ' || days || ' days — about $' || format('{{:,}}', {rr('total', 'days * 100')})
 || ' a day. Your heaviest was the ' || pdom || case when pdom between 11 and 13 then 'th' when pdom % 10 = 1 then 'st' when pdom % 10 = 2 then 'nd' when pdom % 10 = 3 then 'rd' else 'th' end || ' at ' || {usd('ps')} || '. '
 || case when (total - fst) * 100 > fst * 115 then 'It picked up later in the month — ' || {HALVES} when fst * 100 > (total - fst) * 115 then 'You front-loaded the month — ' || {HALVES} else 'It stayed fairly even — ' || {HALVES} end as answer from g""",
)
def j6(t):
    return an.spending_velocity(t.ledger)


@query(
    "j7_disclaimer_notes",
    f"""with {POSTED}, {PFLOW}, nm as (select user_id, count(distinct ym) as n_months from pl group by 1), f as (select * from flow join nm using (user_id))
select user_id, ym, 1::bigint as position, 'no income was found in your uploads, so this reflects spending only — add a checking account or tell me your monthly income for a complete picture' as note from f where income = 0
union all select user_id, ym, 2, {usd('card_credit')} || ' in card statement credits are offsetting your spending' from f where card_credit >= 20000
union all select user_id, ym, 3, 'a ' || {usd('cents')} || ' refund (' || description || ') is included in money in — it may be for a purchase from an earlier month' from pl where transaction_type = 'refund' and abs(cents) >= 20000
union all select user_id, ym, 4, {usd('transfers_out')} || ' in outgoing transfers is counted as money out — if any of that was moving money to your own savings, your real spending is lower' from f where transfers_out >= 10000
union all select user_id, ym, 5, 'this is based on a single month of data' from f where n_months < 2""",
)
def j7(t):
    return an.disclaimer_notes(t.ledger)


@query(
    "j7_summary_category_lines",
    f"""with {POSTED}, c as (select user_id, ym, category, sum(abs(cents)) as spent from pl where transaction_type = 'expense' group by 1, 2, 3), g as (select *, sum(spent) over (partition by user_id, ym) as gross from c)
select user_id, ym, category, '  - ' || category || ': ' || {usd('spent')} || ' (' || {rr('spent', 'gross', 100)} || '%)' as line from g""",
)
def j7b(t):
    return an.summary_text(t.ledger)
