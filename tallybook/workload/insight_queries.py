"""Insight rules, one query each, plus the ranked list; every user and month at once."""

from __future__ import annotations

from tallybook.functions import fixed_values as v
from tallybook.plans import insights as ins
from tallybook.workload import derived as d
from tallybook.workload import sqltext as s
from tallybook.workload.registry import AS_OF, query, rr, title
from tallybook.workload.summaries import YM
from tallybook.workload.text import subs_sql

q = s.q


def usd(x: str) -> str:
    return f"'$' || {rr(f'abs({x})', '100')}"


def per(x: str, y: str) -> str:
    return f"'$' || {rr(x, f'({y}) * 100')}"


def tenths(x: str, y: str) -> str:
    t = rr(x, y, 10)
    return f"({t} // 10) || '.' || ({t} % 10)"


BASE = f"""bh as ({d.BUDGET_HISTORY_SQL}), pf as ({d.PROFILE_SQL}),
 r as (select user_id, ym, seq, -cents as spent, transaction_date, description as text, category, is_fixed, not is_fixed and category not in ('Transfer', 'Payment', 'Income') as is_flex,
  {subs_sql('description', v.INSIGHT_SUBSCRIPTION_KEYWORDS)} as is_sub from ledger where transaction_type = 'expense' and cents < 0 and not is_pending),
 m0 as (select user_id, ym, count(*) as n, sum(spent) as total, coalesce(sum(spent) filter (is_flex), 0) as flex, count(*) filter (category = 'Food & Dining') as dining_n,
  coalesce(sum(spent) filter (category = 'Food & Dining'), 0) as dining, count(*) filter (isodow(transaction_date) > 5) as wknd_n, coalesce(sum(spent) filter (isodow(transaction_date) > 5), 0) as wknd,
  coalesce(sum(spent) filter (isodow(transaction_date) < 6), 0) as wkdy, coalesce(sum(spent) filter (day(transaction_date) >= 24), 0) as late, coalesce(sum(spent) filter (is_sub), 0) as sub_total,
  count(distinct trim(text[1:15])) filter (is_sub) as sub_n, count(*) filter (is_flex and not {s.words('lower(text)', ins.LOAN_WORDS)}) as free_n, coalesce(sum(spent) filter (is_flex and not {s.words('lower(text)', ins.LOAN_WORDS)}), 0) as free,
  {', '.join('(' + ' + '.join(f"coalesce(bool_or(is_sub and contains(lower(text), {q(k)})), false)::int" for k in ks) + f') as match_{i}, coalesce(sum(spent) filter (is_sub and {s.words("lower(text)", ks)}), 0) as bundle_{i}' for i, (ks, _, _) in enumerate(v.SUBSCRIPTION_BUNDLES))}
  from r group by 1, 2),
 m1 as (select m0.*, coalesce(nullif(bh.budget, 0), pf.budget, 0) as budget, row_number() over w as pos, count(*) over (partition by m0.user_id) as n_months, lag(n) over w as p_n, lag(flex) over w as p_flex,
  lag(flex, 2) over w as pp_flex, lag(dining_n) over w as p_dining_n, lag(ym) over w as p_ym, lag(ym, 2) over w as pp_ym from m0 left join bh using (user_id, ym) left join pf using (user_id) window w as (partition by m0.user_id order by m0.ym)),
 m as (select * from m1 where not (n < 10 or coalesce(p_n > 0 and n * 10 < p_n * 4, false))),
 c as (select user_id, ym, category, sum(spent) as spent, coalesce(sum(spent) filter (not is_fixed), 0) as loose, min(seq) as s from r where category not in ('Transfer', 'Payment', 'Income', 'Other') group by 1, 2, 3),
 k as (select user_id, ym, key, count(*) as n, arg_min(text, seq) as first_text, min(seq) as s, coalesce(sum(spent) filter (is_flex), 0) as flex, count(*) filter (is_flex) as flex_n, min(seq) filter (is_flex) as fs, arg_min(text, seq) filter (is_flex) as ft,
  coalesce(bool_or(is_flex and category in ('Loan Payment', 'Bills & Utilities', 'Insurance')), false) as skip_cat, coalesce(sum(spent) filter (is_fixed), 0) as fixed, count(*) filter (is_fixed) as fixed_n, min(seq) filter (is_fixed) as xs, arg_min(text, seq) filter (is_fixed) as xt
  from (select *, trim(lower(text[1:12])) as key from r) where key <> '' group by 1, 2, 3)"""


def rule(name: str, kind: str, score: str, head: str, body: str, action: str = "null", filt: str = "null", src: str = "m", where: str = "true", ctes: str = "") -> tuple[str, str]:
    """(CTEs beyond BASE, select) of a rule."""
    return ctes, f"select m.user_id, m.ym, {q(name)} as id, {q(kind)} as type, ({score})::bigint as score, {head} as title, {body} as body, {action}::varchar as action, {filt}::varchar as action_filter from {src} where {where}"


TH = max(4, round(6 * AS_OF.day / 30))
CC = """select m.user_id, m.ym, a.category, a.spent as c0, b.spent as c1, e.spent as c2, a.loose as l0, b.loose as l1, a.s as s0, b.s as s1 from m join c b on b.user_id = m.user_id and b.ym = m.p_ym
 join c a on a.user_id = m.user_id and a.ym = m.ym and a.category = b.category left join c e on e.user_id = m.user_id and e.ym = m.pp_ym and e.category = a.category"""
every = rr("30", "dining_n")
TARGET = "greatest(dining_n - 3, dining_n * 3 // 4)"
KEYLIFE = "life as (select user_id, key, count(*) as months, sum(n) as rws, min(s) as fs, arg_min(first_text, s) as ft, min(ym) as only_ym from k group by 1, 2)"
RULES = {
    "I1_B1": rule("B1", "behavior", "case when dining_n > 10 then 7 else 6 end",
        f"'You dined out ' || dining_n || ' times this month — ' || case when {every} <= 1 then 'almost every day' when {every} = 2 then 'every other day' else 'every ' || {every} || ' days' end",
        f"'Avg ' || {per('dining', 'dining_n')} || ' per visit. Cutting to ' || {TARGET} || ' times saves ~' || {per(f'(dining_n - {TARGET}) * dining', 'dining_n')} || '/mo.'", "'View dining transactions'", "'Food & Dining'",
        where=f"dining_n >= case when ym = '{YM}' then {TH} else 6 end"),
    "I2_B2": rule("B2", "behavior", "5", f"'You spend ' || {tenths('wknd * 22', 'wkdy * 8')} || '× more per day on weekends'", f"{usd('wknd')} || ' on weekends vs ' || {usd('wkdy')} || ' on weekdays this month.'", where="wknd_n > 0 and n > wknd_n and wknd * 220 > wkdy * 104"),
    "I3_B3": rule("B3", "behavior", "4", f"{rr('late', 'total', 100)} || '% of your spending happens in the last week'", f"{usd('late')} || ' in the final 7 days. Spreading purchases earlier helps budget tracking.'", where="late * 100 > total * 35"),
    "I4_B4": rule("B4", "behavior", "5", f"{title('x.key')} || ' is ' || {rr('x.flex', 'm.flex', 100)} || '% of your flexible spending'",
        f"{usd('x.flex')} || ' across ' || flex_n || ' transaction' || case when flex_n > 1 then 's' else '' end || ' — avg ' || {per('x.flex', 'flex_n')} || ' each.'",
        src=f"m join (select *, row_number() over (partition by user_id, ym order by flex desc, fs) as rn from k where flex_n > 0 and not {s.words('key', ins.COMMITTED_WORDS)}) x on x.user_id = m.user_id and x.ym = m.ym and rn = 1", where="m.flex > 0 and x.flex * 100 > m.flex * 15"),
    "I5_B5": rule("B5", "behavior", "case when sub_n >= 6 then 6 else 5 end", f"sub_n || ' active subscriptions · ' || {usd('sub_total')} || '/mo'", f"'That''s ' || {usd('(sub_total * 12)')} || '/year. When did you last audit what you actually use?'", "'View subscriptions'", "'Subscriptions'",
        where="sub_n >= 4 or (budget > 0 and sub_total * 10 > budget)"),
    "I6_T1": rule("T1", "trend", "8", "category || ' has grown 3 months in a row'", f"{usd('c2')} || ' → ' || {usd('c1')} || ' → ' || {usd('c0')} || '. Worth reviewing before it becomes a habit.'", "'View ' || category", "category",
        src=f"(select *, row_number() over (partition by user_id, ym order by s0) as rn from ({CC}) where c2 > 0 and c1 * 10 > c2 * 12 and c0 * 10 > c1 * 12) m", where="rn = 1"),
    "I7_T2": rule("T2", "win", "7", f"category || ' down ' || {rr('(l1 - l0)', 'l1', 100)} || '% vs last month'", f"{usd('l0')} || ' this month vs ' || {usd('l1')} || ' last month. You saved ' || {usd('(l1 - l0)')} || '. Keep it up!'",
        src=f"(select *, row_number() over (partition by user_id, ym order by s1) as rn from ({CC}) where l1 > 5000 and l0 >= 1000 and l0 * 100 < l1 * 85) m", where=f"rn = 1 and (ym <> '{YM}' or {AS_OF.day} >= 15)"),
    "I8_T3": rule("T3", "trend", "6", f"'New merchant: ' || {title('trim(x.ft[1:25])')}", f"{usd('x.flex')} || ' — that''s ' || {rr('x.flex', 'm.budget', 100)} || '% of your budget. First time seeing this charge.'",
        src=f"m join (select k.*, row_number() over (partition by k.user_id, k.ym order by k.fs) as rn from k join life using (user_id, key) join m1 on m1.user_id = k.user_id and m1.ym = k.ym where flex_n > 0 and months = 1 and budget > 0 and k.flex * 10 > budget and not {s.words('key', ins.COMMITTED_WORDS + ins.NEW_MERCHANT_SKIP)} and not skip_cat) x on x.user_id = m.user_id and x.ym = m.ym and rn = 1",
        where="p_n is not null", ctes=f", {KEYLIFE}"),
    "I9_T4": rule("T4", "trend", f"case when {rr(f'(flex * 30 - p_flex * {AS_OF.day})', f'(p_flex * {AS_OF.day})', 100)} > 30 then 8 else 7 end",
        f"'On pace for ' || {per('flex * 30', str(AS_OF.day))} || ' — ' || {rr(f'(flex * 30 - p_flex * {AS_OF.day})', f'(p_flex * {AS_OF.day})', 100)} || '% above last month'", f"{usd('flex')} || ' spent so far with {30 - AS_OF.day} days left. Last month was ' || {usd('p_flex')} || '.'",
        where=f"ym = '{YM}' and p_flex > 0 and flex * 30 * 100 > p_flex * {AS_OF.day} * 115"),
    "I10_A1": rule("A1", "anomaly", "6", f"'One charge made up ' || {rr('x.spent', 'total', 100)} || '% of your spending'", f"x.text[1:25] || ' · ' || {usd('x.spent')} || ' — that''s ' || {rr('x.spent * free_n', 'free')} || '× your average transaction. One-time or new recurring?'",
        src=f"m join (select r.*, row_number() over (partition by r.user_id, r.ym order by seq) as rn from r join m0 on m0.user_id = r.user_id and m0.ym = r.ym where is_flex and spent > 20000 and not {s.words('lower(text)', ins.LOAN_WORDS)} and free_n >= 3 and spent * free_n * 10 > free * 25) x on x.user_id = m.user_id and x.ym = m.ym and rn = 1"),
    "I11_A2": rule("A2", "anomaly", "8", f"category || ' is ' || {rr('x.spent * rn_', 'rs')} || '× your usual spend'", f"{usd('x.spent')} || ' this month vs your ' || {per('rs', 'rn_')} || ' average. One-time event or new pattern?'", "'View ' || category", "category",
        src="m join (select c.*, rs, rn_, row_number() over (partition by c.user_id, c.ym order by c.s) as rn from c join (select c.user_id, category, sum(c.spent) as rs, count(*) as rn_ from c join m1 on m1.user_id = c.user_id and m1.ym = c.ym where pos < n_months group by 1, 2 having count(*) >= 2) g using (user_id, category)) x on x.user_id = m.user_id and x.ym = m.ym and rn = 1",
        where="n_months >= 3 and x.spent * rn_ > rs * 3"),
    "I12_A3": rule("A3", "anomaly", "6", f"{title('trim(ft[1:20])')} || ' · ' || now || '× this month vs usual ' || {rr('hr', 'hm')} || '×'", f"'You visited ' || {tenths('now * hm', 'hr')} || '× more than usual. Small habit adding up?'",
        src="(select m.user_id, m.ym, n_months, l.ft, coalesce(k.n, 0) as now, l.months - (k.n is not null)::int as hm, l.rws - coalesce(k.n, 0) as hr, row_number() over (partition by m.user_id, m.ym order by l.fs) as rn from m join life l on l.user_id = m.user_id left join k on k.user_id = m.user_id and k.ym = m.ym and k.key = l.key where not (l.months = 1 and l.only_ym = m.ym)) m",
        where="rn = 1 and n_months >= 3 and hr >= hm * 2 and now * hm * 10 > hr * 25", ctes=f", {KEYLIFE}"),
    "I13_O2": rule("O2", "optimization", "7", s.case([(f"match_{i} >= 2", q(f"Overlapping {kind} subscriptions detected")) for i, (_, kind, _) in enumerate(v.SUBSCRIPTION_BUNDLES)], "null"),
        s.case([(f"match_{i} >= 2", f"{q(tip)} || '. You''re spending ' || {usd(f'bundle_{i}')} || '/mo on overlapping services.'") for i, (_, _, tip) in enumerate(v.SUBSCRIPTION_BUNDLES)], "null"), "'View subscriptions'", "'Subscriptions'",
        where=" or ".join(f"match_{i} >= 2" for i in range(len(v.SUBSCRIPTION_BUNDLES)))),
    "I14_F1": rule("F1", "fixed", "4", f"case when cln <> '' then cln else {title('xt[1:20]')} end || ' ' || case when chg > 0 then 'increased' else 'decreased' end || ' by ' || abs(chg) || '%'",
        f"{usd('fixed')} || ' this month vs ' || {usd('pfixed')} || ' last month.' || case when substr(ym, 6, 2)::int in (6, 7, 8) and contains(key, 'electric') then ' Expected in summer — AC usage peaks Jun-Aug.' when substr(ym, 6, 2) = '01' and contains(key, 'gym') then ' January gym spikes are common — worth tracking if it sticks.' when substr(ym, 6, 2)::int in (11, 12) then ' Common in holiday season — check for annual renewals.' else '' end",
        src=f"(select *, {rr('(fixed - pfixed)', 'pfixed', 100)} as chg, trim(substr({title(f'trim({s.sub('xt[1:20]', r'[\d\-\*]{4,}')})')}, 1, 25)) as cln from (select m.user_id, m.ym, a.key, a.fixed, a.xt, b.fixed as pfixed, row_number() over (partition by m.user_id, m.ym order by a.xs) as rn from m join k a on a.user_id = m.user_id and a.ym = m.ym and a.fixed_n > 0 join k b on b.user_id = m.user_id and b.ym = m.p_ym and b.key = a.key and b.fixed_n > 0)) m",
        where="rn = 1 and pfixed > 0 and abs(fixed - pfixed) * 10 > pfixed"),
    "I15_W2": rule("W2", "win", "case when coalesce(p_flex > 0 and p_flex * 10 < budget * 9, false) then 8 else 5 end",
        f"case when coalesce(p_flex > 0 and p_flex * 10 < budget * 9, false) then 'You''re ' || (100 - {rr('flex', 'budget', 100)}) || '% under budget — 2 months running' else 'On track — ' || {rr('flex', 'budget', 100)} || '% of budget used' end",
        f"case when coalesce(p_flex > 0 and p_flex * 10 < budget * 9, false) then {usd('(budget - flex)')} || ' still available. Solid discipline — that''s ' || {usd('((budget - flex) * 12)')} || '/year in savings if it holds.' else {usd('(budget - flex)')} || ' remaining. You''re managing well this month.' end",
        where="budget > 0 and flex * 10 < budget * 9"),
    "I16_W3": rule("W3", "win", "7", f"'Looks like you cancelled ' || {title('text[1:20]')}", f"'Saving ' || {usd('spent')} || '/mo — that''s ' || {usd('(spent * 12)')} || '/year back in your pocket.'",
        src="(select m.user_id, m.ym, n_months, r.text, r.spent, row_number() over (partition by m.user_id, m.ym order by r.seq) as rn from m join r on r.user_id = m.user_id and r.ym = m.p_ym and is_sub where exists (select 1 from sk where sk.user_id = m.user_id and sk.ym = m.pp_ym and sk.k10 = lower(r.text[1:10])) and not exists (select 1 from sk where sk.user_id = m.user_id and sk.ym = m.ym and sk.k10 = lower(r.text[1:10]))) m",
        where="rn = 1 and n_months >= 3", ctes=", sk as (select distinct user_id, ym, lower(text[1:10]) as k10 from r where is_sub)"),
    "I17_W4": rule("W4", "win", "9", "'Flexible spending down 2 months in a row'", f"{usd('pp_flex')} || ' → ' || {usd('p_flex')} || ' → ' || {usd('flex')} || '. You''re trending in the right direction. Keep going!'", where="pp_flex > 0 and p_flex < pp_flex and flex < p_flex"),
    "I18_W5": rule("W5", "win", "6", "'You dined out ' || (p_dining_n - dining_n) || ' fewer times than last month'", "dining_n || ' this month vs ' || p_dining_n || ' last month. Small habit, real savings.'",
        where=f"(ym <> '{YM}' or {AS_OF.day} >= 15) and p_dining_n > 0 and dining_n * 10 < p_dining_n * 8 and p_dining_n - dining_n <= 10"),
}


def wide(t, only=None):
    return ins.wide_months(t.ledger, d.budget_history(t), d.profile(t), only=only)


@query(
    "i0_partial_gate",
    f"""with {BASE} select user_id, ym, 'PARTIAL' as id, 'info' as type, 10::bigint as score, 'Only ' || n || ' transactions found for this month' as title,
 'Upload your complete statement for accurate insights and spending comparisons.' as body, 'Upload complete statement' as action, null::varchar as action_filter from m1 where n < 10 or coalesce(p_n > 0 and n * 10 < p_n * 4, false)""",
)
def i0(t):
    return ins.partial_months(wide(t, []))


def _register(key: str, sql: str) -> None:
    code = key.split("_")[1]
    number = key.split("_")[0].lower()

    @query(f"{number}_insight_{code.lower()}", sql)
    def run(t):
        return ins.candidates(wide(t, [code]), AS_OF, [code])


for _key, _sql in RULES.items():
    _register(_key, f"with {BASE}{_sql[0]} {_sql[1]}")

ENTRY = "{'id': id, 'type': type, 'score': score, 'title': title, 'body': body, 'action': action, 'action_filter': action_filter}"
RANKED = f"""with recursive {BASE}{''.join(dict.fromkeys(ctes for ctes, _ in RULES.values()))},
 cand as ({' union all '.join(f"select {at} as ord, * from ({sql})" for at, (_, sql) in enumerate(RULES.values()))}),
 o as (select user_id, ym, type, action_filter, {ENTRY} as e, row_number() over (partition by user_id, ym, type = 'win' order by score desc, ord) as rn from cand),
 w as (select user_id, ym, coalesce(list(e order by rn) filter (type = 'win'), []) as wins from o group by 1, 2),
 f as (select user_id, ym, 0::bigint as step, wins[1:1] as acc from w
  union all select f.user_id, f.ym, step + 1, case when len(acc) >= 6 or (len(acc) > 2 and len(list_filter(acc, lambda a: a.type = o.type)) > 0)
   or (o.action_filter is not null and len(list_filter(acc, lambda a: a.action_filter = o.action_filter)) > 0) then acc else list_append(acc, o.e) end
  from f join o on o.user_id = f.user_id and o.ym = f.ym and o.type <> 'win' and o.rn = f.step + 1),
 picked as (select user_id, ym, list_concat(arg_max(acc, step), any_value(wins[2:]))[1:6] as six from f join w using (user_id, ym) group by 1, 2),
 shown as (select user_id, ym, generate_subscripts(six, 1) as ord, unnest(six) as e from picked)
select user_id, ym, row_number() over (partition by user_id, ym order by e.type <> 'win', e.score desc, ord) - 1 as rank, e.id as id, e.type as type, e.score as score, e.title as title, e.body as body, e.action as action,
 e.action_filter as action_filter from shown
union all select user_id, ym, 0, 'PARTIAL', 'info', 10, 'Only ' || n || ' transactions found for this month', 'Upload your complete statement for accurate insights and spending comparisons.', 'Upload complete statement', null
 from m1 where n < 10 or coalesce(p_n > 0 and n * 10 < p_n * 4, false)"""


@query("i19_ranked_insights", RANKED)
def i19(t):
    """Order-dependent fold over a month's insights; the SQL folds with a recursion over the candidates by rank."""
    return ins.ranked_insights(wide(t), AS_OF)
