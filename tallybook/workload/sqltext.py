"""SQL text of the merchant, parsing and classification expressions, for the reference queries only."""

from __future__ import annotations

import re

from tallybook.functions import fixed_values as v
from tallybook.functions import merchants as mt
from tallybook.functions import parsing as ps
from tallybook.operators import classify as cl
from tallybook.workload.registry import title

# Date shapes with their group order, as the reference SQL tries them.
MONTHS, _MM, _DD = ps.MONTHS, ps._MM, ps._DD
MONTH_NUMBERS = {m: f"{i:02d}" for i, m in enumerate(MONTHS, 1)} | {m[:3]: f"{i:02d}" for i, m in enumerate(MONTHS, 1)}
_NAMES = "|".join(MONTHS + [m[:3] for m in MONTHS if len(m) > 3])
DATE_SHAPES = [
    (rf"^{_MM}/{_DD}/(\d{{4}})$", "mdy"), (rf"^{_MM}/{_DD}/(\d{{2}})$", "mdy"), (rf"^(\d{{4}})-{_MM}-{_DD}$", "ymd"),
    (rf"^{_MM}-{_DD}-(\d{{4}})$", "mdy"), (rf"^{_MM}-{_DD}-(\d{{2}})$", "mdy"),
    (rf"(?i)^({_NAMES})\s+{_DD}\s+(\d{{4}})$", "mdy"), (rf"(?i)^{_DD}\s+({_NAMES})\s+(\d{{4}})$", "dmy"),
    (rf"^(\d{{4}}){_MM}{_DD}$", "ymd"),
]
PARTIAL_SHAPES = [(r"^(\d{1,2})[/-](20\d{2})$", "my"), (r"^(20\d{2})[/-](\d{1,2})$", "ym"), (rf"^{_MM}/(\d{{4}})$", "my")]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, rep: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(rep)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def words(x: str, ws) -> str:
    return "(" + " or ".join(f"contains({x}, {q(w)})" for w in ws) + ")"


def squash(x: str) -> str:
    return f"trim({sub(x, r'\s+', ' ')})"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def chain(x: str, pairs) -> str:
    for p, r in pairs:
        x = sub(x, p, re.sub(r"\$(\d)", r"\\\1", r))
    return x


def low(x: str) -> str:
    return f"trim(lower(coalesce({x}, '')))"


def case(pairs, default: str) -> str:
    return "case " + " ".join(f"when {c} then {r}" for c, r in pairs) + f" else {default} end"


def cleaned_cols(x: str) -> str:
    """Lateral columns ending in `cleaned` and `merchant`."""
    c0 = chain(low(x), [("(?i)" + v.PROCESSOR_PREFIX, ""), (r"([a-z])(\d)", r"\1 \2"), (r"(\d)([a-z])", r"\1 \2")])
    c1 = case([(f"contains(c0, {q(a)})", f"replace(c0, {q(a)}, {q(r)})") for a, r in v.PRE_ALIASES.items()], "c0")
    cleaned = squash(chain("c1", [("(?i)" + p, " ") for p in v.STRIP_PATTERNS]))
    m = f"trim({sub('cleaned', r'^(sq\s*\*|tst\*?\s+|toast\s+)(.)', r'\2')})"
    m = f"trim({sub(m, r'^paypal\s*\*\s*(.)', r'\1')})"
    for a, r in v.ALIASES.items():
        m = f"trim(replace({m}, {q(a)}, {q(r)}))"
    return f"{c0} as c0, {c1} as c1, {cleaned} as cleaned, {m} as merchant"


def stem_cols(x: str) -> str:
    """Lateral columns ending in `stem`."""
    prefix = "|".join(re.escape(p) for p in v.STEM_PREFIXES)
    base = chain(low(x), [(mt.STEM_PROCESSOR, ""), (rf"^(?:[ \-*#]*(?:{prefix}))+", ""), (r"\d{4,}", ""), (r"[^a-z0-9 ]", " ")])
    pairs = [(f"base = {q(a)}", q(b)) for a, b in v.BRAND_STUBS.items()] + [(words("base", ns), q(b)) for b, ns in v.BRANDS.items()]
    fallback = f"trim(substr(array_to_string(list_filter({toks('base')}, lambda w: length(w) > 1)[1:2], ' '), 1, 32))"
    return f"{squash(base)} as base, {case(pairs, fallback)} as stem"


def recurrence_key(x: str) -> str:
    d = low(x)
    for w in mt.KEY_NOISE:
        d = f"replace({d}, {q(w)}, '')"
    d = squash(chain(d, [(r"\d{7,}", ""), (r"\b20\d{2}\b", "")]))
    d = f"trim({sub(d, rf'(^|\s)(?:{"|".join(v.MONTH_WORDS)})$')})"
    return f"trim(substr({d}, 1, 32))"


def dedup_cols(x: str) -> str:
    """Lateral columns ending in `dk`."""
    return f"{recurrence_key(x)} as rk, substr({sub('rk', '[^a-z]')}, 1, 4) as letters, case when letters <> '' then letters else substr(rk, 1, 4) end as dk"


def three_word_key(x: str) -> str:
    d = chain(f"lower(coalesce({x}, ''))", [(mt.STEM_PROCESSOR, ""), (r"[^a-z ]+", " ")])
    return f"array_to_string({toks(d)}[1:3], ' ')"


def learned_core_cols(x: str) -> str:
    k = squash(chain("cleaned", [(mt.LEARNED_PREFIX, ""), (mt.LEARNED_SUFFIX, " ")]))
    return f"{cleaned_cols(x)}, {k} as k0, trim(substr(case when k0 <> '' then k0 else cleaned end, 1, 24)) as core"


def credit_hint(x: str) -> str:
    tail = f"substr({sub(f'trim(lower(regexp_extract({x}, {q(r"-\s*(.+)")}, 1)))', r'\s+', ' ')}, 1, 20)"
    inline = case([(f"contains(lower({x}), {q(k)})", q(h)) for k, h in v.CREDIT_INLINE_HINTS.items()], "null")
    return f"case when {has(x, r'-\s*(.+)')} then {tail} else {inline} end"


def extraction_stem(x: str) -> str:
    d = sub(f"lower(coalesce({x}, ''))", mt.STEM_PROCESSOR)
    for p in mt.EXTRACTION_PREFIXES:
        d = sub(d, rf"^[ \-*#]*{re.escape(p)}")
    d = chain(d, [(r"\d{3,}", ""), (r"[^a-z0-9 ]", " ")])
    return f"array_to_string(list_filter({toks(d)}, lambda w: length(w) > 1)[1:2], ' ')"


def display_from(src: str, x: str) -> str:
    """Subquery over `src` adding `shown`; staged so that no alias is expanded more than once."""
    raw = f"trim(coalesce({x}, ''))"
    core = f"regexp_replace(w, {q(r'^[.,;:#*\-]+|[.,;:#*\-]+$')}, '', 'g')"
    d0 = chain("raw0", mt.DISPLAY_CUTS)
    d1 = f"array_to_string(list_filter({toks('d0')}, lambda w: not (length({core}) >= 6 and {has(core, mt.CODE_TOKEN)})), ' ')"
    d2 = squash(chain("d1", mt.DISPLAY_TAIL))
    hits = "list_filter(range(1, greatest(len(tk), 1)), lambda i: lower(tk[i + 1]) = lower(tk[1]))"
    cut = (
        "coalesce(case when len(tk) >= 6 then list_filter(hits, lambda i: i >= 3)[1] end,"
        " case when len(tk) >= 4 then list_filter(hits, lambda i: i >= 2)[1] end, case when len(tk) >= 2 then hits[1] end)"
    )
    wcore = f"regexp_replace(w, {q(r'[^\w+]+$')}, '')"
    acr = ", ".join(map(q, v.ACRONYMS))
    small = ", ".join(map(q, v.SMALL_WORDS))
    word = (
        f"case when upper({wcore}) in ({acr}) then upper({wcore}) when i > 1 and lower({wcore}) in ({small}) then lower({wcore})"
        f" else upper({wcore}[1:1]) || lower({wcore}[2:]) end || w[length({wcore}) + 1:]"
    )
    known = case([(f"lower(trim(cased)) = {q(k)}", q(n)) for k, n in v.KNOWN_MERCHANTS.items()], "cased")
    stages = [
        f"{raw} as raw0", f"{d0} as d0", f"{d1} as d1", f"{d2} as d2", f"{toks('d2')} as tk", f"{hits} as hits", f"{cut} as cut",
        "case when cut is not null then tk[1:cut] else tk end as kept", "array_to_string(kept, ' ') as d3",
        f"substr(array_to_string(list_transform(kept, lambda w, i: {word}), ' '), 1, 50) as cased", f"{known} as known",
        f"case when raw0 = '' then '' when d3 = '' then substr(raw0, 1, 50) when {has('lower(d3)', mt.HOA_NAME)} then 'HOA Payment' else known end as shown",
    ]
    out = src
    for st in stages:
        out = f"(select *, {st} from {out})"
    return out


def group_name_cols(x: str) -> str:
    """Lateral columns ending in `merchant`."""
    d = "low0"
    for p in (r"\b20\d{2}\b", r"\d{3}[-.] \d{3}[-.] \d{4}", r"\d{3}[-.]\d{3}[-.]\d{4}", r"\d{6,}", r"[*]"):
        d = sub(d, p)
    d = f"trim({sub(squash(d), rf'(^|\s)(?:{"|".join(v.MONTH_WORDS)})$')})"
    for _ in range(2):
        d = f"trim({sub(d, r'(^|\s)[a-z]{2}$')})"
    disp = case([(f"k4 = {q(k)}", q(n)) for k, n in v.DISPLAY_MAP.items()], "array_to_string(gw2, ' ')")
    return (
        f"trim(lower(coalesce({x}, ''))) as low0, substr({sub('low0', '[^a-z]')}, 1, 4) as k4, {d} as gd,"
        f" list_filter({toks(title('gd'))}, lambda w: length(w) > 1)[1:3] as gw,"
        " case when len(gw) > 0 and length(gw[-1]) >= 4 and not regexp_matches(gw[-1], '[aeiouAEIOU]') then gw[1:len(gw) - 1] else gw end as gw2,"
        f" {disp} as merchant"
    )


# ------------------------------------------------------------------ classification


def type_rules(x: str, income: bool) -> str:
    rules = [(v.STATEMENT_CREDIT_PATTERN, "card_credit"), (v.FINANCING_FEE_PATTERN, "fee"), (v.PAYMENT_SUMMARY_PATTERN, "summary"),
             (v.REIMBURSEMENT_PATTERN, "reimbursement"), (v.CASH_PATTERN, "cash"), (v.CC_PAYMENT_PATTERN, "credit_card_payment"),
             (cl.PERSON_TO_PERSON, "transfer"), (v.LOAN_PATTERN, "loan_payment")]
    rules += [(v.INCOME_PATTERN, "income")] if income else []
    pairs = [(has(x, "(?i)" + p), q(n)) for p, n in rules + [(v.REFUND_PATTERN, "refund")]]
    t = has(x, "(?i)" + v.TRANSFER_PATTERN)
    pairs += [(f"{t} and {has(x, cl.WALLETS)}", "'wallet'"), (t, "'transfer'")]
    return case(pairs, "'none'")


CATS = cl.CATEGORY_ORDER
KEY = {c: re.sub("[^a-z]", "", c.lower()) for c in CATS}


def hits_col(a: str = "cleaned", b: str = "merchant") -> str:
    items = [f"case when {has(a, '(?i)' + p)} or {has(b, '(?i)' + p)} then {i} end" for i, (p, _, _) in enumerate(v.CATEGORY_PATTERNS)]
    return f"list_filter([{', '.join(items)}], lambda i: i is not null)"


def score_cols() -> str:
    out = []
    for c in CATS:
        own = [i for i, (_, _, k) in enumerate(v.CATEGORY_PATTERNS) if k == c]
        terms = [f"case when list_contains(hits, {i}) then {v.CATEGORY_PATTERNS[i][1]} else 0 end" for i in own]
        first = case([(f"list_contains(hits, {i})", str(i)) for i in own], "null")
        out.append(f"nullif({' + '.join(terms)}, 0) as s_{KEY[c]}, {first} as o_{KEY[c]}")
    return ", ".join(out)


def adjusted(src: str) -> tuple[str, str]:
    """CTEs applying the context rules one after the other to relation `src`; returns (ctes, final name)."""
    n, m = "cleaned", "merchant"
    e = lambda w: f"(contains({n}, {q(w)}) or contains({m}, {q(w)}))"
    w = lambda *ws: words(n, ws)
    early = [
        w("etv", "zee5", "hotstar", "sonyliv", "jiocinema", "voot"),
        w("control mkt", "control market", "shoreline mkt", "farmers mkt", "farmers market", "public market"),
        w("marathon", "5k", "10k", "triathlon", "race.entry", "run.sign"),
        f"(contains({n}, 'mayuri') and {w('food', 'video', 'market')})",
        w("j crew", "jcrew", "br factory", "banana republic", "gap factory", "j. crew"),
        w("ikea india", "premium lifestyle", "lifestyle intl", "lifestyle international", "central square"),
        w("hudson st", "hudson news", "hudson bookseller", "seatac", "sea-tac"),
        f"(contains({n}, 'costco') and {w('gas', 'station', 'fuel')})",
        e("paddle"),
    ]
    ctes = [f"a0 as (select *, {case([(c, str(i + 1)) for i, c in enumerate(early)], '0')} as early from {src})"]
    step = [0]

    def edit(cond, cat, op, k):
        step[0] += 1
        s, o = f"s_{KEY[cat]}", f"o_{KEY[cat]}"
        new = f"coalesce({s}, 0) + {k}" if op == "+" else f"greatest(0, coalesce({s}, 0) - {k})"
        ctes.append(f"a{step[0]} as (select * replace (case when {cond} then {new} else {s} end as {s}, case when {cond} and {s} is null then {1000 + step[0]} else {o} end as {o}) from a{step[0] - 1})")

    for i, cat, k in ((1, "Subscriptions", 6), (2, "Groceries", 6), (3, "Health", 5), (5, "Shopping", 6), (6, "Shopping", 6), (7, "Travel", 6)):
        edit(f"early = {i}", cat, "+", k)
    u, eats, one = e("uber"), e("eats"), w("one")
    az, media, fresh = e("amazon"), w("prime", "music", "video", "audible", "kindle"), w("fresh")
    ap, apsub = e("apple"), w("apple subscription", "apple.com/bill", "itunes", "apple one", "apple music", "apple tv")
    g, gs = w("google"), w("youtube premium", "youtube tv", "google one", "google play")
    fs, care, cc = w("grocery", "food", "market", "fresh", "supercenter"), w("pharmacy", "optical", "vision"), w("costco")
    plan = [
        (f"{u} and {eats}", "Food & Dining", "+", 3), (f"{u} and {eats}", "Transport", "-", 3),
        (f"{u} and not {eats} and {one}", "Subscriptions", "+", 5), (f"{u} and not {eats} and {one}", "Transport", "-", 3),
        (f"{u} and not {eats} and not {one}", "Transport", "+", 2),
        (f"{az} and {media}", "Subscriptions", "+", 4), (f"{az} and {media}", "Shopping", "-", 2),
        (f"{az} and not {media} and {fresh}", "Groceries", "+", 4), (f"{az} and not {media} and {fresh}", "Shopping", "-", 2),
        (f"{az} and not {media} and not {fresh}", "Shopping", "+", 2),
        (f"{ap} and {apsub}", "Subscriptions", "+", 5), (f"{ap} and {apsub}", "Shopping", "-", 3),
        (f"{ap} and not {apsub} and {w('apple store')}", "Shopping", "+", 4), (f"{ap} and not {apsub} and {w('apple store')}", "Subscriptions", "-", 2),
        (f"{g} and {gs}", "Subscriptions", "+", 4), (f"{g} and not {gs} and {w('google ads', 'google cloud')}", "Subscriptions", "+", 2),
    ]
    for st in ("walmart", "target"):
        h = e(st)
        plan += [(f"{h} and {fs}", "Groceries", "+", 3), (f"{h} and {fs}", "Shopping", "-", 2), (f"{h} and not {fs} and {care}", "Health", "+", 3),
                 (f"{h} and not {fs} and {care}", "Shopping", "-", 2), (f"{h} and not {fs} and not {care}", "Shopping", "+", 2)]
    plan += [(f"{cc} and {care}", "Health", "+", 3), (f"{cc} and not {care} and {w('instacart', 'grocery', 'food')}", "Groceries", "+", 2)]
    for cond, cat, op, k in plan:
        edit(f"early = 0 and {cond}", cat, op, k)
    step[0] += 1
    wallet = f"early = 0 and {has(n, r'\b(paypal|venmo)\b')}"
    ctes.append(f"a{step[0]} as (select * replace ({', '.join(f's_{KEY[c]} - case when {wallet} then 1 else 0 end as s_{KEY[c]}' for c in CATS)}) from a{step[0] - 1})")
    edit(f"early = 0 and {has(n, r'tst|sq\s*\*|spring district')}", "Food & Dining", "+", 3)
    only = {4: "Groceries", 8: "Transport", 9: "Subscriptions"}
    reset = []
    for c in CATS:
        s = f"s_{KEY[c]}"
        keep = [(f"early = {i}", "6" if only[i] == c else "null") for i in only] + ([("early = 3", "null")] if c == "Transport" else [])
        reset.append(f"{case(keep, s)} as {s}")
    ctes.append(f"adjd as (select * replace ({', '.join(reset)}) from a{step[0]})")
    return ", ".join(ctes), "adjd"


def ranked_list() -> str:
    items = [f"case when s_{KEY[c]} is not null then {{'n': -s_{KEY[c]}, 'o': o_{KEY[c]}, 'c': {q(c)}}} end" for c in CATS]
    return f"list_sort(list_filter([{', '.join(items)}], lambda s: s is not null))"


def profile_ctes(source: str) -> str:
    """CTEs ending in `prof`: one row per distinct description of `source` (a select giving `description`)."""
    ctes, last = adjusted("sc")
    return (
        f"dd as (select distinct description from ({source})), cln as (select description, {cleaned_cols('description')} from dd),"
        f" ht as (select description, cleaned, merchant, {hits_col()} as hits from cln), sc as (select *, {score_cols()} from ht), {ctes},"
        f" rk as (select *, {ranked_list()} as ranked from {last}),"
        " prof as (select description, cleaned, merchant, hits, ranked, coalesce(ranked[1].c, 'Other') as best_category,"
        " case when len(ranked) = 0 then 'low' when -ranked[1].n >= 5 then 'high' when -ranked[1].n >= 3 then 'medium' else 'low' end as best_confidence,"
        " len(ranked) > 1 and -ranked[2].n >= 3 and abs(ranked[1].n - ranked[2].n) < 2 as close, len(ranked) = 0 or -ranked[1].n < 4 as weak,"
        " coalesce(close, false) or weak as best_review,"
        " case when len(ranked) = 0 and not regexp_matches(merchant, '[a-zA-Z]{3,}') then 'international_merchant' when len(ranked) = 0 then 'merchant_unknown'"
        " when coalesce(close, false) then 'multi_category_match' when weak then 'low_confidence' end as best_reason,"
        f" {type_rules('cleaned', True)} as rule_in, {type_rules('cleaned', False)} as rule_out,"
        f" {words('cleaned', v.SUMMARY_KEYWORDS)} or {has('cleaned', '(?i)' + v.PAYMENT_SUMMARY_PATTERN)} as is_summary,"
        f" {has('cleaned', cl.HOUSING_LOAN)} as is_housing, {has('cleaned', cl.SALARY_WORDS)} as is_salary from rk)"
    )


def typed(rule: str, up: str, bank: str) -> tuple[str, str]:
    """SQL of (type, reason)."""
    card = f"({' or '.join(f'contains(lower({bank}), {q(b)})' for b in v.POSITIVE_CHARGE_NAMES)})"
    t = case([(f"{rule} in ('fee', 'summary')", "'excluded'"), (f"{rule} = 'wallet'", "'transfer'"),
              (f"{rule} = 'none' and {up} and {card}", "'refund'"), (f"{rule} = 'none' and {up}", "'income'"), (f"{rule} = 'none'", "'expense'")], rule)
    r = case([(f"{rule} = 'fee'", "'financing_fee'"), (f"{rule} = 'summary'", "'payment_summary'"), (f"{rule} = 'wallet'", "'wallet_ambiguous'"),
              (f"{rule} = 'none' and {up} and not {card}", "'positive_amount_unclear'")], "null")
    return t, r


def decided(prefix: str = "") -> str:
    """Select list deciding rows that carry cents, bank_source, the profile columns and rule_* columns."""
    t, r = typed("rl", "cents > 0", "bank_source")
    other = case([("tt = 'income' and is_salary", "'Salary'")] + [(f"tt = {q(k)}", q(c)) for k, c in cl.TYPE_CATEGORIES.items()], "'Other'")
    rec = ", ".join(map(q, v.RECURRING_HINT_CATEGORIES))
    return (
        f"case when cents > 0 then rule_in else rule_out end as rl, {t} as tt, {r} as tr, is_summary or cents = 0 as sm,"
        " case when rule_id is not null then rule_type when sm then 'excluded' when tt in ('cash', 'loan_payment') then 'expense' else tt end as o_type,"
        " case when rule_id is not null then rule_category when sm then 'Other' when tt = 'cash' then 'Cash & ATM'"
        f" when tt = 'loan_payment' then case when is_housing then 'Rent/Mortgage' else 'Loan Payment' end when tt <> 'expense' then {other} else best_category end as o_category,"
        " case when rule_id is not null then rule_confidence when sm or tt in ('cash', 'loan_payment') then 'high' when tt <> 'expense' then case when tr is null then 'high' else 'low' end else best_confidence end as o_confidence,"
        " case when rule_id is not null or sm or tt in ('cash', 'loan_payment') then false when tt <> 'expense' then tr is not null else best_review or coalesce(best_reason = 'international_merchant', false) end as o_review,"
        " case when rule_id is not null then null when sm then 'summary_row' when tt in ('cash', 'loan_payment') then null when tt <> 'expense' then tr else best_reason end as o_reason,"
        f" case when rule_id is null and sm then false when rule_id is null and tt = 'cash' then false when rule_id is null and tt = 'loan_payment' then true else o_category in ({rec}) end as o_hint"
    )


# ------------------------------------------------------------------ parsing


def parse_date(x: str) -> str:
    """Lateral-free SQL of the date parser over text `x`."""
    raw, flat = f"trim({x})", f"trim(replace({x}, ',', ''))"
    months = "{" + ", ".join(f"{q(k)}: {q(n)}" for k, n in MONTH_NUMBERS.items()) + "}"
    months = "map " + months

    def one(src, shape, order):
        pos = {k: i for i, k in enumerate(order, 1)}
        g = lambda k: f"regexp_extract({src}, {q(shape)}, {pos[k]})"
        year = f"case when length({g('y')}) = 2 then case when {g('y')} >= '69' then '19' else '20' end || {g('y')} else {g('y')} end"
        month = f"coalesce(({months})[lower({g('m')})], lpad({g('m')}, 2, '0'))"
        day = f"lpad({g('d')}, 2, '0')" if "d" in order else "'01'"
        return f"case when {has(src, shape)} then try_cast({year} || '-' || {month} || '-' || {day} as date) end"

    parts = [one(raw, s, o) for s, o in PARTIAL_SHAPES[:2]] + [one(flat, s, o) for s, o in DATE_SHAPES] + [one(flat, *PARTIAL_SHAPES[2])]
    return f"coalesce({', '.join(parts)})"


def issuer_text(x: str) -> str:
    return case([(f"contains(lower(substr({x}, 1, 3000)), {q(k)})", q(n)) for k, n in v.ISSUER_KEYWORDS.items()], "null")


def mask_cols(x: str) -> str:
    """Lateral columns ending in `masked`."""
    g = ps.GROUPED_ACCOUNT
    digits = "regexp_replace(z, '\\D', '', 'g')"
    one = f"case when length({digits}) between 13 and 19 then '****' || right({digits}, 4) else z end"
    return (
        f"{chain(x, [(ps.MASKED_ACCOUNT, '****$1'), (ps.LONG_ACCOUNT, '****$1')])} as m0, regexp_extract_all(m0, {q(g)}) as mf,"
        f" string_split_regex(m0, {q(g)}) as mb,"
        f" case when len(mf) = 0 then m0 else mb[1] || array_to_string(list_transform(mf, lambda z, i: {one} || mb[i + 1]), '') end as masked"
    )
