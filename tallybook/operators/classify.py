"""Transaction type and category classification.

Text work runs once per distinct descriptor (`text_profile`), never per ledger row; rows pick their result by an equi
join that adaptive execution can split when one descriptor dominates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.columns import col, contains_any, distinct_texts, first_match
from tallybook.functions import fixed_values as v
from tallybook.functions import parsing as p
from tallybook.functions.merchants import clean_description, merchant_alias
from tallybook.functions.patterns import substring_reader
from tallybook.functions.signals import is_recurring_hint
from tallybook.sources.sinks import stored

# Fixed values of the type rules and their non-expense categories.
PERSON_TO_PERSON = r"\b(zelle|venmo|cash.?app|apple.?cash)\b"
WALLETS = r"\b(venmo|paypal)\b"
SALARY_WORDS = r"\b(payroll|salary|wages|stripe|adp|paychex|gusto)\b"
HOUSING_LOAN = (
    r"\b(mortgage|mtg|rent|lease|hoa|home.?loan|escrow|lakeview|rocket.?mortgage|nationstar|mr.?cooper|pennymac|"
    r"loandepot|freedom.?mortgage|quicken.?loan)\b"
)
TYPE_CATEGORIES = {
    "credit_card_payment": "Credit Card Payment", "card_credit": "Card Credit", "transfer": "Transfer", "refund": "Refund",
    "reimbursement": "Refund",
}
RULE_MATCH_ORDER = {"exact": 0, "starts_with": 1, "contains": 2, "regex": 3}
CATEGORY_ORDER = list(dict.fromkeys(c for _, _, c in v.CATEGORY_PATTERNS))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def _type_rules(text: Column, with_income: bool) -> Column:
    """Name of the first type rule that fires on cleaned text; 'none' when only the sign can tell."""
    rules = [
        (v.STATEMENT_CREDIT_PATTERN, "card_credit"), (v.FINANCING_FEE_PATTERN, "fee"), (v.PAYMENT_SUMMARY_PATTERN, "summary"),
        (v.REIMBURSEMENT_PATTERN, "reimbursement"), (v.CASH_PATTERN, "cash"), (v.CC_PAYMENT_PATTERN, "credit_card_payment"),
        (PERSON_TO_PERSON, "transfer"), (v.LOAN_PATTERN, "loan_payment"),
    ]
    if with_income:
        rules.append((v.INCOME_PATTERN, "income"))
    cases = [(_has(text, pattern), name) for pattern, name in rules] + [(_has(text, v.REFUND_PATTERN), "refund")]
    cases += [(_has(text, v.TRANSFER_PATTERN) & _has(text, WALLETS), "wallet"), (_has(text, v.TRANSFER_PATTERN), "transfer")]
    return first_match(cases, "none")


def resolve_type(rule_in: Column | str, rule_out: Column | str, amount: Column | str, bank: Column | str) -> Column:
    """struct(type, reason) from the rule for positive (`rule_in`) or other (`rule_out`) amounts."""
    up = col(amount) > 0
    rule = F.when(up, col(rule_in)).otherwise(col(rule_out))
    card_bank = contains_any(F.lower(F.coalesce(col(bank), F.lit(""))), v.POSITIVE_CHARGE_NAMES)
    made = lambda t, r=None: F.struct(F.lit(t).alias("type") if isinstance(t, str) else t.alias("type"), F.lit(r).cast("string").alias("reason"))
    return first_match(
        [
            (rule == "fee", made("excluded", "financing_fee")),
            (rule == "summary", made("excluded", "payment_summary")),
            (rule == "wallet", made("transfer", "wallet_ambiguous")),
            ((rule == "none") & up & card_bank, made("refund")),
            ((rule == "none") & up, made("income", "positive_amount_unclear")),
            (rule == "none", made("expense")),
        ],
        made(rule),
    )


def transaction_type(cleaned: Column | str, amount: Column | str, bank: Column | str) -> Column:
    text = col(cleaned)
    return resolve_type(_type_rules(text, True), _type_rules(text, False), amount, bank)


# ------------------------------------------------------------------ category scores


def pattern_hits(cleaned: Column | str, merchant: Column | str) -> Column:
    """Indexes of the category patterns found in the cleaned text or the merchant."""
    a, b = col(cleaned), col(merchant)
    found = [F.when(_has(a, pat) | _has(b, pat), F.lit(i)) for i, (pat, _, _) in enumerate(v.CATEGORY_PATTERNS)]
    # A few small arrays instead of one huge expression keep the generated code under the JVM method limit.
    step = 20
    chunks = [F.array(*found[i : i + step]) for i in range(0, len(found), step)]
    return F.filter(F.flatten(F.array(*chunks)), lambda i: i.isNotNull())


def scores_from_hits(hits: Column | str) -> Column:
    """array<struct(category, score, ord)>: summed scores, ordered by the first pattern that matched."""
    points = F.array(*[F.lit(s) for _, s, _ in v.CATEGORY_PATTERNS])
    owner = F.array(*[F.lit(CATEGORY_ORDER.index(c)) for _, _, c in v.CATEGORY_PATTERNS])
    names = F.array(*[F.lit(c) for c in CATEGORY_ORDER])
    h = col(hits)
    present = F.array_distinct(F.transform(h, lambda i: F.get(owner, i)))

    def total(c: Column) -> Column:
        own = F.filter(h, lambda i: F.get(owner, i) == c)
        score = F.aggregate(own, F.lit(0), lambda acc, i: acc + F.get(points, i))
        return F.struct(F.get(names, c).alias("category"), score.alias("score"), F.get(own, F.lit(0)).alias("ord"))

    return F.transform(present, total)


class _Adjust:
    """One sequential adjustment of the score vector: conditions are plain columns, the vector stays one array."""

    def __init__(self):
        self.step = 0

    def _edit(self, scores: Column, cond: Column, category: str, new) -> Column:
        self.step += 1
        order = 1000 + self.step
        has = F.exists(scores, lambda s: s["category"] == category)
        replace = F.transform(
            scores,
            lambda s: F.when(s["category"] == category, F.struct(s["category"].alias("category"), new(s["score"]).alias("score"), s["ord"].alias("ord"))).otherwise(s),
        )
        append = F.concat(scores, F.array(F.struct(F.lit(category).alias("category"), new(F.lit(0)).alias("score"), F.lit(order).alias("ord"))))
        return F.when(~cond, scores).when(has, replace).otherwise(append)

    def add(self, scores, cond, category, n):
        return self._edit(scores, cond, category, lambda s: s + n)

    def cut(self, scores, cond, category, n):
        return self._edit(scores, cond, category, lambda s: F.greatest(F.lit(0), s - n))


def adjust_scores(df: DataFrame) -> DataFrame:
    """Adds `adjusted`: context rules for merchants that span categories; the first group of rules ends the adjustment.

    Each rule is its own projection over the carried vector, so no expression nests deeper than one rule.
    """
    n, m, s0 = F.col("cleaned"), F.col("merchant"), F.col("scores")
    has = lambda *words: contains_any(n, words)
    either = lambda w: n.contains(w) | m.contains(w)
    adj = _Adjust()
    only = lambda cat: F.array(F.struct(F.lit(cat).alias("category"), F.lit(6).alias("score"), F.lit(0).alias("ord")))
    yes = F.lit(True)
    final = [
        (has("etv", "zee5", "hotstar", "sonyliv", "jiocinema", "voot"), adj.add(s0, yes, "Subscriptions", 6)),
        (has("control mkt", "control market", "shoreline mkt", "farmers mkt", "farmers market", "public market"), adj.add(s0, yes, "Groceries", 6)),
        (
            has("marathon", "5k", "10k", "triathlon", "race.entry", "run.sign"),
            F.filter(adj.add(s0, yes, "Health", 5), lambda s: s["category"] != "Transport"),
        ),
        (n.contains("mayuri") & has("food", "video", "market"), only("Groceries")),
        (has("j crew", "jcrew", "br factory", "banana republic", "gap factory", "j. crew"), adj.add(s0, yes, "Shopping", 6)),
        (has("ikea india", "premium lifestyle", "lifestyle intl", "lifestyle international", "central square"), adj.add(s0, yes, "Shopping", 6)),
        (has("hudson st", "hudson news", "hudson bookseller", "seatac", "sea-tac"), adj.add(s0, yes, "Travel", 6)),
        (n.contains("costco") & has("gas", "station", "fuel"), only("Transport")),
        (either("paddle"), only("Subscriptions")),
    ]
    uber, eats, one = either("uber"), either("eats"), n.contains("one")
    amazon, media, fresh = either("amazon"), has("prime", "music", "video", "audible", "kindle"), n.contains("fresh")
    apple = either("apple")
    apple_sub = has("apple subscription", "apple.com/bill", "itunes", "apple one", "apple music", "apple tv")
    google = n.contains("google")
    google_sub = has("youtube premium", "youtube tv", "google one", "google play")
    food_store, care = has("grocery", "food", "market", "fresh", "supercenter"), has("pharmacy", "optical", "vision")
    costco = n.contains("costco")
    edits = [
        (adj.add, uber & eats, "Food & Dining", 3), (adj.cut, uber & eats, "Transport", 3),
        (adj.add, uber & ~eats & one, "Subscriptions", 5), (adj.cut, uber & ~eats & one, "Transport", 3),
        (adj.add, uber & ~eats & ~one, "Transport", 2),
        (adj.add, amazon & media, "Subscriptions", 4), (adj.cut, amazon & media, "Shopping", 2),
        (adj.add, amazon & ~media & fresh, "Groceries", 4), (adj.cut, amazon & ~media & fresh, "Shopping", 2),
        (adj.add, amazon & ~media & ~fresh, "Shopping", 2),
        (adj.add, apple & apple_sub, "Subscriptions", 5), (adj.cut, apple & apple_sub, "Shopping", 3),
        (adj.add, apple & ~apple_sub & n.contains("apple store"), "Shopping", 4),
        (adj.cut, apple & ~apple_sub & n.contains("apple store"), "Subscriptions", 2),
        (adj.add, google & google_sub, "Subscriptions", 4),
        (adj.add, google & ~google_sub & has("google ads", "google cloud"), "Subscriptions", 2),
    ]
    for store in ("walmart", "target"):
        here = either(store)
        edits += [
            (adj.add, here & food_store, "Groceries", 3), (adj.cut, here & food_store, "Shopping", 2),
            (adj.add, here & ~food_store & care, "Health", 3), (adj.cut, here & ~food_store & care, "Shopping", 2),
            (adj.add, here & ~food_store & ~care, "Shopping", 2),
        ]
    edits += [
        (adj.add, costco & care, "Health", 3),
        (adj.add, costco & ~care & has("instacart", "grocery", "food"), "Groceries", 2),
    ]
    df = df.withColumn("adjusted", s0)
    carried = F.col("adjusted")
    for edit, cond, category, k in edits:
        df = df.withColumn("adjusted", edit(carried, cond, category, k))
    lower = F.transform(carried, lambda x: F.struct(x["category"].alias("category"), (x["score"] - 1).alias("score"), x["ord"].alias("ord")))
    df = df.withColumn("adjusted", F.when(n.rlike(r"\b(paypal|venmo)\b"), lower).otherwise(carried))
    df = df.withColumn("adjusted", adj.add(carried, n.rlike(r"tst|sq\s*\*|spring district"), "Food & Dining", 3))
    return df.withColumn("adjusted", first_match(final, carried))


def verdict(scores: Column | str) -> Column:
    """struct(category, confidence, needs_review, reason) of a score vector."""
    ranked = F.array_sort(F.transform(col(scores), lambda s: F.struct((-s["score"]).alias("n"), s["ord"].alias("o"), s["category"].alias("c"))))

    def judge(r: Column) -> Column:
        top, second = -F.get(r, F.lit(0))["n"], -F.get(r, F.lit(1))["n"]
        conf = F.when(top >= 5, "high").when(top >= 3, "medium").otherwise("low")
        close = F.coalesce((second >= 3) & (F.abs(top - second) < 2), F.lit(False))
        weak = top < 4
        reason = F.when(close, "multi_category_match").when(weak, "low_confidence")
        known = F.struct(F.get(r, F.lit(0))["c"].alias("category"), conf.alias("confidence"), (close | weak).alias("needs_review"), reason.alias("reason"))
        unknown = F.struct(F.lit("Other").alias("category"), F.lit("low").alias("confidence"), F.lit(True).alias("needs_review"), F.lit("merchant_unknown").alias("reason"))
        return F.when(F.size(r) == 0, unknown).otherwise(known)

    return F.transform(F.array(ranked), judge)[0]


# ------------------------------------------------------------------ distinct-descriptor profile


def cleaned_texts(rows: DataFrame, text: str = "description") -> DataFrame:
    """(description, cleaned) of the distinct descriptors, written below the shared checkpoint folder."""
    return stored(rows.select(F.col(text).alias("description")).distinct().withColumn("cleaned", clean_description("description")), "cleaned")


def named_texts(rows: DataFrame, text: str = "description") -> DataFrame:
    """(description, cleaned, merchant) of the distinct descriptors; the merchant is worked out once per cleaned text."""
    d = cleaned_texts(rows, text)
    names = distinct_texts(d, "cleaned", "cleaned").withColumn("merchant", merchant_alias("cleaned"))
    return d.join(stored(names, "merchants"), "cleaned").select("description", "cleaned", "merchant")


def _name_profile(names: DataFrame) -> DataFrame:
    """What classification needs of a cleaned text."""
    d = names.withColumn("merchant", merchant_alias("cleaned"))
    d = d.withColumn("hits", pattern_hits("cleaned", "merchant"))
    d = d.withColumn("scores", scores_from_hits("hits"))
    d = adjust_scores(d)
    d = d.withColumn("v", verdict("adjusted"))
    c = F.col("cleaned")
    foreign = (F.col("v.category") == "Other") & ~F.col("merchant").rlike("[a-zA-Z]{3,}")
    return d.select(
        *names.columns, "merchant", "hits", "scores", "adjusted",
        F.col("v.category").alias("best_category"), F.col("v.confidence").alias("best_confidence"),
        F.col("v.needs_review").alias("best_review"),
        F.when(foreign, "international_merchant").otherwise(F.col("v.reason")).alias("best_reason"),
        _type_rules(c, True).alias("rule_in"), _type_rules(c, False).alias("rule_out"),
        p.is_summary_row("cleaned", F.lit(1)).alias("is_summary"), c.rlike(HOUSING_LOAN).alias("is_housing"),
        c.rlike(SALARY_WORDS).alias("is_salary"),
    )


def text_profile(rows: DataFrame, text: str = "description") -> DataFrame:
    """Everything classification needs from the text alone, one row per distinct descriptor.

    Descriptors are cleaned first; patterns and scores are worked out once per distinct cleaned text, of which there are never
    more, and written, so that Spark knows their size and moves them to the descriptors where they are few.

    Use explode_outer on the array columns: a plain explode infers a size filter that the optimizer would push through
    the staged projections, repeating their expressions.
    """
    if rows.isStreaming:
        d = _name_profile(distinct_texts(rows, text).withColumn("cleaned", clean_description("description")))
    else:
        d = cleaned_texts(rows, text)
        d = d.join(stored(_name_profile(distinct_texts(d, "cleaned", "cleaned")), "profile"), "cleaned")
    return d.select(
        "description", *[c for c in d.columns if c != "description"],
        p.exclusion_of("description").alias("exclusion"), p.is_statement_credit("description").alias("is_credit"))


RESULT = ["transaction_type", "category", "confidence", "needs_review", "review_reason", "recurring_hint"]


def decide(profiled: DataFrame) -> DataFrame:
    """Type, category, confidence and review flags of rows joined with their profile and best rule (rule_* columns)."""
    t = resolve_type("rule_in", "rule_out", "amount", "bank_source")
    df = profiled.withColumn("t", t)
    summary = F.col("is_summary") | (F.coalesce(F.col("amount"), F.lit(0)) == 0)
    ruled = F.col("rule_id").isNotNull()
    kind, why = F.col("t.type"), F.col("t.reason")
    other = first_match(
        [(kind == "income", F.when(F.col("is_salary"), "Salary").otherwise("Other"))] + [(kind == k, c) for k, c in TYPE_CATEGORIES.items()],
        "Other",
    )
    loan = F.when(F.col("is_housing"), "Rent/Mortgage").otherwise("Loan Payment")

    def pack(ttype, category, confidence, review, reason):
        parts = zip(RESULT, (ttype, category, confidence, review, reason))
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("boolean" if k == "needs_review" else "string").alias(k) for k, x in parts])

    result = first_match(
        [
            (ruled, pack(F.col("rule_type"), F.col("rule_category"), F.col("rule_confidence"), False, None)),
            (summary, pack("excluded", "Other", "high", False, "summary_row")),
            (kind == "cash", pack("expense", "Cash & ATM", "high", False, None)),
            (kind == "loan_payment", pack("expense", loan, "high", False, None)),
            (kind != "expense", pack(kind, other, F.when(why.isNull(), "high").otherwise("low"), why.isNotNull(), why)),
        ],
        pack("expense", F.col("best_category"), F.col("best_confidence"), F.col("best_review") | F.col("best_reason").eqNullSafe("international_merchant"), F.col("best_reason")),
    )
    df = df.withColumn("r", result)
    hint = F.when(~ruled & summary, False).when(~ruled & (kind == "cash"), False).when(~ruled & (kind == "loan_payment"), True)
    df = df.withColumn("recurring_hint", hint.otherwise(is_recurring_hint("r.category")))
    return df.drop("category", "transaction_type", "needs_review", "confidence").select("*", "r.*").drop("r", "t")


#: Anchors are cut to a power of two of characters, so that a text has few lengths of substrings to look up.
ANCHOR_LENGTHS = [1, 2, 4, 8, 16, 32]


def _anchor(text: Column) -> Column:
    """The start of a text that stands for it in equi joins."""
    return first_match([(F.length(text) >= n, F.substring(text, 1, n)) for n in reversed(ANCHOR_LENGTHS)], text)


def _substrings(text: Column, lengths: Column) -> Column:
    """Distinct substrings of the given lengths."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(lengths, of)))


SHARED = "*"


def refusal(how: Column | str, value: Column | str) -> Column:
    """Why a rule can never match (an empty value, a pattern the regex engine refuses), else NULL."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("(?i)"), value))
    how = F.col(how) if isinstance(how, str) else how
    return F.when(F.col(value) == "", "empty value").when((how == "regex") & compiled.isNull(), "invalid pattern")


def rejected_rules(rules: DataFrame) -> DataFrame:
    """(id, reason) of the active rules that matching leaves out."""
    r = rules.filter(F.coalesce("is_active", F.lit(True)))
    r = r.select("id", F.coalesce("match_type", F.lit("contains")).alias("how"), F.lower(F.coalesce("match_value", F.lit(""))).alias("value"))
    return r.select("id", refusal("how", "value").alias("reason")).filter("reason is not null")


def best_named_rules(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Best matching rule (`best`) of each (rule_user, cleaned, merchant); rule_user is '*' for global rules.

    Exact, prefix, substring and regex rules meet the texts by equi joins (on the value, on the start of the value, on anchors
    that are then verified: the starts of the plain substrings that a pattern's structure requires, one for each alternative).
    Anchors are as long as their substrings allow, up to a power of two, and texts are cut only to lengths that occur in their
    scope; only patterns that require no plain character at all, such as \\d+, are compared with every text of their scope.
    Equal rules collapse to the best one first and are written, so that Spark knows how many they are; the winner is kept by a
    map-side-combining min, so a rule that matches everything never builds one big group. Invalid patterns are left out
    (`rejected_rules`).
    """
    order = F.struct((-F.col("priority")).alias("p"), first_match([(F.col("how") == h, n) for h, n in RULE_MATCH_ORDER.items()], 2).alias("h"), F.col("id"))
    r = rules.filter(F.coalesce("is_active", F.lit(True))).select(
        "id", F.coalesce("user_id", F.lit(SHARED)).alias("rule_user"), F.when(F.coalesce("match_field", F.lit("merchant")) == "merchant", "merchant").otherwise("description").alias("field"),
        F.lower(F.coalesce("match_value", F.lit(""))).alias("value"), F.coalesce("match_type", F.lit("contains")).alias("how"),
        F.coalesce("priority", F.lit(0)).cast("long").alias("priority"), F.coalesce("transaction_type", F.lit("expense")).alias("rule_type"),
        F.coalesce("category", F.lit("Other")).alias("rule_category"),
        F.when(F.coalesce("confidence_override", F.lit(0.0)) >= 0.8, "high").otherwise("medium").alias("rule_confidence"),
    ).filter(refusal("how", "value").isNull())
    pick = F.struct(F.col("id").alias("rule_id"), "rule_type", "rule_category", "rule_confidence")
    r = r.groupBy("rule_user", "field", "how", "value").agg(F.min(F.struct(order.alias("o"), pick.alias("b"))).alias("best"))
    required = F.udf(substring_reader(), "array<string>")
    anchors = F.when(F.col("how") == "regex", required("value")).otherwise(F.array("value"))
    anchors = F.array_distinct(F.transform(anchors, _anchor))
    r = stored(r.withColumn("anchor", F.explode_outer(anchors)), "rules")
    own = names.join(r.select("rule_user").distinct(), "rule_user", "left_semi")
    both = F.explode(F.array(
        F.struct(F.lit("merchant").alias("field"), F.col("merchant").alias("target")),
        F.struct(F.lit("description").alias("field"), F.col("cleaned").alias("target"))))
    t = own.select("*", both.alias("x")).select("*", "x.*").drop("x")
    keys = ["rule_user", "field"]
    as_written = F.rlike("target", F.concat(F.lit("(?i)"), "value"))

    def pieces(ruled: DataFrame, text: Column, cut) -> DataFrame:
        lengths = ruled.groupBy(*keys).agg(F.collect_set(F.length("anchor")).alias("_lengths"))
        return t.join(lengths, keys).withColumn("anchor", F.explode(cut(text, F.col("_lengths")))).drop("_lengths").join(ruled, [*keys, "anchor"])

    exact = t.withColumnRenamed("target", "value").join(r.filter("how = 'exact'"), [*keys, "value"])
    prefixes = lambda text, ks: F.transform(F.filter(ks, lambda k: F.length(text) >= k), lambda k: F.substring(text, F.lit(1), k))
    starts = pieces(r.filter("how = 'starts_with'"), F.col("target"), prefixes).filter(F.col("target").startswith(F.col("value")))
    found = F.when(F.col("how") == "contains", F.col("target").contains(F.col("value"))).otherwise(as_written)
    inside = pieces(r.filter("how in ('contains', 'regex') and anchor is not null"), F.lower("target"), _substrings).filter(found)
    loose = t.join(r.filter("how = 'regex' and anchor is null"), keys).filter(as_written)
    cols = ["rule_user", "cleaned", "merchant", "best"]
    hits = exact.select(*cols).unionByName(starts.select(*cols)).unionByName(inside.select(*cols)).unionByName(loose.select(*cols))
    return hits.groupBy(*cols[:3]).agg(F.min("best").alias("best")).withColumn("best", F.col("best.b"))


def _best_of_scopes(texts: DataFrame, rules: DataFrame, user_texts: DataFrame) -> DataFrame:
    """`best_named_rules` of all texts for global rules and of each user's own texts for that user's rules."""
    owners = rules.select(F.col("user_id").alias("rule_user")).distinct()
    own = user_texts.select(F.col("user_id").alias("rule_user"), "description").join(owners, "rule_user", "left_semi").join(texts, "description")
    scoped = own.select("rule_user", "cleaned", "merchant").unionByName(texts.select(F.lit(SHARED).alias("rule_user"), "cleaned", "merchant"))
    return best_named_rules(stored(scoped.distinct(), "names"), rules)


def best_rules(texts: DataFrame, rules: DataFrame, user_texts: DataFrame) -> DataFrame:
    """Best matching rule per (rule_user, description); rule_user is '*' for global rules.

    `texts` is (description, cleaned, merchant), `user_texts` the (user_id, description) pairs that occur. A user's rules
    meet only that user's texts. Rules meet distinct names (cleaned text and merchant), see `best_named_rules`.
    """
    best = _best_of_scopes(texts, rules, user_texts)
    scoped = user_texts.select(F.col("user_id").alias("rule_user"), "description").distinct().join(texts, "description")
    scoped = scoped.select("rule_user", "description", "cleaned", "merchant").unionByName(texts.select(F.lit(SHARED).alias("rule_user"), "description", "cleaned", "merchant"))
    named = best.select(*[F.col(c).alias(f"_{c}") for c in ("rule_user", "cleaned", "merchant")], "best")
    same = [scoped[c].eqNullSafe(named[f"_{c}"]) for c in ("rule_user", "cleaned", "merchant")]
    return scoped.join(named, same).select("rule_user", "description", "best").distinct()


def user_texts(rows: DataFrame, text: str) -> DataFrame:
    """Distinct (user_id, description) of rows, written below the shared checkpoint folder."""
    return stored(rows.select("user_id", F.col(text).alias("description")).distinct(), "pairs")


def with_best_rule(rows: DataFrame, texts: DataFrame, rules: DataFrame, text: str, pairs: DataFrame | None = None) -> DataFrame:
    """Adds `best` (the user's rule before a global one) and `rule_scope`.

    `texts` is (description, cleaned, merchant); rows that have cleaned and merchant are not joined with it. `pairs` is
    `user_texts` of the rows, where it is known.
    """
    texts = stored(texts, "texts")
    best = stored(_best_of_scopes(texts, rules, user_texts(rows, text) if pairs is None else pairs), "best")
    name = ["cleaned", "merchant"]
    own = best.filter(F.col("rule_user") != SHARED).select(F.col("rule_user").alias("user_id"), *name, F.col("best").alias("own"))
    everyone = best.filter(F.col("rule_user") == SHARED).select(*name, F.col("best").alias("shared"))
    named = set(name) <= set(rows.columns)
    if not named:
        rows = rows.join(texts.withColumnRenamed("description", text).select(text, *name), text, "left")
    rows = rows.join(own, ["user_id", *name], "left").join(everyone, name, "left")
    given = F.col(text).isNotNull()
    own, shared = F.when(given, F.col("own")), F.when(given, F.col("shared"))
    scope = F.when(own.isNotNull(), "user").when(shared.isNotNull(), "global").otherwise("classifier")
    rows = rows.withColumn("best", F.coalesce(own, shared)).withColumn("rule_scope", scope).drop("own", "shared")
    return rows if named else rows.drop(*name)


def classify(ledger: DataFrame, rules: DataFrame | None = None, text: str = "description") -> DataFrame:
    """Full classification of ledger rows: the user's rule, a global rule, or the text profile with the amount's sign.

    Every row stays; a missing text counts as an empty one.
    """
    pairs = None
    if rules is None:
        profile = text_profile(ledger.withColumn(text, F.coalesce(text, F.lit(""))), text)
    else:
        # The ledger is read twice: for its distinct texts by user, and for its rows.
        pairs = user_texts(ledger, text)
        profile = text_profile(pairs.withColumn("description", F.coalesce("description", F.lit(""))))
    keyed = profile.withColumnRenamed("description", "_text")
    rows = ledger.join(keyed, F.coalesce(ledger[text], F.lit("")) == keyed["_text"]).drop("_text")
    empty = F.lit(None).cast("struct<rule_id:bigint,rule_type:string,rule_category:string,rule_confidence:string>")
    if rules is None:
        rows = rows.withColumn("best", empty)
    else:
        rows = with_best_rule(rows, profile.select("description", "cleaned", "merchant"), rules, text, pairs)
    return decide(rows.select("*", "best.*").drop("best"))


def enrich(raw: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Final type, category and confidence of parsed statement rows.

    Precedence: a layout parser's card credit, fee or summary text, statement-credit text, then the classifier with the
    parser's trusted types, a file-format hint, and the issuer's own category filling in where it is unsure.
    Expects parser_type, type_hint, raw_category and source next to the ledger columns.
    """
    c = classify(raw, rules)
    trusted = F.col("parser_type").isin("refund", "card_credit", "credit_card_payment", "loan_payment")
    layout_credit = F.col("source").endswith("_xy") & (F.col("parser_type") == "card_credit")
    fee = F.col("exclusion").isNotNull()
    conf1 = F.when(trusted, "high").otherwise(F.col("confidence"))
    type1 = F.when(trusted, F.col("parser_type")).otherwise(F.col("transaction_type"))
    hinted = F.col("type_hint").isNotNull() & (F.col("type_hint") != "unknown") & (conf1 != "high")
    type2, conf2 = F.when(hinted, F.col("type_hint")).otherwise(type1), F.when(hinted, "high").otherwise(conf1)
    own = p.canonical_category("raw_category")
    use_own = (F.coalesce("raw_category", F.lit("")) != "") & (type2 == "expense") & (conf2 != "high") & (own != "Other")
    credit = F.coalesce(layout_credit, F.lit(False)) | (~fee & F.col("is_credit"))
    out = {
        "transaction_type": F.when(credit, "card_credit").when(fee, "excluded").otherwise(type2),
        "category": F.when(credit, "Card Credit").when(fee, F.lit(None).cast("string")).when(use_own, own).otherwise(F.col("category")),
        "confidence": F.when(credit | fee, F.lit(None).cast("string")).when(use_own, "medium").otherwise(conf2),
        "exclusion_reason": F.when(credit, "statement_credit").when(fee, F.col("exclusion")),
        "amount": F.when(credit & ~F.coalesce(layout_credit, F.lit(False)), F.abs("amount")).otherwise(F.col("amount")),
        "needs_review": F.when(credit | fee, False).otherwise(F.col("needs_review")),
    }
    return c.withColumns(out)
