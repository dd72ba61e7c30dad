"""User corrections, upserts, deletions and set operations on ledger-shaped tables.

An upsert is a union followed by "latest row per key"; the first-row window is cut to one row per key before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.columns import month_from_index, month_index, staged, top_per_group
from tallybook.functions.fingerprints import fingerprint
from tallybook.functions.merchants import key8, learned_core

CORRECTABLE = ["transaction_date", "description", "amount", "category", "transaction_type", "bank_source", "needs_review", "exclusion_reason"]


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str = "updated_at") -> DataFrame:
    """Latest row per key of current plus changes."""
    both = current.unionByName(changes, allowMissingColumns=True)
    return top_per_group(both, list(keys), [F.desc_nulls_last(version)], 1).drop("rank")


def with_implied_type(corrections: DataFrame) -> DataFrame:
    """Transfer and payment categories decide the type; 'Payment' is stored as 'Credit Card Payment'."""
    cat = F.col("category")
    pay = cat.isin("Credit Card Payment", "Payment")
    return corrections.withColumns({
        "transaction_type": F.when(cat == "Transfer", "transfer").when(pay, "credit_card_payment").otherwise(F.col("transaction_type")),
        "category": F.when(pay, "Credit Card Payment").otherwise(cat)})


def apply_corrections(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """Partial updates: the newest correction of a row wins field by field; touched rows are edited and reviewed."""
    fields = [c for c in CORRECTABLE if c in corrections.columns and c in ledger.columns]
    newest = with_implied_type(corrections).groupBy("user_id", "transaction_id").agg(F.max_by(F.struct(*fields), "updated_at").alias("_new"))
    rows = ledger.join(newest, ["user_id", "transaction_id"], "left")
    hit = F.col("_new").isNotNull()
    out = {f: F.coalesce(F.col(f"_new.{f}"), F.col(f)) for f in fields}
    out["needs_review"] = F.when(hit, False).otherwise(F.col("needs_review"))
    out["is_edited"] = hit
    return rows.withColumns(out).drop("_new")


def learn_rules(ledger: DataFrame, corrections: DataFrame, existing: DataFrame) -> DataFrame:
    """Merchant rules after corrections that changed a category: one rule per user and stable merchant core.

    Of a user's corrections of one description only the newest can win; cores are worked out for those.
    """
    changed = with_implied_type(corrections).filter("category is not null").select("user_id", "transaction_id", F.col("category").alias("new_category"), "updated_at")
    rows = ledger.select("user_id", "transaction_id", "description", "category").join(changed, ["user_id", "transaction_id"]).filter(~F.col("category").eqNullSafe(F.col("new_category")))
    newest = top_per_group(rows, ["user_id", "description"], [F.desc_nulls_last("updated_at")], 1)
    fresh = staged(newest, match_value=learned_core("description")).filter("match_value <> ''").select("user_id", "match_value", F.col("new_category").alias("category"), "updated_at")
    learned = fresh.select("*", F.lit("contains").alias("match_type"), F.lit("merchant").alias("match_field"), F.lit("expense").alias("transaction_type"), F.lit(10).alias("priority"), F.lit(True).alias("is_active"))
    return upsert(existing, learned, ["user_id", "match_value"])


def confirm_fixed(ledger: DataFrame, decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """Confirmed fixed/variable decisions per user and merchant key, newest wins. Feeds the fixed classifier."""
    rows = ledger.select("user_id", "transaction_id", key8("description").alias("key8")).join(decisions, ["user_id", "transaction_id"]).filter("key8 <> ''")
    return upsert(existing, rows.select("user_id", "key8", "is_fixed", "updated_at"), ["user_id", "key8"])


def add_manual(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Manual entries appended with a fingerprint of their own namespace and no account."""
    none = F.lit(None).cast("string")
    f = fingerprint(F.lit("manual"), F.lit(""), "transaction_date", "amount", "description", F.lit(""))
    made = entries.withColumns({"fingerprint": f, "account_name": none, "ext_id": none, "is_pending": F.lit(False), "needs_review": F.lit(False)})
    return ledger.unionByName(made, allowMissingColumns=True)


def snapshot_budget(history: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(history, changes, ["user_id", "ym"])


def delete_users(table: DataFrame, users: DataFrame) -> DataFrame:
    return table.join(users.select("user_id").distinct(), "user_id", "left_anti")


def delete_rows(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Only the owner's own rows go."""
    return ledger.join(rows.select("user_id", "transaction_id").distinct(), ["user_id", "transaction_id"], "left_anti")


def unlink_projects(ledger: DataFrame, deleted: DataFrame) -> DataFrame:
    gone = deleted.select("user_id", F.col("id").alias("project_id")).distinct().withColumn("_gone", F.lit(True))
    rows = ledger.join(gone, ["user_id", "project_id"], "left")
    return rows.withColumn("project_id", F.when(F.col("_gone").isNull(), F.col("project_id"))).drop("_gone")


def tag_projects(ledger: DataFrame, tags: DataFrame) -> DataFrame:
    """Latest tag per row; a NULL tag unlinks."""
    newest = tags.groupBy("user_id", "transaction_id").agg(F.max_by(F.struct("project_id"), "updated_at").alias("_tag"))
    rows = ledger.join(newest, ["user_id", "transaction_id"], "left")
    return rows.withColumn("project_id", F.when(F.col("_tag").isNotNull(), F.col("_tag.project_id")).otherwise(F.col("project_id"))).drop("_tag")


def with_covered(live: DataFrame, ledger: DataFrame) -> DataFrame:
    """Live spend plus fixed rows that a credit covered."""
    return live.unionByName(ledger.filter("exclusion_reason = 'credit_covered' and is_fixed"))


def lapsed_keys(before: DataFrame, last: DataFrame, now: DataFrame) -> DataFrame:
    """Keys of both earlier sets that are missing now, per user; inputs are (user_id, key)."""
    return before.intersect(last).exceptAll(now.distinct().intersect(before.intersect(last)))


def lapsed_by_month(seen: DataFrame, months: DataFrame) -> DataFrame:
    """(user_id, ym, key): keys of both months before a user's month that are missing in it.

    `seen` is (user_id, ym, key), `months` the (user_id, ym) to judge. Each sighting marks its own and the next two months,
    so one aggregate decides every month.
    """
    at = seen.distinct().select("user_id", "key", month_index("ym").alias("at"), F.posexplode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("age", "mark"))
    marks = at.groupBy("user_id", "key", (F.col("at") + F.col("age")).alias("idx")).agg(F.bit_or("mark").alias("marks")).filter("marks = 6")
    judged = months.select("user_id", month_index("ym").alias("idx"))
    return marks.join(judged, ["user_id", "idx"], "left_semi").select("user_id", month_from_index(F.col("idx")).alias("ym"), "key")


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.filter("is_active").orderBy(F.desc("priority"))


def load_rules(rules: DataFrame, users: DataFrame) -> DataFrame:
    """Active rules each user sees: own and global, with their rank order (priority, then match type)."""
    active = rules.filter("is_active")
    own = active.join(users.select("user_id"), "user_id", "left_semi").select(F.col("user_id").alias("for_user"), "id", "priority", "match_type")
    shared = active.filter("user_id is null").select("id", "priority", "match_type")
    return own.unionByName(shared.select(F.lit("*").alias("for_user"), "id", "priority", "match_type"))


def category_choices(defaults: DataFrame, ledger: DataFrame) -> DataFrame:
    return defaults.select("category").union(ledger.select("category").filter("category is not null")).distinct()
