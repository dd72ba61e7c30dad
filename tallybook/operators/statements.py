"""Statement-level checks: row validity, reconciliation, review flags, upload manifest and text chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.columns import cents, contains_any, first_match, money, round_ratio
from tallybook.functions import fixed_values as v
from tallybook.functions.parsing import is_valid_row
from tallybook.operators.dedup import DEDUPE_COLUMNS, dedupe

# Reconciliation tolerance in cents, chunk size, overlap and how far a cut may move to a dated line.
TOLERANCE = 5
CHUNK_LINES, CHUNK_OVERLAP, CHUNK_REACH = 55, 6, 25
DATED_LINE = r"(?i)^\s*(\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}|\d{4}-\d{2}-\d{2})\b"


def parse_quality(rows: DataFrame) -> DataFrame:
    """Share of valid rows per file and parse mode against the mode's threshold."""
    valid = is_valid_row("transaction_date", "amount", "description")
    g = rows.groupBy("file", "mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid"))
    need = first_match([(F.col("mode") == m, int(t * 100)) for m, t in v.PARSE_THRESHOLDS.items()], 75)
    return g.select("file", "mode", "n", "valid", (round_ratio("valid", "n", 100) / 100).alias("ratio"), (F.col("valid") * 100 >= F.col("n") * need).alias("passed"))


def reconcile(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Opening plus movements against closing under both sign conventions, within five cents."""
    c = F.coalesce(cents("amount"), F.lit(0).cast("long"))
    total = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, c)), F.lit(0).cast("long"))
    sums = rows.groupBy("stmt_id").agg(total("credit").alias("credits"), total("debit").alias("debits"))
    s = statements.join(sums, "stmt_id", "left").fillna(0, ["credits", "debits"])
    opening, closing = cents("opening_balance"), cents("closing_balance")
    s = s.withColumns({"bank": F.abs(opening + F.col("credits") - F.col("debits") - closing), "card": F.abs(opening + F.col("debits") - F.col("credits") - closing)})
    made = lambda st, conv, d: F.struct(F.lit(st).alias("status"), F.lit(conv).cast("string").alias("convention"), d.alias("delta"))
    bank, card = F.col("bank"), F.col("card")
    r = first_match(
        [
            (bank.isNull(), made("no_balances_printed", None, F.lit(None).cast("long"))), (bank <= TOLERANCE, made("reconciled", "bank/asset", bank)),
            (card <= TOLERANCE, made("reconciled", "card/liability", card)), (bank <= card, made("MISMATCH", "bank/asset (closest)", bank)),
        ],
        made("MISMATCH", "card/liability (closest)", card),
    )
    return s.withColumn("r", r).select("stmt_id", "r.status", "r.convention", money("r.delta").alias("delta"), money("credits").alias("sum_credits"), money("debits").alias("sum_debits"))


def review_flags(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Rows with their review reasons; sign-ambiguous rows are suspect where the statement did not reconcile."""
    r = rows.join(status.select("stmt_id", "status"), "stmt_id", "left")
    low = F.lower(F.coalesce("description", F.lit("")))
    category = F.when(F.col("category").isin(v.EXTRACTION_CATEGORIES), F.col("category")).otherwise("Other")
    back = (category == "Refund") | contains_any(low, ["refund", "return"])
    trap = (F.col("direction") == "credit") | contains_any(low, v.SIGN_TRAP_WORDS)
    reasons = F.array_compact(F.array(
        F.when(F.col("amount").isNull() | (F.coalesce("date", F.lit("")) == ""), F.lit("incomplete data")),
        F.when(back & (F.col("direction") == "debit"), F.lit("refund marked as debit - likely wrong sign")),
        F.when((F.coalesce("status", F.lit("unknown")) != "reconciled") & trap, F.lit("verify debit/credit sign"))))
    return r.withColumn("_reasons", reasons).withColumns({"category": category, "review": F.size("_reasons") > 0, "review_reason": F.nullif(F.array_join("_reasons", "; "), F.lit(""))}).drop("_reasons", "status")


def outcomes(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """`incoming` with what became of each row: pending, saved, or duplicate of the history or the upload (user_id and seq name a row)."""
    read = [c for c in incoming.columns if c in DEDUPE_COLUMNS]
    kept = dedupe(incoming.select(*read), history, columns=["user_id", "seq"]).withColumn("_kept", F.lit(True))
    outcome = F.when(F.coalesce("is_pending", F.lit(False)), "pending").when(F.col("_kept"), "saved").otherwise("duplicate")
    return incoming.join(kept, ["user_id", "seq"], "left").withColumn("outcome", outcome).drop("_kept")


def upload_manifest(outcomes: DataFrame) -> DataFrame:
    """Per file: imported, duplicates, pending and review counts, confidence and status. `outcome` is saved, duplicate or pending."""
    is_ = lambda x: F.col("outcome") == x
    g = outcomes.groupBy("user_id", "file").agg(
        F.count_if(is_("saved")).alias("transactions_extracted"), F.count_if(is_("duplicate")).alias("duplicates_skipped"), F.count_if(is_("pending")).alias("pending_skipped"),
        F.count_if(is_("saved") & F.col("needs_review")).alias("needs_review"), F.max("bank").alias("bank"))
    known = F.col("bank") != "Unknown Bank"
    return g.withColumns({"parse_confidence": F.when(known, 0.9).otherwise(0.6), "upload_status": F.lit("complete")})


def upload_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("user_id").agg(F.count(F.lit(1)).alias("files"), F.sum("transactions_extracted").alias("imported"), F.sum("duplicates_skipped").alias("skipped"))


def chunk_bounds(lines: Column, size: int = CHUNK_LINES, reach: int = CHUNK_REACH) -> Column:
    """array<struct(start, stop)>: cuts after about `size` lines, moved forward to the next dated line within `reach`."""
    dated = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(DATED_LINE), i)), lambda i: i.isNotNull())
    # Length and dated positions ride in the accumulator, so they are computed once per text and not once per cut.
    begin = F.struct(F.lit(0).alias("at"), F.size(lines).alias("n"), dated.alias("dated"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("cuts"))

    def step(acc, _):
        n = acc["n"]
        soft = F.least(acc["at"] + size, n)
        stop = F.least(n, soft + reach, F.coalesce(F.array_min(F.filter(acc["dated"], lambda d: d >= soft)), n))
        cuts = F.concat(acc["cuts"], F.array(F.struct(acc["at"].alias("start"), stop.alias("stop"))))
        more = F.struct(stop.alias("at"), n.alias("n"), acc["dated"].alias("dated"), cuts.alias("cuts"))
        return F.when(acc["at"] >= n, acc).otherwise(more)

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(lines) / size).cast("int")), begin, step)["cuts"]


def chunk_text(texts: DataFrame, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of whole texts with `overlap` lines repeated across each cut; blank chunks are dropped. Input: (id, text)."""
    t = texts.withColumn("_lines", F.split(F.regexp_replace("text", r"\n$", ""), "\n"))
    t = t.withColumn("_cuts", chunk_bounds(F.col("_lines")))
    c = t.select("id", "_lines", F.posexplode("_cuts").alias("position", "cut"))
    start = F.greatest(F.lit(0), F.col("cut.start") - overlap)
    body = F.array_join(F.slice("_lines", start + 1, F.col("cut.stop") - start), "\n")
    return c.select("id", "position", start.alias("first_line"), F.col("cut.stop").alias("end_line"), body.alias("chunk")).filter(F.trim(F.regexp_replace("chunk", r"\s+", " ")) != "")
