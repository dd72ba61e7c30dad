"""Work that must not grow faster than the tables, and results that stay as they are."""

from __future__ import annotations

import datetime as dt
import random
import types
from decimal import Decimal

from pyspark.sql import functions as F

from tallybook.columns import distinct_texts
from tallybook.llm import ngram_jaccard
from tallybook.operators import classify, corrections, dedup
from tallybook.sources import delimited, layout
from tallybook.streaming import ingest
from tallybook.workload import matching


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_texts_are_spread_over_all_tasks(spark):
    rows = spark.createDataFrame([(f"shop {i % 40}",) for i in range(200)], "description string")
    texts = distinct_texts(rows, "description").select(F.spark_partition_id().alias("p")).collect()
    assert len(texts) == 40 and len({r.p for r in texts}) > 1


def test_category_patterns_meet_cleaned_texts_once(spark):
    rows = spark.createDataFrame([(f"UBER *EATS {i}00000",) for i in range(30)] + [("NETFLIX.COM",), (None,)], "description string")
    profile = classify.text_profile(rows)
    assert "netflix" not in _plan(profile.select("description", "best_category")).lower()
    found = {r.description: (r.best_category, r.merchant) for r in profile.collect()}
    direct = classify._name_profile(rows.distinct().withColumn("cleaned", classify.clean_description("description")))
    assert found == {r.description: (r.best_category, r.merchant) for r in direct.collect()} and len(found) == 32


def test_rules_meet_names_by_substrings_of_their_length(spark):
    """Values that share their first three letters with every text: only those that hold the value's anchor meet it."""
    texts = [(f"D{i}", f"abcdefgh{i:04d} end", f"abcdefgh{i:04d}") for i in range(60)]
    given = spark.createDataFrame([*texts, ("none", "xyz", None)], "description string, cleaned string, merchant string")
    schema = "id long, user_id string, match_field string, match_value string, match_type string, priority int, transaction_type string, category string, confidence_override double, is_active boolean"
    one = lambda i, user, field, value, how: (i, user, field, value, how, i, "expense", f"Cat {i}", 0.9, True)
    rules = [one(0, None, "merchant", "abcdefgh00", "starts_with"), one(1, None, "merchant", "h0012", "contains"), one(2, None, "description", "0013 END", "contains"), one(3, "u1", "description", "h00(14|15) e", "regex"),
             one(4, "u1", "merchant", "abcdefgh0016", "exact"), one(5, None, "description", "xyz", "exact"), one(6, "u2", "description", "abc", "starts_with"), one(7, None, "merchant", "abcdefgh0099", "starts_with")]
    users = spark.createDataFrame([("u1", f"D{i}") for i in range(10, 20)] + [(None, "D1"), ("u1", None), ("u3", "D3")], "user_id string, description string")
    best = classify.best_rules(given, spark.createDataFrame(rules, schema), users)
    found = {(r.rule_user, r.description): r.best.rule_id for r in best.collect()}
    shared = {("*", f"D{i}"): {12: 1, 13: 2}.get(i, 0) for i in range(60)} | {("*", "none"): 5}
    assert found == shared | {("u1", "D14"): 3, ("u1", "D15"): 3, ("u1", "D16"): 4}


def test_similarity_in_slots_of_days_against_brute_force(spark):
    rnd = random.Random(5)
    make = lambda n: [(rnd.choice("uv"), rnd.choice(["a", None]), dt.date(1969, 12, 20) + dt.timedelta(rnd.randrange(110)), Decimal(rnd.choice([0, 1, 2])), rnd.choice(["x", " X", "y", ""]), i) for i in range(n)]
    schema = "user_id string, account_name string, transaction_date date, amount decimal(18,2), description string, seq int"
    new, old = make(300), make(60)
    ok = lambda r: r[3] != 0 and r[4] != ""
    key = lambda r: (r[0], r[1], r[3], r[4].strip().lower())
    for repeats, least in (("merge", 0), ("occurrence", 1)):
        out = dedup.new_by_similarity(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), repeats)
        assert "sequence" not in _plan(out)
        kept = {r[5] for r in new if not (ok(r) and any(ok(h) and key(h) == key(r) and least <= abs((h[2] - r[2]).days) <= 3 for h in old))}
        assert sorted(r.seq for r in out.collect()) == sorted(kept) and len(kept) < 300


def test_incoming_rows_read_the_ledger_once(spark):
    t = types.SimpleNamespace(spark=spark, ledger=_ledger(spark))
    for df in (matching.incoming(t), matching.repeated(t)):
        assert _plan(df).count("Range (") == 1
        assert "Union" not in _plan(df)
    t.ledger.createOrReplaceTempView("ledger")
    for df, text in ((matching.incoming(t), matching.INCOMING), (matching.repeated(t), matching.REPEATED)):
        expected = spark.sql(text)
        assert df.columns == expected.columns and sorted(map(str, df.collect())) == sorted(map(str, expected.collect()))


def _ledger(spark):
    return spark.range(12).selectExpr(
        "'u' || id % 2 as user_id", "'t' || id as transaction_id", "date_add(date'2020-01-01', cast(id as int)) as transaction_date", "cast(id as decimal(18,2)) as amount", "id * 100 + id as cents", "'SHOP ' || id as description",
        "'B' as bank_source", "'A' as account_name", "'C' as category", "id % 5 = 0 as is_pending", "case when id % 3 = 0 then 'EXT-' || id end as ext_id", "'s' || id as seq")


def test_newest_correction_of_a_core_wins_over_descriptions(spark):
    rows = [("u", "1", "SHOP 123456", "Old"), ("u", "2", "SHOP 123456", "Old"), ("u", "3", "shop", "Old"), ("u", "4", None, "Old"), ("v", "5", "shop", "New")]
    ledger = spark.createDataFrame(rows, "user_id string, transaction_id string, description string, category string")
    fixes = [("u", "1", "A", 3), ("u", "2", "B", 1), ("u", "3", "C", 2), ("u", "4", "D", 9), ("v", "5", "New", 9)]
    given = spark.createDataFrame([(u, i, c, None, n) for u, i, c, n in fixes], "user_id string, transaction_id string, category string, transaction_type string, updated_at long")
    none = spark.createDataFrame([], "user_id string, match_value string, category string, updated_at long")
    learned = corrections.learn_rules(ledger, given, none)
    assert [(r.user_id, r.match_value, r.category) for r in learned.collect()] == [("u", "shop", "A")]
    # Cores are worked out behind the choice of the newest correction of a description.
    assert _plan(learned).count("Window") >= 2


def test_a_statement_line_is_read_once_for_its_row_and_its_reason(spark):
    lines = spark.createDataFrame([("a", 1, 0, "Payment Due Date 03/01/2012"), ("a", 1, 2, "02/05 02/05 12345 REFX SHOP $1.50")], "doc_id string, page int, line_no int, text string")
    parsed = layout.parse_wells_credit(lines)
    assert [(str(r.transaction_date), r.description, r.amount) for r in parsed.collect()] == [("2012-02-05", "SHOP", Decimal("-1.50"))]
    filters = [x for x in _plan(parsed).splitlines() if "Filter" in x]
    assert not any("regexp_extract" in x for x in filters)


def test_a_sheet_row_is_read_once_for_its_values_and_the_filter(spark):
    rows = spark.createDataFrame([("f", 0, ["Date", "Description", "Amount"]), ("f", 1, ["01/02/2020", "SHOP", "$1.50"]), ("f", 2, ["x", "SHOP", "2"])], "path string, row_no int, cells array<string>")
    parsed = delimited.parse_sheet(rows)
    assert [(str(r.transaction_date), r.description, r.amount) for r in parsed.collect()] == [("2020-01-02", "SHOP", Decimal("1.50"))]
    filters = [x for x in _plan(parsed).splitlines() if "Filter" in x]
    assert not any("regexp_replace" in x for x in filters)


def test_fixed_items_and_credits_come_from_one_read(spark):
    from pyspark.sql.functions import col

    from tallybook.operators import credits

    rows = [("u", "SHOP ONE", -500, "expense", None, True), ("u", "SHOP ONE", -500, "expense", "credit_covered", True), ("u", "Platinum credit - shop one", 300, "card_credit", None, False),
            ("u", "Platinum credit - shop one", 200, "card_credit", "credit_covered", True), ("u", "", -100, "expense", None, True), ("v", "OTHER", -100, "expense", None, False), ("u", "NO CREDIT", 900, "card_credit", None, False)]
    ledger = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "user_id string, description string, c int, transaction_type string, exclusion_reason string, is_fixed boolean, seq int")
    ledger = ledger.select("*", (col("c") / 100).cast("decimal(18,2)").alias("amount"), F.when(col("seq") != 4, F.date_add(F.lit("2020-01-05").cast("date"), col("seq"))).alias("transaction_date"), F.lit("Food").alias("category"))
    manual = spark.createDataFrame([("u", "Rent", 700), ("w", "Rent", 1)], "user_id string, name string, amount_cents long")
    show = lambda df: sorted((r.user_id, r.merchant, float(r.amount), r.occurrences, float(r.credit_covered)) for r in df.collect())
    once = credits.fixed_with_cover(ledger, manual)
    assert show(once) == [("u", "Food", 1.0, 1, 0.0), ("u", "Platinum Credit Shop", 2.0, 1, 0.0), ("u", "Rent", 7.0, 1, 0.0), ("u", "Shop One", 10.0, 2, 5.0), ("w", "Rent", 0.01, 1, 0.0)]
    monthly = credits.fixed_with_cover(ledger, manual, by_month=True, credits_of="month")
    assert show(monthly) == [("u", "Platinum Credit Shop", 2.0, 1, 0.0), ("u", "Rent", 7.0, 1, 0.0), ("u", "Shop One", 10.0, 2, 5.0)]
    # Items and credits come from what was written; the ledger itself is read again for the months of manual items only.
    assert "card_credit" not in _plan(once) and "card_credit" not in _plan(monthly)


def test_an_ingested_batch_moves_once_without_a_ledger(spark):
    """Rows have one row per external id already, and are moved with short fingerprints; three moves of wide rows before."""
    columns = "user_id string, account_name string, transaction_date date, amount decimal(18,2), description string, ext_id string, seq string, stem string, fingerprint binary"
    rows = [("u", "a", dt.date(2024, 1, 1 + i % 9), Decimal(5), "Shop", f"EXT-{i}" if i % 3 == 0 else None, f"{i:03d}", "shop", bytes([i % 7] * 32)) for i in range(30)]
    once = dedup.first_by_id(spark.createDataFrame(rows, columns))
    assert sum(r.ext_id is not None for r in once.collect()) == 7 and once.filter("ext_id is null").count() == 20
    left = ingest.new_rows(spark.createDataFrame(rows, columns), [])
    assert left._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_delimited_lines_meet_what_is_known_of_their_file_once(spark):
    """One join of the lines behind small stored tables; three joins of all lines before."""
    text = ["Discover card", "Trans. Date,Description,Amount", '01/02/2024,"Shop, one",5.00', "01/03/2024,Cafe,-2.50"]
    lines = spark.createDataFrame([("x.csv", i, line) for i, line in enumerate(text)], "path string, line_no int, line string")
    rows = delimited.parse_delimited(lines)
    assert _plan(rows).count("Join") == 1
    assert sorted((r.bank_source, r.description, float(r.amount)) for r in rows.collect()) == [("Discover", "Cafe", 2.5), ("Discover", "Shop, one", -5.0)]


def test_search_pools_hold_no_more_than_their_limit(spark):
    """Blocks near a pool's size are not hashed into one pool; 40 of them in 72 pools met before."""
    inside = spark.range(400).selectExpr("id as cid", "id as d1", "id as d2", "1L as n_copies", "9 as n", "id % 40 as block")
    small = spark.range(1000, 1040).selectExpr("id as cid", "id as d1", "id as d2", "1L as n_copies", "2 as n", "id as block")
    inside = inside.union(small)
    totals = inside.groupBy("block").agg(F.sum("n").alias("total"))
    cells = ngram_jaccard._cells(inside, totals, 100)
    loads = cells.join(inside.select("cid", "n"), "cid").groupBy("cell").agg(F.sum("n").alias("load")).collect()
    assert max(r.load for r in loads) <= 100 and sum(r.load for r in loads) == 400 * 9 + 80
    assert cells.filter("d1 >= 1000").select("cell").distinct().count() < 40


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _uploads(spark, seed, n):
    rnd = random.Random(seed)
    make = lambda i: (
        rnd.choice(["u", "u", "v", None]), rnd.choice(["a", "", None]), rnd.choice(["b", None]), dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(24)), rnd.choice([Decimal(-5), Decimal(-6), Decimal(0), None]),
        rnd.choice(["Red Cup", " red cup", "POS PURCHASE RED CUP", "Blue Bowl", "", None]), rnd.choice([None, None, "", "12", "EXT-100", "EXT-200", "EXT-300"]), rnd.choice([False, False, False, True, None]), f"{seed}{i:05d}")
    return spark.createDataFrame([make(i) for i in range(n)], "user_id string, account_name string, bank_source string, transaction_date date, amount decimal(18,2), description string, ext_id string, is_pending boolean, seq string")


def test_an_upload_meets_the_history_in_one_move_of_its_rows(spark):
    """Same rows as by a join for every check; whole rows were moved four times before, with 64 digits of a fingerprint each."""
    new, old = _uploads(spark, 1, 500), _uploads(spark, 2, 60)
    rows = dedup.new_by_external_id(dedup.with_fingerprint(new.filter("not coalesce(is_pending, false)")), old)
    rows = rows.join(dedup.with_fingerprint(old).select("user_id", "fingerprint").distinct(), ["user_id", "fingerprint"], "left_anti")
    want = sorted(r.seq for r in dedup.first_in_batch(dedup.new_by_similarity(rows, old)).collect())
    got = dedup.dedupe(new, old, columns=["seq"])
    assert sorted(r.seq for r in got.collect()) == want and 0 < len(want) < 400
    full = dedup.dedupe(new, dedup.with_fingerprint(old))
    assert sorted(r.seq for r in full.collect()) == want and {*new.columns, "stem", "fingerprint"} == {*full.columns}
    assert "_print" in str(got._jdf.queryExecution().optimizedPlan()) and got.columns == ["seq"]
    whole = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line]
    assert whole and not any(c in line for line in whole for c in ("fingerprint", "ext_id", "description"))


def test_a_batch_moves_only_what_its_scan_compares(spark):
    df = dedup.with_fingerprint(_uploads(spark, 3, 300))
    slim = dedup.first_in_batch(df, columns=["seq", "is_pending"])
    assert sorted(map(str, slim.collect())) == sorted(map(str, dedup.first_in_batch(df).select("seq", "is_pending").collect()))
    scan = next(line for line in slim._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line)
    assert "fingerprint" not in scan and "description" not in scan


def test_similarity_moves_the_history_once(spark):
    """Its aggregate and the join agree on the keys; null-safe equality had the aggregate moved again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(dedup.new_by_similarity(_uploads(spark, 1, 50), _uploads(spark, 2, 50))) == 2
        fresh = dedup.new_by_fingerprint(dedup.with_fingerprint(_uploads(spark, 1, 50)), dedup.with_fingerprint(_uploads(spark, 2, 50)))
        n = dedup.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert [f", {n})" in line for line in plan.splitlines() if "hashpartitioning(user_id" in line and "_print" in line] == [True, True]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_history_beside_incoming_rows_has_the_rows_of_the_history(spark):
    t = types.SimpleNamespace(spark=spark, ledger=_ledger(spark))
    beside = matching.history_beside(t)
    assert sorted(map(str, beside.collect())) == sorted(map(str, matching.history(t).select(*matching.HISTORY_COLUMNS).collect()))
    # No filter of the history reaches below the ledger, so that its joins are the same.
    assert "Filter" not in _plan(beside).split("Generate")[1]


def test_rows_of_a_statement_are_made_once(spark):
    """Years and lines come from rows that were written; the words met in rows two and three times before."""
    words = [("a", 1, 4.0, 60.0 + 15 * i, w) for i, w in enumerate("Statement March 2012".split())] + [("a", 1, 20.0, 30.0 + 100 * i, w) for i, w in enumerate(["3/5", "Coffee", "4.50", "100.00"])]
    words += [("b", 1, 20.0, 30.0 + 100 * i, w) for i, w in enumerate(["3/6", "Bakery", "2.50", "90.00"])] + [("b", 2, 40.0, 10.0, "2013"), (None, 1, 20.0, 30.0, "3/7")]
    given = spark.createDataFrame(words, "doc_id string, page int, top double, x0 double, text string")
    rows = layout.parse_wells_bank(given)
    assert sorted((r.doc_id, str(r.transaction_date), r.description, r.amount) for r in rows.collect()) == [("a", "2012-03-05", "Coffee", Decimal("4.50")), ("b", "2013-03-06", "Bakery", Decimal("2.50"))]
    assert "collect_list" not in _plan(rows)
    lines = [("a", 1, 5.0 + 0.1 * i, 60.0 + 15 * i, w) for i, w in enumerate("OPEN TO CLOSE DATE 01/06/2012 - 02/05/2012".split())] + [("a", 1, 20.0, 30.0 + 100 * i, w) for i, w in enumerate(["01/20", "Coffee", "$4", ".50"])]
    shifted = spark.createDataFrame(lines, given.schema).withColumn("text", F.translate("text", "".join(chr(i + layout.SHIFT) for i in range(1, 127)), "".join(chr(i) for i in range(1, 127))))
    rows = layout.parse_discover(shifted)
    assert [(str(r.transaction_date), r.description, r.amount) for r in rows.collect()] == [("2012-01-20", "Coffee", Decimal("-4.50"))]
    assert "collect_list" not in _plan(rows)


def test_words_of_pages_are_sorted_in_small_tasks(spark):
    words = spark.createDataFrame([("a", 1, 4.0, 60.0, "x"), ("a", 1, 5.0, 70.0, "y"), ("a", 2, 4.0, 60.0, "z")], "doc_id string, page int, top double, x0 double, text string")
    rows = layout.rows_by_anchor(words)
    assert sorted(r.text for r in rows.collect()) == ["x y", "z"]
    moves = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(doc_id" in line]
    assert moves and all(f", {layout.FINER * int(spark.conf.get('spark.sql.shuffle.partitions'))})" in line for line in moves)
