"""Operators against brute force on small fixtures, and properties that must hold for any ledger."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallybook.operators import aggregates as agg
from tallybook.operators import credits as cr
from tallybook.operators import dedup as dd
from tallybook.operators import periods as per
from tallybook.plans import insights as ins
from tallybook.sources import delimited as dl
from tallybook.sources import files as fl
from tallybook.sources.ofx import parse_ofx

SCHEMA = (
    "user_id string, transaction_id string, seq string, transaction_date date, amount decimal(18,2), description string, bank_source string, account_name string,"
    " transaction_type string, category string, ext_id string, is_pending boolean, is_fixed boolean, needs_review boolean, exclusion_reason string"
)


def row(i, day, amount, text, user="a", ext=None, kind="expense", category="Shopping", fixed=False, account="Chase 1"):
    d = dt.date(2024, 1, 1) + dt.timedelta(days=day)
    return (user, f"t{i}", f"{i:06d}", d, None if amount is None else Decimal(str(amount)), text, "Chase", account, kind, category, ext, False, fixed, False, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def kept(df):
    return sorted(r["transaction_id"] for r in df.select("transaction_id").collect())


def brute_force_batch(rows):
    """Per user, accept rows in order unless their fingerprint or a similar accepted row came first."""
    fps, accepted, out, ids = set(), [], [], set()
    for r in sorted(rows, key=lambda r: r["seq"]):
        mark = (r["user_id"], r["fingerprint"])
        if r["ext_id"]:
            if mark in ids:
                continue
            ids.add(mark)
        if mark in fps:
            continue
        key = (r["user_id"], r["account_name"], r["amount"], r["description"].lower().strip())
        if any(k == key and abs((d - r["transaction_date"]).days) <= 3 for k, d in accepted):
            continue
        fps.add(mark)
        accepted.append((key, r["transaction_date"]))
        out.append(r["transaction_id"])
    return sorted(out)


def test_batch_dedup_equals_brute_force(spark):
    rnd = random.Random(7)
    texts = ["SQ *RED CUP", "red cup", "POS PURCHASE RED CUP", "Blue Bowl", "blue bowl 99999"]
    rows = [row(i, rnd.randrange(25), rnd.choice([-5, -6]), rnd.choice(texts), rnd.choice("ab"), rnd.choice([None, None, f"EXT-{rnd.randrange(6)}00"])) for i in range(400)]
    df = dd.with_fingerprint(frame(spark, rows)).cache()
    assert kept(dd.first_in_batch(df)) == brute_force_batch([r.asDict() for r in df.collect()])


def test_batch_dedup_of_incomparable_rows_and_many_days(spark):
    rows = [row(i, 0, None, "no amount") for i in range(3)] + [row(10 + i, i % 2, 0, "nothing") for i in range(4)] + [row(20, 0, -5, ""), row(21, 0, -5, ""), row(22, 1, -5, "")]
    rows += [row(100 + i, (i * 7) % 400 - 200, -9, "daily pass") for i in range(400)]
    found = kept(dd.first_in_batch(dd.with_fingerprint(frame(spark, rows))))
    days = {int(t[1:]) - 100: ((int(t[1:]) - 100) * 7) % 400 for t in found if int(t[1:]) >= 100}
    assert [t for t in found if int(t[1:]) < 100] == ["t0", "t10", "t11", "t20", "t22"]
    assert all(abs(a - b) > 3 for i, a in days.items() for j, b in days.items() if i != j) and len(days) >= 58


def brute_force_occurrences(old, rows):
    """Nth copy against Nth copy; the same text on another day within three days is still a duplicate."""
    seen = {}
    for r in old:
        seen[r["user_id"], r["fingerprint"]] = seen.get((r["user_id"], r["fingerprint"]), 0) + 1
    near = lambda a, b: 0 < abs((a["transaction_date"] - b["transaction_date"]).days) <= 3 and all(a[c] == b[c] for c in ("user_id", "account_name", "amount")) and a["description"].lower() == b["description"].lower()
    copies, fresh, out = {}, [], []
    for r in sorted(rows, key=lambda r: r["seq"]):
        mark = (r["user_id"], r["fingerprint"])
        copies[mark] = copies.get(mark, 0) + 1
        if copies[mark] > seen.get(mark, 0):
            fresh.append(r)
    for r in fresh:
        if not any(near(r, o) for o in old) and not any(near(r, o) for o in out):
            out.append(r)
    return sorted(r["transaction_id"] for r in out)


def test_occurrences_against_brute_force(spark):
    rnd = random.Random(3)
    some = lambda n, k: [row(k + i, rnd.randrange(30), rnd.choice([-5, -6]), rnd.choice(["Red Cup", "red cup", "Blue Bowl"]), rnd.choice("ab")) for i in range(n)]
    old, new = frame(spark, some(40, 0)), frame(spark, some(200, 1000))
    data = [[r.asDict() for r in dd.with_fingerprint(x).collect()] for x in (old, new)]
    assert kept(dd.dedupe(new, old, dd.OCCURRENCE)) == brute_force_occurrences(*data)


def test_repeat_purchases_of_one_day(spark):
    two = [row(i, 5, -20, "Trader Joe's") for i in range(2)]
    three = [row(10 + i, 5, -20, "Trader Joe's") for i in range(3)]
    none = frame(spark, [])
    assert kept(dd.dedupe(frame(spark, two), none, dd.OCCURRENCE)) == ["t0", "t1"] and kept(dd.dedupe(frame(spark, two), none)) == ["t0"]
    assert kept(dd.dedupe(frame(spark, two), frame(spark, two), dd.OCCURRENCE)) == []
    assert kept(dd.dedupe(frame(spark, three), frame(spark, two), dd.OCCURRENCE)) == ["t12"]
    # A day later the same text is a drifted copy, and an external id names one transaction however often it comes.
    assert kept(dd.dedupe(frame(spark, [row(20, 6, -20, "trader joe's")]), frame(spark, two), dd.OCCURRENCE)) == []
    ids = [row(30 + i, 5, -20, "Trader Joe's", ext="EXT-7777") for i in range(2)]
    assert kept(dd.dedupe(frame(spark, ids), none, dd.OCCURRENCE)) == ["t30"]


def test_history_dedup_window_and_account(spark):
    hist = frame(spark, [row(0, 10, -5, "Red Cup")])
    inc = frame(spark, [row(1, 13, -5, "red cup "), row(2, 14, -5, "red cup"), row(3, 10, -5, "red cup", account="Chase 2"), row(4, 10, -5, "red cup", user="b")])
    assert kept(dd.new_by_similarity(inc, hist)) == ["t2", "t3", "t4"]


def test_short_external_id_is_not_trusted(spark):
    hist = frame(spark, [row(0, 1, -5, "x", ext="12345"), row(1, 1, -5, "y", ext=" 1234567 ")])
    inc = frame(spark, [row(2, 9, -8, "z", ext="12345"), row(3, 9, -8, "w", ext="1234567")])
    assert kept(dd.new_by_external_id(inc, hist)) == ["t2"]


def test_reupload_adds_nothing(spark):
    rows = frame(spark, [row(i, i * 5, -10 - i, f"shop {i}") for i in range(20)])
    assert kept(dd.dedupe(rows, rows)) == []


def test_users_are_isolated(spark):
    mine = [row(i, i * 3, -10 - i % 7, f"SQ *SHOP {i % 4}", "a", kind="card_credit" if i % 5 == 0 else "expense") for i in range(40)]
    twin = [(("b",) + r[1:2] + r[2:]) for r in mine]
    alone, both = frame(spark, mine), frame(spark, mine + [("b", "u" + r[1]) + r[2:] for r in twin])
    for fn in (agg.month_totals, agg.cash_flow_summary, cr.match_credits, agg.top_categories):
        a = sorted(map(str, fn(alone).filter("user_id = 'a'").collect()))
        assert a == sorted(map(str, fn(both).filter("user_id = 'a'").collect())), fn.__name__


def test_nearest_amount_prefers_earlier_on_ties(spark):
    rows = [row(0, 1, -10, "one", category="Shopping"), row(1, 2, -14, "two", category="Shopping"), row(2, 3, 12, "lululemon credit", kind="card_credit")]
    m = cr.match_credits(frame(spark, rows)).first()
    assert (m["expense_id"], m["match_method"], m["applied_amount"]) == ("t0", "category_window", Decimal("10.00"))


def test_unmatched_credit_applies_nothing(spark):
    m = cr.match_credits(frame(spark, [row(0, 1, 12, "mystery", kind="card_credit")])).first()
    assert (m["match_method"], m["applied_amount"], m["unapplied_amount"]) == ("unmatched", Decimal("0.00"), Decimal("12.00"))


def brute_force_rank(found):
    wins = sorted((x for x in found if x["type"] == "win"), key=lambda x: -x["score"])
    others = sorted((x for x in found if x["type"] != "win"), key=lambda x: -x["score"])
    final = wins[:1]
    for x in others:
        if len(final) >= 6:
            break
        if len(final) > 2 and x["type"] in {f["type"] for f in final}:
            continue
        if x["action_filter"] and x["action_filter"] in {f["action_filter"] for f in final}:
            continue
        final.append(x)
    final += wins[1:][: max(0, 6 - len(final))]
    return [x["id"] for x in sorted(final, key=lambda x: (x["type"] != "win", -x["score"]))]


def test_ranking_equals_brute_force(spark):
    rnd = random.Random(3)
    kinds = ["win", "trend", "behavior", "anomaly", "fixed", "optimization"]
    lists = [[{"id": f"i{j}", "type": rnd.choice(kinds), "score": rnd.randrange(4, 10), "title": "", "body": "", "action": None, "action_filter": rnd.choice([None, "A", "B", "C"])} for j in range(rnd.randrange(0, 14))] for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, found array<struct<id:string,type:string,score:int,title:string,body:string,action:string,action_filter:string>>")
    order = F.array_sort(F.transform("r", lambda x, i: F.struct((x["type"] != "win").alias("w"), (-x["score"]).alias("n"), i.alias("at"), x["id"].alias("id"))))
    got = df.withColumn("r", ins._ranked(F.col("found"))).select("k", F.transform(order, lambda s: s["id"]).alias("ids")).collect()
    for r in got:
        assert r["ids"] == brute_force_rank(lists[r["k"]])


def test_exclusions_leave_totals_but_not_listings(spark):
    rows = frame(spark, [row(0, 1, -10, "x"), row(1, 2, -5, "y")]).withColumn("exclusion_reason", F.when(F.col("transaction_id") == "t1", "credit_covered"))
    assert agg.month_totals(rows).first()["total"] == Decimal("10.00")
    assert per.spend(rows, include_excluded=True).count() == 2


def test_csv_file_end_to_end(spark, tmp_path):
    (tmp_path / "chase_1087.csv").write_text('Transaction Date,Description,Category,Amount\n01/05/2024,"SHOP, INC",Gas,-12.50\nbad,row,,1\n01/06/2024,Ending Balance,,5\n')
    files = fl.statement_files(spark, str(tmp_path))
    assert files.select(fl.file_type("content", "path").alias("t")).first()["t"] == "csv"
    rows = dl.parse_delimited(fl.text_lines(files)).collect()
    assert [(r["bank_source"], r["description"], r["amount"], r["raw_category"]) for r in rows] == [("Chase", "SHOP, INC", Decimal("-12.50"), "Gas")]


def test_new_merchant_and_frequency_insights_fire(spark):
    rows = [row(i, (i % 3) * 31 + i % 20, -10, "Corner Shop") for i in range(60)]
    rows += [row(100 + i, 65 + i % 10, -10, "Corner Shop") for i in range(80)] + [row(200, 70, -900, "Brand New Place")]
    empty = spark.createDataFrame([], "user_id string, ym string, budget long")
    profile = spark.createDataFrame([("a", 100000)], "user_id string, budget long")
    wide = ins.wide_months(frame(spark, rows), empty, profile)
    found = {(r["ym"], r["id"]) for r in ins.candidates(wide, dt.date(2025, 1, 1)).collect()}
    assert ("2024-03", "T3") in found and ("2024-03", "A3") in found


def test_insights_from_merged_sums_equal_those_from_single_rows(spark):
    """Repeated texts merge; the charge that W3 and A1 name stays the first one's, not the sum."""
    rows = [row(i, (i % 4) * 31 + i % 20, -10 - i % 3, "Corner Shop") for i in range(80)]
    rows += [row(100 + i, 31 * (i % 2) + 3 + i // 2, -15, "NETFLIX.COM", category="Subscriptions") for i in range(6)]
    rows += [row(200 + i, 70 + i, -900, "Brand New Place") for i in range(2)]
    empty = spark.createDataFrame([], "user_id string, ym string, budget long")
    profile = spark.createDataFrame([("a", 100000)], "user_id string, budget long")
    day = dt.date(2025, 1, 1)
    every = [name for name, _, _ in ins.rules(day)]
    listing = lambda only: sorted(map(str, ins.candidates(ins.wide_months(frame(spark, rows), empty, profile, only=only), day).collect()))
    merged = listing(None)
    assert merged == listing(every)
    assert any("Saving $15/mo" in r for r in merged)


def test_ofx_takes_the_first_tag_of_a_name_in_any_case(spark):
    block = "<STMTTRN><trntype>debit\n<DTPOSTED>20240105120000\n<TRNAMT>-4.50\n<FITID>f1\n<NAME>First Shop\n<NAME>Second Shop\n</STMTTRN>"
    empty = "<STMTTRN><DTPOSTED>20240106\n<TRNAMT>-1.00\n<NAME>\n<MEMO>From memo\n</STMTTRN><STMTTRN><TRNAMT>-1.00\n<NAME>No day\n</STMTTRN>"
    files = spark.createDataFrame([("p", "<OFX><ORG>Wells Fargo NA\n" + block + empty), ("none", "<OFX></OFX>"), ("null", None)], "path string, text string")
    rows = parse_ofx(files).orderBy("position").collect()
    assert [(r["description"], r["amount"], r["ext_id"], str(r["transaction_date"])) for r in rows] == [
        ("First Shop", Decimal("-4.50"), "f1", "2024-01-05"), ("From memo", Decimal("-1.00"), "", "2024-01-06")]


def test_credits_of_the_month_or_of_all_months(spark):
    rows = [row(0, 3, -50, "NETFLIX.COM", fixed=True), row(1, 34, -50, "NETFLIX.COM", fixed=True), row(2, 5, 20, "Platinum credit - NETFLIX.COM", kind="card_credit")]
    manual = spark.createDataFrame([], "user_id string, name string, amount_cents long")
    by = lambda scope: {r["ym"]: r["net_amount"] for r in cr.fixed_with_cover(frame(spark, rows), manual, by_month=True, credits_of=scope).collect()}
    assert by("month") == {"2024-01": Decimal("30.00"), "2024-02": Decimal("50.00")}
    assert by("all") == {"2024-01": Decimal("30.00"), "2024-02": Decimal("30.00")}
