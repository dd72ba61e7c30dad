"""Rows with missing fields, late rows and repeated batches: nothing disappears without a reason."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.adapter import star_ledger
from tallybook.functions.patterns import substring_reader
from tallybook.operators import classify, dedup, projects
from tallybook.sources import delimited, files, layout
from tallybook.streaming import ingest

DAY = dt.date(2001, 3, 5)


@pytest.fixture(scope="module")
def ledger(spark):
    return star_ledger(spark, "/root/testdata/sf0.001").limit(40)


def test_classification_keeps_rows_without_a_text(spark, ledger):
    rows = ledger.withColumn("description", F.when(F.col("amount") % 2 < 1, F.col("description")))
    rules = spark.createDataFrame(
        [(1, None, "description", "zzz", "contains", 1, "expense", "Other", 0.9, True)],
        "id long, user_id string, match_field string, match_value string, match_type string, priority int, transaction_type string, category string, confidence_override double, is_active boolean")
    for given in (None, rules):
        out = classify.classify(rows, given)
        assert out.count() == rows.count()
        assert out.where("description is null and category is null and transaction_type = 'expense'").count() == 0


def test_project_without_filters_takes_rows_without_account_or_category(spark):
    schema = "user_id string, transaction_id string, bank_source string, category string, transaction_date date, transaction_type string, is_pending boolean"
    rows = spark.createDataFrame([("u", "1", None, None, DAY, "expense", False), ("u", "2", "b", None, DAY, "expense", False), ("u", "3", None, "c", DAY, "expense", False)], schema)
    p = spark.createDataFrame([(9, "u", DAY, None, None, None, None)], "id long, user_id string, created_at date, filter_start_date date, filter_end_date date, filter_accounts array<string>, filter_categories array<string>")
    assert {r.transaction_id for r in projects.assign(rows, p).collect()} == {"1", "2", "3"}


SCHEMA = "user_id string, transaction_id string, seq string, bank_source string, account_name string, transaction_date date, amount decimal(18,2), description string, ext_id string"


def row(i, day=DAY, account="a", text="COFFEE SHOP", amount="-4.50"):
    return ("u", str(i), str(i), "bank", account, day, Decimal(amount), text, None)


def test_history_without_an_account_counts(spark):
    old, new = (spark.createDataFrame([row(i, account=None)], SCHEMA) for i in (1, 2))
    assert dedup.new_by_similarity(new, old).count() == 0
    assert dedup.new_by_similarity(spark.createDataFrame([row(3, account="b")], SCHEMA), old).count() == 1


def test_ingest_takes_late_rows_and_checks_history(spark, tmp_path):
    source, history = str(tmp_path / "in"), spark.createDataFrame([row(100, dt.date(1999, 1, 1))], SCHEMA)
    batches = [
        [row(1, dt.date(2001, 3, 5)), row(2, dt.date(2001, 3, 5), text="BOOKS", amount="-20.00")],
        [row(3, dt.date(2001, 3, 7)), row(4, dt.date(2001, 5, 1))],  # row 3 is similar to row 1
        [row(5, dt.date(2000, 1, 2)), row(6, dt.date(1999, 1, 2)), row(2, dt.date(2001, 3, 5), text="BOOKS", amount="-20.00"), row(7, None)],
    ]
    out, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.start_ingest(ingest.statement_stream(spark, source, spark.read.parquet(source).schema), out, state, history).awaitTermination()
    got = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    assert sorted(r.transaction_id for r in got.collect()) == ["1", "2", "4", "5", "7"]


def test_header_far_down_the_file(spark):
    lines = [("f.csv", i, f"note {i}") for i in range(60)] + [("f.csv", 60, "Date,Description,Amount"), ("f.csv", 61, "2001-01-02,COFFEE,-3.50")]
    df = spark.createDataFrame(lines, "path string, line_no int, line string")
    assert delimited.headers(df).first().header_no == 60
    assert delimited.parse_delimited(df).count() == 1


def test_sheet_header_far_down(spark):
    cells = [("s.xlsx", i, ["note", str(i)]) for i in range(20)] + [("s.xlsx", 20, ["Discover it"]), ("s.xlsx", 21, ["Date", "Description", "Amount"]), ("s.xlsx", 22, ["01/02/2001", "COFFEE", "3.50"])]
    out = delimited.parse_sheet(spark.createDataFrame(cells, "path string, row_no int, cells array<string>")).collect()
    assert [(r.bank_source, r.description, float(r.amount)) for r in out] == [("Discover", "COFFEE", -3.5)]


def test_quoted_fields_across_lines(spark):
    text = 'Date,Description,Amount\n2001-01-02,"COFFEE\nSHOP, ""A""",-3.50\n2001-01-03,5" PIPE,-4.00\n2001-01-04,6" PIPE,-5.00\n2001-01-05,"",-6.00\n'
    raw = spark.createDataFrame([("f.csv", bytearray(text.encode()))], "path string, content binary")
    lines = files.text_lines(raw)
    assert lines.count() == 6
    out = delimited.parse_delimited(lines).orderBy("transaction_date").collect()
    assert [(r.description, float(r.amount)) for r in out] == [('COFFEE SHOP, "A"', -3.5), ('5" PIPE', -4.0), ('6" PIPE', -5.0)]


def test_cells_of_a_line(spark):
    lines = {"": [""], ",a": ["", "a"], 'x,"1,000.00",': ["x", "1,000.00", ""], '"a ""b"" c", d ,""': ['a "b" c', "d", ""], '"a" b,c': ['"a" b', "c"]}
    got = spark.createDataFrame([(k,) for k in lines], "line string").select("line", delimited.cells("line").alias("c")).collect()
    assert {r.line: r.c for r in got} == lines


def test_invalid_patterns_are_left_out(spark, ledger):
    schema = "id long, user_id string, match_field string, match_value string, match_type string, priority int, transaction_type string, category string, confidence_override double, is_active boolean"
    rule = lambda i, value, how, priority: (i, None, "description", value, how, priority, "expense", f"Cat {i}", 0.9, True)
    rules = spark.createDataFrame([rule(1, "[open", "regex", 9), rule(2, "a{", "regex", 8), rule(3, "", "contains", 7), rule(4, "^.", "regex", 1)], schema)
    assert {(r.id, r.reason) for r in classify.rejected_rules(rules).collect()} == {(1, "invalid pattern"), (2, "invalid pattern"), (3, "empty value")}
    out = classify.classify(ledger, rules)
    assert out.count() == ledger.count() and {r.rule_id for r in out.select("rule_id").distinct().collect()} <= {4, None}


def test_required_substrings_of_patterns():
    read = substring_reader()
    known = {
        "(uber|lyft).*eats": ["eats"], "^amzn.*t": ["amzn"], "(foo|bar)": ["bar", "foo"], "ab{2}c": ["ab"], "a\\.b": ["a.b"], "(?:abc)?defg": ["defg"], "(?!no)yes": ["yes"], "(?<n>shop) now": ["shop"],
        "x*": [], "foo|": [], "(?i)abc": [], "(abc": [], "a)b": [], "\\p{L}abc": [], "[)(|]xyz": ["xyz"], "(?=a[)]b)cde": ["cde"], "SHOP": ["shop"],
    }
    assert {p: read(p) for p in known} == known
    rnd = random.Random(1)

    def pattern(depth=0):
        k = rnd.randrange(8 if depth < 3 else 4)
        if k < 4:
            return rnd.choice("abc")
        inner = pattern(depth + 1)
        return f"({inner}|{pattern(depth + 1)})" if k == 4 else f"(?:{inner})" + rnd.choice(["*", "+", "?", "{2}", "{0,1}"]) if k == 5 else rnd.choice("abc") + rnd.choice(["*", "+", "?", "{2}", "{2,3}"]) if k == 6 else inner + pattern(depth + 1)

    for _ in range(4000):
        p = pattern() + rnd.choice(["", ".", "[ab]", "\\w"]) + pattern()
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(9)))
        found, needed = re.search(p, text), read(p)
        assert not (found and needed) or any(q in found.group() for q in needed), (p, text)


def test_rules_with_any_pattern_against_brute_force(spark):
    patterns = ["(uber|lyft).*eats", "shop|store", "c[ao]ffee( bar)?$", "\\d{3}", "(red|blue) (cup|bowl)s?", "^sq.*bar", "x?y?z", "(?i)tea", "ea(?=ts)", ".", "market (north|south)"]
    texts = ["uber trip eats", "lyft eats", "uber", "corner shop", "app store 7", "caffee bar", "coffee", "shop 123 red bowl", "blue cups", "sq red bar", "xz", "green tea", "market south", "Market North", "none"]
    schema = "id long, user_id string, match_field string, match_value string, match_type string, priority int, transaction_type string, category string, confidence_override double, is_active boolean"
    rules = spark.createDataFrame([(i, None, "description", p, "regex", i, "expense", f"Cat {i}", 0.9, True) for i, p in enumerate(patterns)], schema)
    given = spark.createDataFrame([(t, t, t) for t in texts], "description string, cleaned string, merchant string")
    best = classify.best_rules(given, rules, spark.createDataFrame([], "user_id string, description string"))
    found = {r.description: r.best.rule_id for r in best.collect()}
    # A higher priority goes first, whatever the id.
    assert found == {t: max(i for i, p in enumerate(patterns) if re.search(p, t, 0 if "(?i)" in p else re.I)) for t in texts if any(re.search(p, t, re.I) for p in patterns)}


def test_lines_without_a_year_or_day_are_rejected_with_a_reason(spark, tmp_path):
    line = lambda doc, n, text: (doc, 1, n, text)
    lines = [line(d, 1, "PURCHASE") for d in "abc"] + [line("a", 0, "Statement March 2012"), line("c", 0, "Statement March 2012")]
    lines += [line("a", 2, "03/05 CORNER SHOP 12.50"), line("b", 2, "03/05 CORNER SHOP 12.50"), line("c", 2, "13/05 CORNER SHOP 12.50"), line("c", 3, "03/06 CORNER SHOP 1.00"), line("c", 4, "not a line")]
    df = spark.createDataFrame(lines, "doc_id string, page int, line_no int, text string")
    assert sorted((r.doc_id, str(r.transaction_date)) for r in layout.parse_chase(df).collect()) == [("a", "2012-03-05"), ("c", "2012-03-06")]
    assert sorted((r.doc_id, r.text, r.reason) for r in layout.parse_chase.rejects(df).collect()) == [("b", "03/05 CORNER SHOP 12.50", "no date"), ("c", "13/05 CORNER SHOP 12.50", "no date")]
    judged, path = layout.parse_chase.judged(df), str(tmp_path / "judged")
    assert layout.write_judged(judged, path) == {"rows": 2, "rejected": 2, "no date": 2, "no amount": 0, "no description": 0}
    assert layout.judged_rows(spark, path, judged.schema).count() == 2 == layout.quarantine(spark, path, judged.schema).count()
