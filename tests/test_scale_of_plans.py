"""Rewritten operators give the rows of a plain loop, and their plans move rows no more often than needed."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.operators import dedup
from tallybook.sources import layout


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def words(spark):
    r = random.Random(3)
    rows = []
    for doc in "ab":
        for page in range(4):
            step = r.choice([0.5, 2.0, 3.0, 9.0])
            rows += [(doc, page, round(r.randrange(40) * step, 1), float(r.randrange(6)), r.choice("xyz")) for _ in range(60)]
    rows += [("a", 0, None, 1.0, "n"), (None, 0, 1.0, 1.0, "n"), ("a", None, 1.0, 1.0, "n"), ("c", 1, float("nan"), 1.0, "n"), ("c", 1, float("nan"), 2.0, "m"), ("c", 1, 5.0, 2.0, "k")]
    return rows, spark.createDataFrame(rows, "doc_id string, page int, top double, x0 double, text string")


def anchored(rows, tolerance=3.0):
    """The rule as a loop: a height further than `tolerance` above the row's first height starts a row."""
    found = {}
    pages = {(d, p) for d, p, t, _, _ in rows if d is not None and p is not None and t is not None}
    for d, p in pages:
        own = [(t, x, w) for a, b, t, x, w in rows if (a, b) == (d, p) and t is not None]
        numbers, anchor = sorted((w for w in own if w[0] == w[0])), None
        for t, x, w in numbers:
            anchor = t if anchor is None or t - anchor > tolerance else anchor
            found.setdefault((d, p, anchor), []).append((x, w))
        for _, x, w in (w for w in own if w[0] != w[0]):
            found.setdefault((d, p, "nan"), []).append((x, w))
    return sorted((d, p, str(t), " ".join(w for _, w in sorted(ws))) for (d, p, t), ws in found.items())


def test_rows_by_anchor_as_a_loop_and_with_one_exchange(words):
    rows, df = words
    got = layout.rows_by_anchor(df)
    assert exchanges(got) == 1  # heights and words met in a join before, and each height looked through all anchors of its page
    assert sorted((r.doc_id, r.page, str(r.row), r.text) for r in got.collect()) == anchored(rows)


def test_in_layout_keeps_the_words_of_a_row_together(spark, words):
    rows, df = words
    banks = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "none")], "doc_id string, bank string")
    table = spark.createDataFrame([("one", "l", 0.0, 3.0), ("one", "r", 2.0, 6.0), ("two", "l", 1.0, 2.0), ("two", "gap", 5.0, 5.0)], "bank string, field string, lo double, hi double")
    lines = layout.rows_by_anchor(df)
    got = layout.in_layout(lines, banks, table)
    want = []
    ranges = {"a": {"l": (0, 3), "r": (2, 6)}, "b": {"l": (1, 2)}}
    for r in lines.collect():
        fields = {f: [w.text for w in r.words if lo <= w.x0 < hi] for f, (lo, hi) in ranges.get(r.doc_id, {}).items()}
        fields = {f: " ".join(ws) for f, ws in fields.items() if ws}
        if fields:
            want.append((r.doc_id, r.page, r.row, sorted(fields.items())))
    assert sorted((r.doc_id, r.page, r.row, sorted(r.fields.items())) for r in got.collect()) == sorted(want)
    assert exchanges(got.select(F.size("fields"))) <= 2  # words were regrouped by field and by row before


SCHEMA = "user_id string, seq string, bank_source string, account_name string, transaction_date date, amount decimal(18,2), description string, ext_id string"


def test_batch_rows_move_once_and_by_short_keys(spark):
    day = dt.date(2001, 3, 5)
    rows = [("u", str(i), "b", account, day, Decimal("-4.50"), text, None) for i, (account, text) in enumerate([(None, "Coffee"), ("", "coffee "), ("", "COFFEE"), ("a", "coffee"), (None, None)])]
    rows += [("u", str(10 + i), "b", "a", day, Decimal(-i), "other", "OFX-1") for i in range(3)]
    df = dedup.with_fingerprint(spark.createDataFrame(rows, SCHEMA))
    got = dedup.first_in_batch(df)
    assert sorted(r.seq for r in got.collect()) == ["0", "10", "3", "4"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_same" not in plan  # every row was first moved by fingerprint and text, which a batch repeats in three columns
    fresh = dedup.new_by_fingerprint(df, df.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in fresh and "_print" in fresh
