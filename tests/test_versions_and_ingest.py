"""Superseding runs, levels of versions, and the ingest stream: the same ledger however the rows are split."""

import datetime as dt
import os
import random

from test_operators import frame, kept, row

from tallybook.operators import dedup as dd
from tallybook.sources import sinks
from tallybook.sources import versions as vs
from tallybook.streaming import ingest as ing


def test_runs_supersede_each_other(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run, value in ((3, "a"), (7, "b"), (9, "c"), (9, "d")):
        vs.commit_run(spark.createDataFrame([(value,)], "v string"), path, run)
    assert sorted((r.run, r.v, r.is_active) for r in vs.read_runs(spark, path).collect()) == [(3, "a", False), (7, "b", False), (9, "d", True)]
    assert [r.v for r in vs.active_run(spark, path).collect()] == ["d"] and [r.v for r in vs.active_run(spark, path, as_of=7).collect()] == ["b"]
    # A run that was written but not yet named does not count.
    spark.createDataFrame([("x",)], "v string").write.parquet(f"{path}/run-12")
    assert [r.v for r in vs.active_run(spark, path).collect()] == ["d"]


def test_levels_stay_few_and_keep_the_newest(spark, tmp_path):
    path, expected, rnd = str(tmp_path / "levels"), {}, random.Random(1)
    for batch in range(30):
        changed = {(f"u{rnd.randrange(6)}", "2024-01"): batch * 100 + i for i in range(3)}
        expected |= changed
        rows = spark.createDataFrame([(*k, v, batch) for k, v in changed.items()], "user_id string, ym string, cents long, txn_count long").coalesce(1)
        vs.add_version(rows, path, batch, ["user_id", "ym"], fanout=3)
        vs.add_version(rows.limit(0), path, batch, ["user_id", "ym"], fanout=3)  # the batch runs again
    assert {(r.user_id, r.ym): r.cents for r in vs.current_version(spark, path, ["user_id", "ym"]).collect()} == expected
    folders = [x for x in os.listdir(path) if x.startswith("v")]
    assert len(folders) <= 3 * 4 + 3 and len(vs.read_pointer(spark, path)["valid"]) <= 2 * 4


def arrivals():
    rnd = random.Random(9)
    rows = []
    for i in range(240):
        ext = rnd.choice([None, None, f"EXT-{rnd.randrange(25):04d}"])
        rows.append(row(i, rnd.randrange(90), rnd.choice([-5, -6, 0]), rnd.choice(["Red Cup", "red cup", "POS PURCHASE RED CUP"]), rnd.choice("ab"), ext))
    return rows


def ingested(spark, tmp_path, rows, parts, history=None):
    """The rows as files of about equal size, a micro-batch each."""
    name = f"in{parts}"
    source, size = tmp_path / name, -(-len(rows) // parts)
    for i in range(parts):
        frame(spark, rows[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(str(source))
    files = sorted((f for f in source.iterdir() if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)
    for i, f in enumerate(files):
        os.utime(f, (1_700_000_000 + i * 10,) * 2)
    stream = ing.statement_stream(spark, str(source), spark.read.parquet(str(source)).schema, files_per_batch=1)
    ing.start_ingest(stream, str(tmp_path / f"out{parts}"), str(tmp_path / f"state{parts}"), history).awaitTermination()
    return kept(spark.read.parquet(str(tmp_path / f"out{parts}")))


def test_ingest_does_not_depend_on_the_split(spark, tmp_path):
    rows = arrivals()
    once = kept(dd.first_in_batch(dd.with_fingerprint(frame(spark, rows))))
    assert ingested(spark, tmp_path, rows, 1) == once == ingested(spark, tmp_path, rows, 4)


def test_ingest_of_similar_rows_and_returning_ids(spark, tmp_path):
    rows = [row(0, 1, -5, "Red Cup"), row(1, 3, -5, "red cup"), row(2, 9, -7, "Blue Bowl", ext="EXT-9000")]
    rows += [row(3, 80, -7, "Blue Bowl", ext="EXT-9000"), row(4, 4, -5, "red cup"), row(5, 5, -5, "RED CUP")]
    ingested(spark, tmp_path, rows, 2)
    out = spark.read.parquet(str(tmp_path / "out2"))
    # t1 is similar to t0 in its own batch; t3 brings an id back in another month; t4 is three days from t0, t5 four.
    assert kept(out) == ["t0", "t2", "t5"]
    first = ingested(spark, tmp_path, rows[:3], 3, history=frame(spark, [row(99, 2, -5, "red cup")]))
    assert first == ["t2"]
    assert dt.date(2024, 1, 1) < out.agg({"transaction_date": "max"}).first()[0]


def test_deletions_rewrite_only_their_months(spark, tmp_path):
    rows = [row(i, i * 4, -10 - i, f"shop {i}", user="ab"[i % 2]) for i in range(40)]
    path = str(tmp_path / "ledger")
    sinks.append_ledger(frame(spark, rows), path)
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in tmp_path.glob("ledger/ym=*/*.parquet")}
    before = files()
    gone = spark.createDataFrame([("a", f"t{i}") for i in range(0, 12, 2)] + [("b", "t5"), ("a", "t21"), ("b", "none")], "user_id string, transaction_id string")
    first = {r.transaction_id: r.user_id for r in gone.collect()}
    assert sinks.delete_from_ledger(path, gone) == ["2024-01", "2024-02"]
    left = {r[1] for r in rows} - {t for t, u in first.items() if any(r[0] == u and r[1] == t for r in rows)}
    assert kept(spark.read.parquet(path)) == sorted(left) and "t21" in left
    changed = {k[0].split("/")[0] for k in set(before.items()) ^ set(files().items())}
    assert changed == {"ym=2024-01", "ym=2024-02"}
    # A month that is emptied loses its folder, and a deletion of nothing changes nothing.
    march = [(r[0], r[1]) for r in rows if r[3].month == 3]
    assert sinks.delete_from_ledger(path, spark.createDataFrame(march, "user_id string, transaction_id string")) == ["2024-03"]
    assert not (tmp_path / "ledger" / "ym=2024-03").exists() and sinks.delete_from_ledger(path, gone) == []
