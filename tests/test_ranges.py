"""Lines read in byte ranges against the whole-file reader."""

import random

from tallybook.sources import files as fl
from tallybook.sources import ranges as rg
from tallybook.sources.sinks import stored


def tiny_ranges(spark, path, size=40):
    """Written lines of ranges of a few bytes, so that every file has many."""
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        return stored(rg.range_lines(spark, path), "ranges")
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


def whole_file(spark, path):
    """Lines of the whole-file reader, without the empty line after a last line break."""
    out = {}
    for r in fl.text_lines(fl.statement_files(spark, path)).collect():
        out.setdefault(r["path"].split("/")[-1], []).append((r["line_no"], r["line"]))
    texts = {name: sorted(x) for name, x in out.items()}
    return {name: (x[:-1] if x[-1][1] == "" else x) for name, x in texts.items()}


def by_range(spark, path):
    out = {}
    for r in rg.whole_lines(tiny_ranges(spark, path)).collect():
        out.setdefault(r["path"].split("/")[-1], []).append((r["line_no"], r["line"]))
    return {name: sorted(x) for name, x in out.items()}


def test_random_files_equal_the_whole_file_reader(spark, tmp_path):
    rnd = random.Random(5)
    pieces = ['a', 'bc', ',', ',', '"', '""', ',"', '",', '\n', '\n', '"\n', '\n"', 'é', 'x' * 30]
    for i in range(30):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 90)))
        (tmp_path / f"f{i}.csv").write_text(text + ("end" if text.endswith("\n\n") else ""), encoding="utf-8")
    mine, theirs = by_range(spark, str(tmp_path)), whole_file(spark, str(tmp_path))
    assert {k: x for k, x in mine.items() if x} == {k: x for k, x in theirs.items() if x}


def test_awkward_files(spark, tmp_path):
    long = "word " * 40
    texts = {
        "empty.csv": b"", "one.csv": b"no break", "bom.csv": b"\xef\xbb\xbfDate,Amount\n1,2\n", "latin.csv": b'Date,"caf\xe9\nbar"\r\nplain,"x"\n',
        "far.csv": f'a,"{long}\n{long}\n{long}",z\nb,5" pipe,z\nc,"never closed,z\nd,"ok",z\n'.encode(), "with space+plus.csv": b'"a\r\nb"\rc\n',
    }
    for name, body in texts.items():
        (tmp_path / name).write_bytes(body)
    mine, theirs = by_range(spark, str(tmp_path)), whole_file(spark, str(tmp_path))
    theirs.pop("empty.csv", None)
    assert mine == theirs
    assert mine["with space+plus.csv"] == [(0, '"a b"'), (1, "c")]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("".join(f'{i},"left\nright {i}",{i}\n' for i in range(200)))
    lines = tiny_ranges(spark, str(tmp_path), 300)
    assert lines.select("block").distinct().count() > 8
    rows = rg.whole_lines(lines).collect()
    assert len(rows) == rg.text_lines(spark, str(tmp_path)).count()
    assert sorted((r["line_no"], r["line"]) for r in rows) == [(i, f'{i},"left right {i}",{i}') for i in range(200)]


def test_lines_stay_with_the_task_that_reads_them(spark, tmp_path, monkeypatch):
    """Text is neither written nor sorted by range on the way, however small pieces and Arrow batches are."""
    rnd = random.Random(8)
    pieces = ['a', ',"', '",', '"', '""', '\n', '\n', '"\n', '\n"', 'bcd,e\n', ',"x\ny"\n']
    for i in range(20):
        (tmp_path / f"f{i}.csv").write_text("".join(rnd.choice(pieces) for _ in range(rnd.randint(20, 200))) + "end", encoding="utf-8")
    written, store = [], rg.stored
    monkeypatch.setattr(rg, "stored", lambda df, name: (written.extend(df.columns), store(df, name))[1])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for lines, batch in ((3, 2), (8, 3), (1000, 5)):
            monkeypatch.setattr(rg, "PIECE_LINES", lines)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            assert by_range(spark, str(tmp_path)) == whole_file(spark, str(tmp_path))
        plan = rg.text_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "raw" not in written and "Window" not in plan
