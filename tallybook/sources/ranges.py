"""Lines of large text files, each file read in byte ranges by as many tasks as it has ranges.

Whether a line starts inside a quoted field depends on all text before it. Each line is therefore reduced to what it does
to either state (outside or inside a quoted field); such two-state steps compose, so a piece of a range becomes one step too,
and the states at the starts of pieces follow from a prefix over pieces. The same prefix numbers the lines. Text is read twice
(once for the pieces, once for the lines) and stays in the task that reads it; only lines cut at a piece's end are moved.

A quote opens a field at the field's start only, and only if the field is closed by a quote before a comma, a line's end
or the file's end; every other quote is plain text. That is decided by the first later line whose text from inside a field
does not just go on: it closes the field or proves that there was none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.sources.sinks import stored

INNER = r'(?:[^"]++|"")*+'
CLOSED_FIELD = rf'(?<![^,])"{INNER}"(?![^,])'
OPEN_FIELD = rf'(?<![^,])"{INNER}\z'
RANGE = ["path", "block"]
#: Lines of a piece at most; a task holds one piece of its range at a time.
PIECE_LINES = 1 << 16


def _leaves_open(text: Column) -> Column:
    """Whether a line read from outside a field ends inside one, if that field is closed later."""
    found = F.regexp_extract_all(text, F.lit(f'{CLOSED_FIELD}|({OPEN_FIELD})|"'), F.lit(1))
    return F.exists(found, lambda x: x != "")


def _marks(line: Column) -> dict[str, Column]:
    """What a line does: `closes` read from inside a field (null: it goes on), `opens` from outside, `reopens` after closing."""
    quoted, ends = line.contains('"'), rf'^{INNER}"(?=,|\z)'
    goes_on = ~quoted | line.rlike(rf"^{INNER}\z")
    no = F.lit(False)
    return {
        "closes": F.when(~goes_on, line.rlike(ends)),
        "opens": F.when(quoted, _leaves_open(line)).otherwise(no),
        "reopens": F.when(quoted & ~goes_on & line.rlike(ends), _leaves_open(F.regexp_replace(line, ends, ""))).otherwise(no),
    }


def range_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, raw, line marks) of the physical lines; `at` orders the lines of a range."""
    raw = spark.read.text(path).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    # Marks look at quotes, commas and ends only, which are the same bytes in UTF-8 and Latin-1.
    valid = F.is_valid_utf8("raw")
    text = F.when(valid, F.col("raw")).otherwise(F.decode(F.col("raw").cast("binary"), "ISO-8859-1"))
    return raw.select(*RANGE, "at", F.col("raw").cast("binary").alias("raw"), valid.alias("valid"), *[c.alias(n) for n, c in _marks(text).items()])


def _scanner():
    """Functions for Arrow tasks that read lines in the order of their range (nested, so that Spark ships them by value)."""
    import numpy as np

    def runs(batches, key):
        """Parts (batch, its rows' places in the run) of each run of rows with equal key columns, one list a run."""
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for c in key:
                x = b[c].dictionary_encode().indices.to_numpy(zero_copy_only=False)
                change[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = b.slice(start, end - start)
                own = tuple(part[c][0].as_py() for c in key)
                if held and own != last:
                    yield last, held
                    held = []
                held.append(part)
                last = own
        if held:
            yield last, held

    def marks(parts):
        """Of the lines of a run: whether something tells, what it tells (`closes`), `opens` and `reopens`."""
        read = lambda c, missing: np.concatenate([p[c].fill_null(missing).to_numpy(zero_copy_only=False) for p in parts])
        told = np.concatenate([p["closes"].is_valid().to_numpy(zero_copy_only=False) for p in parts])
        return told, read("closes", False), read("opens", False), read("reopens", False)

    def steps(told, closes, opens, reopens, after):
        """The state after each line, had the line begun outside or inside; `after` is what the lines behind the run tell first."""
        n = len(told)
        following = np.minimum.accumulate(np.where(told, np.arange(n), n)[::-1])[::-1]  # the first at or behind each line
        following = np.r_[following[1:], n]
        closed_later = np.r_[closes, after][following]
        return opens & closed_later, ~told | (closes & reopens & closed_later)

    def states(from_out, from_in, inside):
        """The state before each line, and after the last."""
        n = len(from_out)
        turned = np.r_[0, np.cumsum(from_out & ~from_in)]
        fixed = np.r_[0, np.maximum.accumulate(np.where(from_out == from_in, np.arange(1, n + 1), 0))]
        value = np.r_[inside, from_out][fixed]
        return value ^ ((turned - turned[fixed]) % 2 == 1)

    return runs, marks, steps, states


#: What a piece does for either thing that the lines behind it tell first (f, t) and for either state before it.
PIECE_WAYS = [(after, start) for after in "ft" for start in ("out", "in")]
PIECE_SCHEMA = "path string, block long, piece long, first long, n long, valid boolean, first_closes boolean, " + ", ".join(
    f"{a}_{s} struct<ends:boolean,begun:long,head:long,tail:long>" for a, s in PIECE_WAYS)


def _pieces(ways):
    """One row for each piece: the state it ends in, lines begun, lines that go on at its start, lines from the last begun one on."""
    runs, marks, steps, states = _scanner()

    def pieces(batches):
        import numpy as np
        import pyarrow as pa

        way = pa.struct([("ends", pa.bool_()), ("begun", pa.int64()), ("head", pa.int64()), ("tail", pa.int64())])
        schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("piece", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("valid", pa.bool_()), ("first_closes", pa.bool_())] + [(f"{a}_{s}", way) for a, s in ways])
        for (path, block, piece), parts in runs(batches, ["path", "block", "piece"]):
            told, closes, opens, reopens = marks(parts)
            n = len(told)
            row = {"path": path, "block": block, "piece": piece, "first": parts[0]["at"][0].as_py(), "n": n, "first_closes": bool(closes[told.argmax()]) if told.any() else None}
            row["valid"] = all(p["valid"].to_numpy(zero_copy_only=False).all() for p in parts)
            for a, s in ways:
                state = states(*steps(told, closes, opens, reopens, a == "t"), s == "in")
                begun = np.flatnonzero(~state[:-1])
                first, last = (int(begun[0]), int(begun[-1])) if len(begun) else (n, 0)
                row[f"{a}_{s}"] = {"ends": bool(state[-1]), "begun": len(begun), "head": first, "tail": n - last}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return pieces


def _whole():
    """(id, line_no, line) of the lines that begin and end in their piece."""
    runs, marks, steps, states = _scanner()

    def whole(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("id", pa.int64()), ("line_no", pa.int64()), ("line", pa.string())])
        for (own,), parts in runs(batches, ["id"]):
            n, inside, after, earlier = (parts[0][c][0].as_py() for c in ("n", "inside", "after", "earlier"))
            if own is None or n != sum(p.num_rows for p in parts):
                raise ValueError("the ranges of the files are not those of the first read; run again")
            state = states(*steps(*marks(parts), after), inside)
            begun = np.flatnonzero(~state[:-1])
            ends = np.r_[begun[1:], n + 1 if state[-1] else n]  # the last one may go on behind the piece
            done, at, stop, held = 0, 0, 0, []
            for p in parts:
                # `held` has lines from `at` on, that end in a later part.
                text, stop = pa.concat_arrays([*held, p["text"]]) if held else p["text"], stop + p.num_rows
                ready = int(np.searchsorted(ends[: len(begun)], stop, side="right"))
                if ready > done:
                    cuts = np.r_[begun[done:ready], ends[ready - 1]] - at
                    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), text), " ")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(ready - done, own), pa.int64()), pa.array(np.arange(earlier + done, earlier + ready), pa.int64()), lines], schema=schema)
                    done = ready
                rest = min(int(begun[done]), stop) if done < len(begun) else stop
                held, at = [text.slice(rest - at)] if rest < stop else [], rest

    return whole


def _started_inside(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds what is known of the state before each step: `known` (the state, or null) and `flips`.

    A step is (from_out, from_in): the state after it for either state before it. With S the state before the first step,
    the state before a step is coalesce(known, S) xor flips.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fixed, flip = F.col("from_out") == F.col("from_in"), (F.col("from_out") & ~F.col("from_in")).cast("long")
    steps = steps.withColumn("_odd", F.sum(flip).over(upto) % 2 == 1)
    own = F.when(fixed, F.col("from_out") != F.col("_odd"))
    return steps.withColumns({
        "known": F.last(own, ignorenulls=True).over(before), "flips": F.coalesce(F.lag("_odd").over(Window.partitionBy(*keys).orderBy(order)), F.lit(False)),
        "_own": own})


def _state(known: Column, first: Column, flips: Column) -> Column:
    return F.coalesce(known, first) != flips


def _later(df: DataFrame, value: str, keys: list[str], order: str) -> Column:
    """First non-null value of the rows after this one."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files of any size; quoted fields stay on one line, their breaks as spaces.

    Same rows as `files.text_lines` on the read files, without the empty line after a last line break. A file with
    undecodable bytes anywhere is read as Latin-1. Ranges are the splits of the scan (`spark.sql.files.maxPartitionBytes`).
    An empty file has no lines. Pieces of a file are gathered in one place, its lines never are.
    """
    return whole_lines(range_lines(spark, path))


def whole_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, line) from `range_lines`, which are read twice: a run fails if the second read has other pieces."""
    lines = lines.withColumn("piece", F.floor(F.col("at") / PIECE_LINES))
    pieces = lines.select(*RANGE, "piece", "at", "valid", "closes", "opens", "reopens").mapInArrow(_pieces(PIECE_WAYS), PIECE_SCHEMA)
    pieces = pieces.withColumn("place", F.struct("block", "piece"))
    pieces = pieces.withColumns({"after": F.coalesce(_later(pieces, "first_closes", ["path"], "place"), F.lit(False)), "utf8": F.min("valid").over(Window.partitionBy("path"))})
    pieces = pieces.withColumns({f"if_{s}": F.when(F.col("after"), F.col(f"t_{s}")).otherwise(F.col(f"f_{s}")) for s in ("out", "in")})
    # A whole piece as one step, and the states before pieces; files start outside.
    pieces = _started_inside(pieces.withColumns({"from_out": F.col("if_out.ends"), "from_in": F.col("if_in.ends")}), ["path"], "place")
    pieces = pieces.withColumn("inside", _state(F.col("known"), F.lit(False), F.col("flips")))
    pieces = pieces.withColumn("does", F.when(F.col("inside"), F.col("if_in")).otherwise(F.col("if_out")))
    earlier = F.sum("does.begun").over(Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*RANGE, "piece", "first", "n", "inside", "after", "utf8", "does.*", F.coalesce(earlier, F.lit(0).cast("long")).alias("earlier"))
    pieces = stored(pieces.withColumn("id", F.monotonically_increasing_id()), "range-pieces")

    # One row for up to PIECE_LINES lines: broadcast, so that lines stay where and in the order in which they are read.
    placed = lines.drop("valid").join(F.broadcast(pieces), [*RANGE, "piece"], "left")
    text = F.when(F.col("utf8"), F.col("raw").cast("string")).otherwise(F.decode("raw", "ISO-8859-1"))
    whole = placed.select("id", "n", "inside", "after", "earlier", "closes", "opens", "reopens", text.alias("text")).mapInArrow(_whole(), "id long, line_no long, line string")
    whole = whole.join(F.broadcast(pieces.select("id", "path")), "id").select("path", F.col("line_no").cast("int").alias("line_no"), "line")
    # Only lines that are cut at the end of a piece are moved to be put together.
    at, cut_head = F.col("at") - F.col("first"), F.col("at") - F.col("first") < F.col("head")
    cut = placed.filter(cut_head | (F.col("ends") & (at >= F.col("n") - F.col("tail"))))
    number = F.col("earlier") - 1 + F.when(cut_head, F.lit(0)).otherwise(F.col("begun"))
    parts = cut.select("path", number.cast("int").alias("line_no"), "block", "at", text.alias("line")).groupBy("path", "line_no").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("p"))
    joined = parts.select("path", "line_no", F.array_join(F.transform("p", lambda x: x["line"]), " ").alias("line"))
    return whole.unionByName(joined)
