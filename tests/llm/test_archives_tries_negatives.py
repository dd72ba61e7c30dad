"""WARC archives, the conversation trie and hard negatives against brute force and on awkward rows."""

import hashlib
import io
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tallybook.llm import common, hard_negatives, prefix_trie, queries, warc

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_warc", "op12_prefix_trie", "op13_hard_negatives"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DIR)
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(found.columns)
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted(map(tuple, found.select(names).collect()), key=key) == sorted(cur.fetchall(), key=key)


# WARC

SAME = "<p>" + "the same page " * 20 + "</p>"
PAGES = [
    (4, "http://a.example/x y\r\nWARC-Type: fakeä", SAME), (3, None, SAME), (9, "http://b.example/", SAME), (9, "http://b.example/", SAME),
    (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", SAME), (None, "n", "n" * 100), (None, "n", "n" * 100),
    (10, "u", "long 日本\U0001f642 " * 400_000), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (12, "u", "e" * 99), (13, "u", "e" * 99), (14, "u", "f" * 100), (15, "u", "f" * 100),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, digest string, uses int")


def brute_pages(rows):
    shared = defaultdict(list)
    for i, _, html in rows:
        if len((html or "").encode()) >= 100:
            shared[html].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((x for x in shared.get(html, []) if x is not None), default=None)
        first = None if first == i else first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first is None else "revisit", first))
    return sorted(out, key=str)


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives(spark):
    found = warc.archived_pages(pages(spark, PAGES).repartition(3))
    assert sorted(map(tuple, found.select(FIELDS).collect()), key=str) == brute_pages(PAGES)
    assert warc.archived_pages(pages(spark, [])).count() == 0
    uris = {r["page_id"]: r["target_uri"] for r in found.collect()}
    assert uris[4] == "http://a.example/x%20y%0D%0AWARC-Type:%20fake%C3%A4" and uris[3] is None


def test_a_hot_payload_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rows = [(i, "u", "hot " * 50) for i in range(300)] + [(1000 + i, "u", f"pair {i // 2} " * 30) for i in range(200)]
    found = warc.archived_pages(pages(spark, rows))
    assert sorted(map(tuple, found.select(FIELDS).collect()), key=str) == brute_pages(rows)


def archive(records):
    class Held(io.BytesIO):
        def close(self):
            pass

    out = Held()
    writer = warc.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    assert writer.close() == (len(records), len(out.getvalue()))
    return out.getvalue()


def page_record(i, payload=None, first=None):
    payload = f"<html><head><title>page {i}</title></head><body>{'some words of a page ' * (i % 7 + 1)}{i * 7919}</body></html>".encode() if payload is None else payload
    return warc.record_bytes(i, f"http://host{i % 5}.example/{i}", payload, hashlib.sha256(payload).hexdigest(), first, "2020-01-01T00:00:00Z")


def test_dictionary_in_a_leading_skippable_frame():
    import zstandard

    records = [page_record(i) for i in range(600)]
    data = archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 20)
    plain = archive([page_record(0)])  # too little to train from: no dictionary, no leading frame
    assert plain[:4] == warc.FRAME_MAGIC and [p for *_, p in warc.read_records(io.BytesIO(plain))] == [None]
    found = list(warc.read_records(io.BytesIO(data)))
    assert len(found) == 600 and all(p is None for *_, p in found)
    # One frame per record: each decodes alone with the dictionary.
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    ends = [at for at, *_ in found[1:]] + [len(data)]
    for (at, r, _), end, raw in zip(found[::50], ends[::50], records[::50]):
        assert decoder.decompress(data[at:end]) == raw and r["headers"]["page-id"] == str(records.index(raw))
    # An uncompressed dictionary is accepted too, and a missing one is noticed.
    bare = warc.DICTIONARY_MAGIC + struct.pack("<I", len(dictionary)) + dictionary + data[8 + size :]
    assert all(p is None for *_, p in warc.read_records(io.BytesIO(bare))) and len(list(warc.read_records(io.BytesIO(bare)))) == 600
    assert all("dictionary" in p for _, r, p in warc.read_records(io.BytesIO(data[8 + size :])))


def test_broken_archives_are_reported():
    import zstandard

    good = page_record(1)
    pack = zstandard.ZstdCompressor().compress

    def problems(*records):
        return [p for *_, p in warc.read_records(io.BytesIO(b"".join(pack(r) for r in records)))]

    assert problems(good, good) == [None, None]
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC-Dote"), good[:-4], good + b"x", good[:-4] + b"\n\n\n\n",
        good.replace(b"some words", b"sane words"), good.replace(b"Content-Length", b"Content-Langth"), good.replace(b"WARC-Type: response", b"WARC-Type response"),
        good.replace(b"WARC-Date", b"WARC-Type"), page_record(2, b"x" * 200, 1).replace(b"identical", b"idontical"), b"", b"nothing",
    ):
        first, second = problems(bad, good)
        assert first and second is None, bad
    broken = bytearray(b"".join(pack(page_record(i, b"%d " % i * 3000)) for i in range(3)))
    starts = [at for at, *_ in warc.read_records(io.BytesIO(bytes(broken)))]
    broken[starts[1] + 12] ^= 0xFF
    found = list(warc.read_records(io.BytesIO(bytes(broken))))
    assert found[0][2] is None and found[1][2] and (found[-1][0], found[-1][2]) == (starts[2], None)
    cut = list(warc.read_records(io.BytesIO(archive([page_record(i) for i in range(3)])[:-20])))
    assert [bool(p) for *_, p in cut] == [False, False, True]
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_files_are_what_the_writer_wrote(spark, tmp_path):
    rows = [(i, "u", f"<p>page {i * 7919} of many</p>" * 9) for i in range(500)]
    folder, manifest = warc.write_archives(pages(spark, rows), str(tmp_path / "out"))
    for name, n, size in manifest.collect():
        data = (tmp_path / "out" / name).read_bytes()
        assert len(data) == size and data[:4] == warc.DICTIONARY_MAGIC
        assert [p for *_, p in warc.read_records(io.BytesIO(data))] == [None] * n


def test_dangling_revisits(spark, tmp_path):
    data = archive([page_record(1, b"p" * 200), page_record(2, b"p" * 200, first=1), page_record(3, b"q" * 200, first=99)])
    (tmp_path / "a.warc.zst").write_bytes(data)
    records = warc.read_archives(str(tmp_path), spark.createDataFrame([("a.warc.zst", 3, 1)], warc._ARCHIVES))
    assert [(r["refers_to"], r["payload_bytes"]) for r in warc.dangling_revisits(records).collect()] == [(99, 200)]


# Conversations


def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = 0 if children[node] else 1
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for kid in children[node]:
            leaves, saved = leaves + totals[kid][0], saved + totals[kid][1]
        totals[node] = leaves, saved
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def ordered(rows):
    """Conversations as the operator orders them; turns here differ within a conversation."""
    out = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out[c].append((role or "", text or ""))
    return out


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, pos int, n1 string, chars int")


def nodes(df):
    return sorted(tuple(r) for r in df.collect())


def some_turns():
    rng = np.random.default_rng(5)
    rows = [(c, t, ["user", "bot"][t % 2], f"text {rng.integers(3)}") for c in range(-40, 260) for t in range(rng.integers(1, 12))]
    rows += [(1000 + c, t, "user", "hot") for c in range(30) for t in range(c % 4 + 1)]
    rows += [(5000, t, "user", f"deep {t}") for t in range(300)] + [(5001, t, "user", f"deep {min(t, 270)}") for t in range(290)]
    rows += [(6000, None, "u", "null first"), (6000, -5, "u", "x"), (6001, None, None, None), (6002, 0, "", ""), (6003, 0, "a", "bc"), (6004, 0, "ab", "c")]
    return rows + [(None, 0, "u", "no conversation"), (7000, 0, "u", "long \U0001f642 " * 100_000), (7001, 9, "u", "long \U0001f642 " * 100_000)]


def test_trie(spark):
    rows = some_turns()
    assert nodes(prefix_trie.conversation_trie(turns_frame(spark, rows).repartition(7))) == brute_trie(ordered(rows))
    assert nodes(prefix_trie.conversation_trie(turns_frame(spark, []))) == []


def test_trie_of_repeated_rows_and_ties(spark):
    # Equal turns are ordered by a hash of role and text: the order is the same in every conversation.
    rows = [(c, 1, "u", t) for c in (1, 2) for t in ("a", "b", "b", "c")]
    found = nodes(prefix_trie.conversation_trie(turns_frame(spark, rows)))
    assert [r[:5] for r in found] == [(1, 0, None, 2, 1), *[(1, d, 1, 2, int(d < 4)) for d in range(1, 5)]]


def test_rebuilt_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_TURNS", 3)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [r for r in some_turns() if r[0] is None or r[0] >= 0 and r[0] not in (100, 5000)]
    turns = ordered(rows)
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    assert any(not t for t in rebuilt.values())
    spark.createDataFrame([], "a int")
    table = turns_frame(spark, rows)
    named = common.saved(prefix_trie.ordered_turns(table), "ordered")
    head = prefix_trie.F.crc32(prefix_trie.F.col("conv_id").cast("string").cast("binary")) % 6
    assert nodes(prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(named, 100, head, most=5))) == brute_trie(rebuilt)


# Hard negatives


def brute_negatives(rows, is_anchor, scale=256):
    kept = [(i, label, [int(np.floor(scale * x)) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, label, v) in enumerate(kept):
        if i is None or not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j, m) for n, (j, m, w) in enumerate(kept) if n != at and len(w) == len(v)]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for p in [s for s in scored if s[3] == label][:5]:
            found = [s for s in scored if s[3] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(i, p[2], r, s[2], -p[0], -s[0]) for r, s in enumerate(found, 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "vec_id long, label int, embedding array<double>, uid int, slot string, limits int")


def mined(df, anchors):
    return sorted(map(tuple, hard_negatives.mine_hard_negatives(df, anchors).collect()), key=str)


@pytest.mark.parametrize("block, stripe, scores, held", [(16384, 4096, 1 << 22, 500_000), (3, 50, 200, 20)])
def test_hard_negatives(spark, monkeypatch, block, stripe, scores, held):
    for name, value in (("BLOCK_ANCHORS", block), ("STRIPE_ROWS", stripe), ("SCORES", scores), ("HELD", held)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=4)
    rows = [(i, int(rng.integers(4)), (centre + 0.4 * rng.normal(size=4)).round(1).tolist()) for i in range(400)]
    rows += [(i, i % 2, [0.25, 0.5, 0.25, 0.5]) for i in range(400, 520)]  # one very common vector
    rows += rows[:20] + [(None, 1, [1.0] * 4), (None, 0, [1.0] * 4), (30, None, [1.0] * 4), (31, 1, None), (33, 1, [1.0, None, 1.0, 1.0]), (34, 1, [float("nan")] * 4), (35, 1, [float("inf")] * 4)]
    rows += [(600, 1, [1.0, 2.0]), (601, 1, [1.0, 1.5]), (602, 2, [1.0, 1.25]), (610, 3, []), (611, 3, []), (612, 4, []), (620, 9, [9.0] * 3)]
    rows += [(700 + i, i % 2, [0.0, 0.0, 0.0, float(-i)]) for i in range(4)]
    assert mined(vectors(spark, rows), "vec_id % 10 = 0") == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_huge_components(spark):
    rows = [(i, i % 2, [2.0**20 + i, 1e3 * i]) for i in range(12)]
    assert mined(vectors(spark, rows), "vec_id % 4 = 0") == brute_negatives(rows, lambda i: i % 4 == 0)
    assert hard_negatives.mine_hard_negatives(vectors(spark, [(0, 1, [1e300]), (1, 1, [1e300]), (2, 2, [1e300])]), "vec_id = 0").first()["negative_score"] == (1 << 63) - 1
    assert mined(vectors(spark, []), "vec_id = 0") == []
