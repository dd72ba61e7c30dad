"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Each writing task fills archives of about ARCHIVE_BYTES. It buffers the first records of an archive, trains a dictionary from
them, writes it as a skippable frame (compressed itself) and then one frame per record. The reader loads the dictionary from
that frame, decodes frame by frame without holding more than one record, and checks the version line, the required fields, the
block length, the closing empty lines, both digests, the HTTP length and the dictionary id. A record that fails is reported
with its reason and place; after a broken frame the reader goes on at the next one.

A payload that several records share is stored once: the others are revisit records without it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import looked_up, ready, saved
from tallybook.llm.token_files import file_system
from tallybook.sources.sinks import scratch_path

#: Fixed values of the formats: magic numbers of a skippable frame that holds a dictionary, and of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 256 << 20
#: Bytes and records buffered to train the dictionary of an archive, the most of one record that count, and the dictionary's bytes.
TRAIN_BYTES, TRAIN_RECORDS, TRAIN_PART, DICTIONARY_BYTES = 1 << 20, 400, 16 << 10, 16 << 10
#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 100
#: Bytes read and first decoded at a time, and the most a record's header and content may have.
READ_BYTES, FEED_BYTES, MOST_BYTES = 1 << 20, 8 << 10, 1 << 31
#: The most tasks that read archives.
READERS = 20_000
_NAMES = uuid.UUID("8f0e6d2a-8a43-5a0f-9a53-0c6a1f6f0b11")
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*)", re.S)
_ARCHIVES = "archive string, n_records long, n_bytes long"
RECORD = "archive string, position long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, target_uri string, problem string"


def record_id(page_id, digest: str) -> str:
    """A record is named by its page and payload; equal rows write the same record again."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest}')}>"


def record_bytes(page_id, url, payload: bytes, digest: str, first, date: str) -> bytes:
    """One WARC record; with `first` (a page id) a revisit of that page's record, which leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if page_id is not None:
        fields.append(("Page-ID", page_id))
    if first is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("Refers-To-Page-ID", first)]
    fields += [
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"\r\n".join([VERSION, *[f"{k}: {v}".encode() for k, v in fields], b"", block]) + END


class ArchiveWriter:
    """Writes one archive at `path`; the file is whole once `close` has returned its record count and bytes."""

    def __init__(self, stream):
        self.stream, self.held, self.n_held, self.records, self.bytes, self.compressor = stream, [], 0, 0, 0, None

    def add(self, record: bytes):
        self.records += 1
        if self.compressor:
            self._put(self.compressor.compress(record))
            return
        self.held.append(record)
        self.n_held += len(record)
        if self.n_held >= TRAIN_BYTES or len(self.held) >= TRAIN_RECORDS:
            self._start()

    def _put(self, data):
        self.stream.write(data)
        self.bytes += len(data)

    def _start(self):
        import zstandard

        samples, dictionary = [r[:TRAIN_PART] for r in self.held], None
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, f=18, accel=5)
        except zstandard.ZstdError:  # too few or too small records
            pass
        if dictionary:
            content = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
            self._put(DICTIONARY_MAGIC + struct.pack("<I", len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for record in self.held:
            self._put(self.compressor.compress(record))
        self.held = []

    def close(self) -> tuple[int, int]:
        if not self.compressor:
            self._start()
        self.stream.close()
        return self.records, self.bytes


def _write(folder, date):
    def write(batches):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        writer = name = None

        def archive():
            row = [[name], *[[x] for x in writer.close()]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), *[pa.array(x, pa.int64()) for x in row[1:]]], ["archive", "n_records", "n_bytes"])

        for b in batches:
            urls, ids, digests, firsts = (b[c].to_pylist() for c in ("url", "page_id", "digest", "first"))
            for i in range(len(ids)):
                if writer is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(fs.open_output_stream(f"{path}/{name}", compression=None))
                writer.add(record_bytes(ids[i], urls[i], b["payload"][i].as_py(), digests[i], firsts[i], date))
                if writer.bytes >= ARCHIVE_BYTES:
                    yield archive()
                    writer = None
        if writer:
            yield archive()

    return write


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Write a record for every row of page_id, url and html; returns the folder and the manifest, one row per archive.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of LEAST_SHARED bytes or more, that with the
    smallest page_id is a response and the others revisit it; rows that share this smallest id are responses all, and so are
    rows whose payload has no row with an id. A null page_id or url leaves its field out. Characters of a url that do not
    belong into a header are percent-encoded. An empty table writes no archive. Only archives of the manifest count: a task
    that is repeated writes new files, and those of the lost attempt are never listed. Other columns are not read.
    """
    spark = ready(pages.sparkSession)
    folder = folder or scratch_path(spark, "archives")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("uses"))
    shared = saved(shared.where("uses > 1"), "shared")
    rows = rows if shared.isEmpty() else looked_up(rows, shared, ["digest"], "uses")
    first = F.col("first") if "first" in rows.columns else F.lit(None).cast("long")
    first = F.when(first.eqNullSafe(F.col("page_id")), None).otherwise(first)
    manifest = rows.select("page_id", "url", "payload", "digest", first.alias("first")).mapInArrow(_write(folder, date), _ARCHIVES)
    return folder, saved(manifest, "manifest")


class _Source:
    """A stream read in pieces, with a look at what comes next."""

    def __init__(self, stream):
        self.stream, self.held, self.begin, self.at = stream, b"", 0, 0

    def need(self, n: int) -> bytes:
        """The next n bytes, or all that are left, without moving on."""
        have = len(self.held) - self.begin
        if have < n:
            parts = [self.held[self.begin :]]
            while have < n and (part := self.stream.read(max(READ_BYTES, n - have))):
                parts.append(part)
                have += len(part)
            self.held, self.begin = b"".join(parts), 0
        return self.held[self.begin : self.begin + n]

    def skip(self, n: int):
        self.begin += n
        self.at += n


def _dictionary(source: _Source):
    """The dictionary of the leading skippable frame, plain or compressed; None where there is none."""
    import zstandard

    head = source.need(8)
    if len(head) < 8 or head[:4] != DICTIONARY_MAGIC:
        return None
    size = struct.unpack("<I", head[4:])[0]
    content = source.need(8 + size)[8:]
    if len(content) < size:
        raise ValueError("dictionary frame is cut off")
    source.skip(8 + size)
    if content[:4] == FRAME_MAGIC:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return zstandard.ZstdCompressionDict(content)


def _frame(source: _Source, dictionary, most: int) -> bytes:
    """Decode one frame and move behind it."""
    import zstandard

    head = source.need(18)
    if head[:4] != FRAME_MAGIC:
        raise ValueError("no frame here")
    used = zstandard.get_frame_parameters(head).dict_id
    if used and used != (dictionary.dict_id() if dictionary else 0):
        raise ValueError(f"dictionary {used} is not at hand")
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    out, n, size = [], 0, FEED_BYTES
    while not decoder.eof:
        part = source.need(size)
        if not part:
            raise ValueError("frame is cut off")
        out.append(decoder.decompress(part))
        n += len(out[-1])
        if n > most:
            raise ValueError(f"record of more than {most} bytes")
        source.skip(len(part) - len(decoder.unused_data))
        size = min(2 * size, READ_BYTES)
    return b"".join(out)


def _to_next_frame(source: _Source):
    """Move to the next place that looks like a frame, or to the end."""
    source.skip(1)
    while True:
        part = source.need(READ_BYTES)
        at = part.find(FRAME_MAGIC)
        if at >= 0 or len(part) < 4:
            source.skip(at if at >= 0 else len(part))
            return
        source.skip(len(part) - 3)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        found = _FIELD.fullmatch(line)
        if not found:
            raise ValueError("malformed header line")
        name, value = found[1].decode().lower(), found[2].decode().strip()
        if name in out and name != "warc-concurrent-to":
            raise ValueError(f"{name} given twice")
        out[name] = value
    return out


def _length(headers: dict[str, str], name: str = "content-length") -> int:
    value = headers.get(name, "")
    if not re.fullmatch("[0-9]{1,18}", value):
        raise ValueError(f"no valid {name}")
    return int(value)


def parse_record(data: bytes) -> dict:
    """Fields of one record; ValueError with the reason where headers, lengths or digests do not hold."""
    head, found, rest = data.partition(END)
    if not found:
        raise ValueError("header does not end")
    version, *lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("no WARC version line")
    headers = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not headers.get(name):
            raise ValueError(f"no {name}")
    size = _length(headers)
    if len(rest) != size + len(END):
        raise ValueError(f"content of {max(0, len(rest) - len(END))} bytes, {size} announced")
    if rest[size:] != END:
        raise ValueError("record does not end in two empty lines")
    block, kind = rest[:size], headers["warc-type"]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest differs")
    out = {"record_type": kind, "target_uri": headers.get("warc-target-uri"), "record_id": headers["warc-record-id"], "headers": headers, "block": block}
    if kind not in ("response", "revisit"):
        return out
    http, found, payload = block.partition(END)
    status, *lines = http.split(b"\r\n")
    if not found or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    n, digest = _length(_headers(lines)), headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload length or digest differs")
    if kind == "revisit" and (payload or headers.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in headers or not re.fullmatch("[0-9a-f]{64}", digest)):
        raise ValueError("revisit without its profile, target or digest")
    return out | {"payload": payload, "payload_bytes": n, "payload_digest": digest}


def read_records(stream, most: int = MOST_BYTES):
    """(position, record, problem) of every frame of an archive: the record as `parse_record` gives it, or the problem as text."""
    import zstandard

    source = _Source(stream)
    dictionary = _dictionary(source)
    while source.need(1):
        at = source.at
        try:
            data = _frame(source, dictionary, most)
        except (ValueError, zstandard.ZstdError) as e:
            if source.at == at:
                _to_next_frame(source)
            elif source.need(4) != FRAME_MAGIC:
                _to_next_frame(source)
            yield at, None, str(e)
            continue
        try:
            yield at, parse_record(data), None
        except ValueError as e:
            yield at, None, str(e)


def _number(headers, name):
    return int(headers[name]) if name in headers else None


def _read(folder, schema):
    def read(batches):
        fs, path = file_system(folder)
        for b in batches:
            for name in b["archive"].to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for at, r, problem in read_records(stream):
                        h = r["headers"] if r else {}
                        if r and r["record_type"] not in ("response", "revisit"):
                            continue
                        fields = (r["record_type"], _number(h, "page-id"), _number(h, "refers-to-page-id"), r["payload_bytes"], r["payload_digest"], r["target_uri"]) if r else (None,) * 6
                        rows.append((name, at, *fields, problem))
                        if len(rows) >= 4000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)

    return read


_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RECORD.split(", ")])


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """A row for every response and revisit record of the manifest's archives, which are dealt one by one to up to READERS tasks.

    For a revisit, payload_bytes and payload_digest are those of the payload it leaves out. A record that does not hold has a
    `problem` and no other field but its archive and position. Records of other types are passed over.
    """
    names = manifest.select("archive")
    return names.repartition(max(1, min(READERS, names.count()))).mapInArrow(_read(folder, _SCHEMA), RECORD)


def dangling_revisits(records: DataFrame) -> DataFrame:
    """Targets (refers_to, payload_digest) of revisits for which no response of that page, payload and length was read."""
    asked = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").count()
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return asked.join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back, and returns their records; an error where a record does not hold."""
    records = saved(read_archives(*write_archives(pages)), "records")
    broken = records.where("problem is not null").first()
    if broken or not dangling_revisits(records).isEmpty():
        raise ValueError(f"archives do not hold: {broken or 'a revisit without its response'}")
    return records
