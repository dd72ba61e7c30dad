"""Token ids as Arrow files of equal-length sequences with masks.

One pair of files for each range bucket of doc_id: `tokens-*.arrow` (Arrow's file format; batches of fixed-size lists: ids and
mask, so that any sequence is a slice of the mapped file) and `docs-*.arrow` (doc_id, start, n_tokens). Files get their final
name when they are whole, and a repeated task writes the same file again.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import ready, saved, text_or_empty
from tallybook.llm.ordered import in_id_order
from tallybook.llm.word_ids import batch_rows, word_ids
from tallybook.sources.sinks import scratch_path

#: Ids of one sequence, and sequences of one record batch.
SEQUENCE, BATCH = 2048, 64
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "bucket int, tokens_file string, docs_file string, n_tokens long, n_docs long"


def file_system(folder: str):
    """Arrow's file system of a folder's URI, and the folder's path in it."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]+:", folder):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)


class _Writer:
    """The two files of one bucket."""

    def __init__(self, folder, bucket, length, kind):
        self.fs, self.path = file_system(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.bucket, self.length, self.kind, self.mark = bucket, length, kind, uuid.uuid4().hex
        self.names = [f"tokens-{bucket:05d}.arrow", f"docs-{bucket:05d}.arrow"]
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.streams = [self.fs.open_output_stream(f"{self.path}/.{n}.{self.mark}") for n in self.names]
        self.files = [pa.ipc.new_file(s, schema) for s, schema in zip(self.streams, (self.schema, _DOCS))]
        self.held, self.n_held, self.total, self.docs = [], 0, 0, 0

    def add(self, doc_ids, flat, counts):
        starts = self.total + np.cumsum(counts) - counts
        self.files[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)], schema=_DOCS))
        self.total += len(flat)
        self.docs += len(doc_ids)
        self.held.append(flat.astype(self.kind))
        self.n_held += len(flat)
        if self.n_held >= self.length * BATCH:
            self._sequences(self.n_held // (self.length * BATCH) * BATCH)

    def _sequences(self, count):
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        out, rest = ids[: count * self.length], ids[count * self.length :]
        mask = np.arange(count * self.length) < len(out)
        out = np.pad(out, (0, count * self.length - len(out)))
        for at in range(0, count, BATCH):
            part = slice(at * self.length, min(at + BATCH, count) * self.length)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (out, mask)]
            self.files[0].write_batch(pa.record_batch(lists, schema=self.schema))
        self.held, self.n_held = [rest], len(rest)

    def close(self):
        self._sequences(-(-self.n_held // self.length))
        for file, stream, name in zip(self.files, self.streams, self.names):
            file.close()
            stream.close()
            self.fs.move(f"{self.path}/.{name}.{self.mark}", f"{self.path}/{name}")
        return [self.bucket, *self.names, self.total, self.docs]


def _write(folder, tokenizer_path, end_id, length):
    def write(batches):
        encoder = word_ids(tokenizer_path)
        kind = np.uint16 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        names = ["bucket", "tokens_file", "docs_file", "n_tokens", "n_docs"]
        manifest = lambda row: pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *[pa.array([x]) for x in row[1:]]], names)
        writer = None
        for b in batches:
            buckets, ids, texts = (b[c].to_pylist() for c in ("bucket", "doc_id", "text"))
            cuts = [0, *[i for i in range(1, len(buckets)) if buckets[i] != buckets[i - 1]], len(buckets)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if writer is None or writer.bucket != buckets[begin]:
                    if writer:
                        yield manifest(writer.close())
                    writer = _Writer(folder, buckets[begin], length, kind)
                for part in batch_rows(texts[begin:end]):
                    flat, counts = encoder.encode(texts[begin:end][part])
                    flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
                    writer.add(ids[begin:end][part], flat, counts + 1)
        if writer:
            yield manifest(writer.close())
        encoder.keep_first()

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2, length: int = SEQUENCE) -> tuple[str, DataFrame]:
    """Write all documents in ascending doc_id order; returns the folder and the manifest, one row per pair of files.

    A null or empty text is the end id alone; a null doc_id comes first; equal ids follow by text. An empty table writes no
    file. The last sequence of a file is filled up with id 0 and a false mask; a length is a multiple of 8. Other columns are not read.
    """
    if length % 8:
        raise ValueError("length must be a multiple of 8")
    spark = ready(docs.sparkSession)
    folder = folder or scratch_path(spark, "tokens")
    rows = in_id_order(docs.select("doc_id", text_or_empty().alias("text")))
    manifest = rows.select("bucket", "doc_id", "text").mapInArrow(_write(folder, tokenizer_path, end_id, length), _MANIFEST)
    return folder, saved(manifest, "manifest")


class TokenFile:
    """Random access to the ids of one tokens file; local files are mapped, and slices are views of the mapping."""

    def __init__(self, folder: str, name: str):
        fs, path = file_system(folder)
        local = fs.type_name == "local"
        self.reader = pa.ipc.open_file(pa.memory_map(f"{path}/{name}") if local else fs.open_input_file(f"{path}/{name}"))
        self.length = self.reader.schema.field("ids").type.list_size
        self.batch, self.number = None, -1

    def _values(self, number, column):
        if self.number != number:
            self.batch, self.number = self.reader.get_batch(number), number
        return self.batch.column(column).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i, both views; the mask is packed, eight places a byte from the lowest bit on
        (`np.unpackbits(mask, count=length, bitorder="little")`)."""
        part = slice(i % BATCH * self.length, (i % BATCH + 1) * self.length)
        bits = self._values(i // BATCH, "mask")
        packed = np.frombuffer(bits.buffers()[1], np.uint8)
        begin = bits.offset + part.start
        return self._values(i // BATCH, "ids").to_numpy()[part], packed[begin // 8 : (begin + self.length + 7) // 8]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from place `start` of the file on."""
        out, per = [], BATCH * self.length
        while n:
            part = self._values(start // per, "ids").to_numpy()[start % per : start % per + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)


def _read(folder):
    def read(batches):
        for b in batches:
            for tokens_file, docs_file, base in zip(*(b[c].to_pylist() for c in ("tokens_file", "docs_file", "base"))):
                file = TokenFile(folder, tokens_file)
                fs, path = file_system(folder)
                with fs.open_input_file(f"{path}/{docs_file}") as f, pa.ipc.open_file(f) as docs:
                    for i in range(docs.num_record_batches):
                        d = docs.get_batch(i)
                        start, n = d["start"].to_numpy(), d["n_tokens"].to_numpy()
                        crc = [zlib.crc32(file.tokens(int(s), int(k)).astype("<u4").tobytes()) for s, k in zip(start, n)]
                        yield pa.RecordBatch.from_arrays([d["doc_id"], pa.array(start + base), d["n_tokens"], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_digests(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start in the whole order, n_tokens and CRC-32 of every document, all from the files.

    The driver sums the token counts of the files, of which there are no more than `ordered.MAX_BUCKETS`.
    """
    spark = manifest.sparkSession
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["bucket"]):
        rows.append((r["tokens_file"], r["docs_file"], base))
        base += r["n_tokens"]
    files = spark.createDataFrame(rows, "tokens_file string, docs_file string, base long")
    return files.repartition(max(1, len(rows))).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
