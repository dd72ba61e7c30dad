"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tallybook.llm.common import ready, text_or_empty

#: Longer texts are cut at safe boundaries into parts of about so many characters.
PART_CHARS = 50_000
#: Longer runs of white space are taken out of the text: the regex engine recurses over a run and ends the process on a very long one.
BLANK_RUN = 10_000
# The characters that the pattern's \s matches (Unicode White_Space).
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % BLANK_RUN)


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _numerals(rank_file: str, pattern: str) -> list[str]:
    return [str(i) for i in range(encoding(rank_file, pattern).n_vocab)]


def safe_parts(text: str, chars: int = PART_CHARS):
    """Parts that end after a character that is no white space and before a blank or newline: no match of the pattern
    reaches over such a place, so the parts' ids in a row are the text's ids. A text without such a place stays whole."""
    at = 0
    while len(text) - at > chars:
        cut = at + chars
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def encode(enc, text: str) -> list[int]:
    """Ids of a text. Of a run of white space before other text all but the last character are one match of the pattern, at the
    end of a text all; such a match of a very long run is encoded without the pattern."""
    if len(text) <= min(PART_CHARS, BLANK_RUN):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in _BLANKS.finditer(text):
        begin, end = run.start(), run.end() if run.end() == len(text) else run.end() - 1
        out += [i for part in safe_parts(text[at:begin]) for i in enc.encode_ordinary(part)]
        out += enc._encode_single_piece(text[begin:end].encode())
        at = end
    return out + [i for part in safe_parts(text[at:]) for i in enc.encode_ordinary(part)]


def _ids(rank_file, pattern):
    def ids(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([encode(enc, t) for t in b["text"].to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids of every row; null and empty texts have no ids. Repeated rows repeat; other columns are not read."""
    ready(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_ids(rank_file, pattern), "doc_id long, ids array<int>")


def _texts(rank_file, pattern):
    def texts(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([enc.decode_bytes(i or []) for i in b["ids"].to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return texts


def decode_documents(ids: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of every row's ids; null ids decode to no bytes."""
    ready(ids.sparkSession)
    return ids.select("doc_id", "ids").mapInArrow(_texts(rank_file, pattern), "doc_id long, bytes binary")


def _digests(rank_file, pattern):
    def digests(batches):
        enc, numerals = encoding(rank_file, pattern), _numerals(rank_file, pattern)
        for b in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for t in b["text"].to_pylist():
                ids = encode(enc, t)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([numerals[i] for i in ids]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes.

    The same rows as decode_documents(encode_documents(...)) give, without a table of ids between them.
    """
    ready(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_digests(rank_file, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
