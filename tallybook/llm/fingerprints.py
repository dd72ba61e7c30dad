"""Quartile bucket digests of documents and their bounded difference score."""

from __future__ import annotations

import hashlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallybook.llm.common import ready, text_or_empty
from tallybook.llm.ordered import in_id_order

BUCKETS = 256
#: Pairs of places that, with place 0, make the triplets of a window of five bytes.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Code distance 0 to 3 counts so much; opposite quartiles count double.
STEP = np.array([0, 1, 2, 6])
#: What two unrelated digests reach on average (every quartile pair equally likely); larger differences count as this.
MOST = 416
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def digest(text: str) -> str:
    """Hex: length code, two quartile ratios, then two bits for each of 256 buckets of hashed byte triplets.

    A text under five bytes is filled with zero bytes; an empty text has no triplets and its own length code.
    """
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    counts = np.zeros(BUCKETS, np.int64)
    if n:
        b = np.frombuffer(data.ljust(5, b"\0"), np.uint8).astype(np.uint32)
        a, c, d = b * _FACTORS[0], b * _FACTORS[1], b * _FACTORS[2]
        w = len(b) - 4
        for k, (i, j) in enumerate(TRIPLETS):
            h = a[:w] + c[i : i + w]
            h ^= d[j : j + w] + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
            h *= _FACTORS[0]
            h >>= np.uint32(24)
            counts += np.bincount(h, minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    size = min(255, round(log(n + 1) / log(1.1))) if n else 0
    ratio = lambda q: int(q * 15 // q3) if q3 else 0
    return f"{size:02x}{ratio(q1):x}{ratio(q2):x}{packed.astype(np.uint8).tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """Sum of code steps over the buckets plus header steps, at most MOST."""
    x, y = (np.frombuffer(bytes.fromhex(d[4:]), np.uint8) for d in (a, b))
    total = sum(int(STEP[np.abs(((x >> s) & 3).astype(int) - ((y >> s) & 3))].sum()) for s in (0, 2, 4, 6))
    total += abs(int(a[:2], 16) - int(b[:2], 16)) + abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16))
    return min(MOST, total)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for those as different as unrelated texts."""
    return 1 - difference(a, b) / MOST


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the text that follows."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches):
    """Rows sorted by bucket; the row before waits for the one that follows it."""
    waiting = None
    for batch in batches:
        rows = []
        for bucket, ahead, doc_id, text in zip(*(batch[c].to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))):
            own = digest(text)
            if waiting and waiting[0] == bucket:
                _, w_id, w_text, w_print = waiting
                changed = edited(w_text, text)
                changed_print = digest(changed)
                rows.append((w_id, len(w_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), w_print, changed_print, likeness(w_print, changed_print), likeness(w_print, own)))
            waiting = None if ahead else (bucket, doc_id, text, own)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], _NAMES)


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text (see `edited`) and their likeness, with the next lower doc_id as next.

    After the lowest id comes the highest. Null and empty texts are empty texts of zero characters; a null doc_id is the
    lowest; rows with equal ids follow each other by text; a lone document is its own next. Other columns are not read.
    """
    ready(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    dealt = in_id_order(rows, descending=True, next_row=True)
    return dealt.select("bucket", "ahead", "doc_id", "text").mapInArrow(_compare, _SCHEMA)
