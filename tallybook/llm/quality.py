"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network and calibrated probabilities.

Word vectors: every token bucket has a sparse random index vector; its context vector sums those of its neighbours over
all documents, labelled or not. A document is the mean vector of its words and that of the shapes of its tokens. A network with one
hidden layer scores it, and a temperature fitted on rows kept from training calibrates the probability.
"""

from __future__ import annotations

import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import only, ready, saved
from tallybook.llm.word_ids import batch_rows

#: Labelled rows that training reads at most (those with the smallest hash of doc_id).
TRAINING_ROWS = 6000
WORDS, SHAPES, SIZE, HIDDEN, REACH = 8192, 256, 64, 32, 2
EPOCHS, RATE, DECAY = 400, 0.01, 1e-3
#: Tokens whose pairs of neighbours are counted at a time.
_PAIRED = 100_000
#: Characters whose tokens a task holds at a time (one text at least).
SLICE_CHARS = 1_000_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _shape(t: str) -> str:
    if t.isalpha():
        return "a" if t.islower() else "A" if t.isupper() and len(t) > 1 else "Aa" if t.istitle() else "aA"
    return f"0{min(len(t), 9)}" if t.isdigit() else t[:3]


def token_buckets(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and shape buckets of all tokens, and the number of tokens of each text."""
    tokens = [_TOKEN.findall(t) if t else [] for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), sizes
    codes, unique = pd.factorize(np.fromiter(chain.from_iterable(tokens), dtype=object, count=int(sizes.sum())))
    words = np.fromiter((zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) % WORDS for t in unique), np.int64, len(unique))
    shapes = np.fromiter((WORDS + zlib.crc32(_shape(t).encode("utf-8", "surrogatepass")) % SHAPES for t in unique), np.int64, len(unique))
    return words[codes], shapes[codes], sizes


@cache
def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors, the same on every machine."""
    rng = np.random.default_rng(11)
    out = np.zeros((WORDS + SHAPES, SIZE), np.float32)
    for row in out:
        row[rng.choice(SIZE, 6, replace=False)] = rng.choice([-1, 1], 6)
    return out


@cache
def _places() -> np.ndarray:
    """For every bucket the columns of its index vector that are not 0, those of -1 moved by SIZE."""
    rows, columns = np.nonzero(index_vectors())
    return (columns + SIZE * (index_vectors()[rows, columns] < 0)).reshape(WORDS + SHAPES, -1)


def context_sums(texts) -> np.ndarray:
    """Sums of the index vectors of all neighbours of every bucket, from counts of bucket and column."""
    found = np.zeros((WORDS + SHAPES) * 2 * SIZE, np.int64)
    *streams, sizes = token_buckets(texts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    for stream in streams:
        for d in range(1, REACH + 1):
            for at in range(0, len(stream) - d, _PAIRED):
                b = stream[at + d : at + d + _PAIRED]
                a = stream[at : at + len(b)]
                same = text[at : at + len(b)] == text[at + d : at + d + len(b)]
                a, b = a[same], b[same]
                for bucket, other in ((a, b), (b, a)):
                    found += np.bincount((bucket[:, None] * (2 * SIZE) + _places()[other]).ravel(), minlength=len(found))
    found = found.reshape(-1, 2, SIZE)
    return (found[:, 0] - found[:, 1]).astype(float)


def _context_rows(batches):
    """The sums of one task's texts: a row for each bucket that has neighbours."""
    sums = np.zeros((WORDS + SHAPES, SIZE))
    for b in batches:
        texts = b["text"].tolist()
        for part in batch_rows(texts, SLICE_CHARS):
            sums += context_sums(texts[part])
    yield from _rows(sums)


def _merged_rows(batches):
    sums = np.zeros((WORDS + SHAPES, SIZE))
    for b in batches:
        np.add.at(sums, b["bucket"].to_numpy(), np.frombuffer(b"".join(b["sums"]), float).reshape(-1, SIZE))
    yield from _rows(sums)


def _rows(sums):
    buckets = np.flatnonzero(sums.any(axis=1))
    yield pd.DataFrame({"bucket": buckets.astype(np.int32), "sums": [sums[k].tobytes() for k in buckets]})


def corpus_sums(docs: DataFrame) -> np.ndarray:
    """Context sums over the texts of all documents.

    Every task gives at most one row per bucket, which meet by bucket; the driver gets one row per bucket, 4 MB in all.
    The sums are whole numbers, so that they are the same in any order. Null and empty texts add nothing.
    """
    rows = "bucket int, sums binary"
    parts = docs.where("text <> ''").select("text").mapInPandas(_context_rows, rows)
    sums = np.zeros((WORDS + SHAPES, SIZE))
    for r in parts.repartition("bucket").mapInPandas(_merged_rows, rows).toLocalIterator():
        sums[r["bucket"]] += np.frombuffer(r["sums"], float)
    return sums


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors; a bucket without neighbours keeps its index vector."""
    index = index_vectors()
    norm = lambda x: x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    return norm(norm(sums) + norm(index)).astype(np.float32)


def pooled(texts, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean shape vector of each text; zeros for a text without tokens."""
    words, shapes, sizes = token_buckets(texts)
    out, at = np.zeros((len(sizes), 2 * SIZE), np.float32), 0
    for i, n in enumerate(sizes):
        if n:
            out[i, :SIZE] = vectors[words[at : at + n]].mean(axis=0)
            out[i, SIZE:] = vectors[shapes[at : at + n]].mean(axis=0)
            at += n
    return out


class Model:
    """Word vectors, network weights and temperature."""

    def __init__(self, vectors, mean, scale, weights, temperature):
        self.vectors, self.mean, self.scale, self.weights, self.temperature = vectors, mean, scale, weights, temperature

    def logits(self, features):
        w1, b1, w2, b2 = self.weights
        return np.tanh((features - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(texts, self.vectors)).astype(float) / self.temperature, -40, 40)))


def train(features: np.ndarray, labels: np.ndarray, keep: np.ndarray, vectors: np.ndarray) -> Model:
    """Fit the network on rows outside `keep` and the temperature on rows in it. Without both classes: the smoothed share."""
    fit = ~keep if (~keep).any() else keep
    mean, scale = features[fit].mean(axis=0) if fit.any() else 0.0, (features[fit].std(axis=0) + 1e-3) if fit.any() else 1.0
    rng = np.random.default_rng(5)
    weights = [rng.normal(0, 1 / np.sqrt(2 * SIZE), (2 * SIZE, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    if len(set(labels[fit].tolist())) < 2:
        share = (labels[fit].sum() + 1) / (fit.sum() + 2)
        return Model(vectors, mean, scale, [weights[0] * 0, weights[1], weights[2] * 0, np.log(share / (1 - share))], 1.0)
    x, y = (features[fit] - mean) / scale, labels[fit].astype(float)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(x @ weights[0] + weights[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -40, 40))) - y) / len(y)
        back = error[:, None] * weights[2] * (1 - hidden**2)
        slopes = [x.T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ error + DECAY * weights[2], error.sum()]
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, weights, 1.0)
    if keep.any():
        z, t = model.logits(features[keep]), labels[keep]
        loss = lambda c: np.logaddexp(0, np.where(t == 1, -z, z) / c).mean()
        model.temperature = float(min(np.geomspace(0.3, 8, 60), key=loss))
    return model


def held_out(c: str = "doc_id") -> Column:
    """Rows that training never reads: crc32 of the id as text leaves 1 when divided by 3 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> Model:
    """Train on at most `max_rows` labelled documents that are not held out; word vectors come from all documents.

    Rows with a null id or a label other than 0 and 1 are ignored; several labels of an id count by their mean (from 0.5: 1).
    The driver gets sums of fixed size and `max_rows` pooled vectors.
    """
    spark = ready(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labelled")
    texts = only(docs.select("doc_id", "text"), chosen.select("doc_id"), "doc_id").dropDuplicates(["doc_id"])
    sample = saved(texts.join(chosen, "doc_id").repartition(8), "sample")
    vectors = word_vectors(corpus_sums(docs))
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "v": list(pooled(b["text"], shared.value))})

    rows = sample.mapInPandas(features, "doc_id long, quality int, v array<float>").orderBy("doc_id").collect()
    x = np.array([r["v"] for r in rows], np.float32).reshape(-1, 2 * SIZE)
    y = np.array([r["quality"] for r in rows], int)
    keep = np.array([zlib.crc32(b"keep" + str(r["doc_id"]).encode()) % 5 == 0 for r in rows], bool)
    return train(x, y, keep, vectors)


def quality_score(model: Model, docs: DataFrame, c: str = "text") -> Column:
    """Probability of label 1 for every text; null and empty texts score as a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        out = [shared.value.scores(values[part]) for part in batch_rows(values, SLICE_CHARS)]
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return score(F.coalesce(F.col(c), F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of every row; repeated rows score alike."""
    model = fit_quality(docs, labels, max_rows)
    out = docs.select("doc_id", held_out().alias("held_out"), quality_score(model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """The documents that the classifier predicts as label 1, all columns kept."""
    model = fit_quality(docs, labels, max_rows)
    name = "quality_score__"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, quality_score(model, docs)).where(F.col(name) >= 0.5).drop(name)
