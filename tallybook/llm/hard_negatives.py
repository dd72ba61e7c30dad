"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best partners of the same label. Each positive asks for the best partners of other labels in a
window of scores that ends at the positive's own score, so the windows of one anchor overlap. The positives' scores are the
upper limits that cut the scores into disjoint slots: a partner belongs to the slot of the smallest limit that is not below
its score. Every task keeps the k best of each anchor and slot only (a combiner), the combined slots of an anchor hold a few
rows, and each window is answered by the slots from its own down to the last, best first, cut at its lower end.

Rows and anchors meet in cells: a block of anchors, held as one matrix, and a stripe of rows, which is streamed past it.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import ready, saved

#: Anchors of one block, least rows of a stripe (it grows with the square root of the table), scores worked on at a time, and candidates held before they are cut.
BLOCK_ANCHORS, STRIPE_ROWS, SCORES, HELD = 16384, 4096, 1 << 22, 500_000
_MOST = (1 << 63) - 1
_FOUND = "anchor long, slot int, vec_id long, score long"


def _at_least(score, limit, num, den):
    """den * score >= num * limit without overflow."""
    if len(score) and max(int(np.abs(score).max()), int(np.abs(limit).max())) >= 1 << 56:
        score, limit = score.astype(object), limit.astype(object)
    return (den * score >= num * limit).astype(bool)


class Slots:
    """The k best rows of each anchor and slot.

    `limits` has the upper ends of the slots in descending order, padded with the least integer. `same` takes rows of the
    anchor's label (the anchor itself left out), otherwise rows of other labels. A row of a slot with limit x needs a score of
    x * num / den at least.
    """

    def __init__(self, uids, labels, vectors, limits, k, same, num, den):
        self.uids, self.labels, self.vectors, self.limits = uids, labels, vectors, limits
        self.k, self.same, self.num, self.den = k, same, num, den
        self.size = vectors.shape[1] * float(np.abs(vectors).max(initial=0))
        self.floor = np.full(limits.shape, -_MOST - 1)
        self.held, self.n_held = [], 0

    def _scores(self, vectors):
        if self.size * float(np.abs(vectors).max(initial=0)) < 2**53:
            return self.vectors @ vectors.T
        whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
        return np.clip(whole(self.vectors).dot(whole(vectors).T), -_MOST, _MOST).astype(np.int64)

    def add(self, uids, ids, labels, vectors):
        step = max(1, SCORES // max(1, len(self.uids)))
        for at in range(0, len(uids), step):
            part = slice(at, at + step)
            scores = self._scores(vectors[part])
            take = (self.labels[:, None] == labels[part]) == self.same
            if self.same:
                take &= self.uids[:, None] != uids[part]
            take &= (scores <= self.limits[:, :1]) & (scores >= self.floor.min(axis=1)[:, None])
            anchor, row = np.nonzero(take)
            score = scores[anchor, row].astype(np.int64)
            slot = (self.limits[anchor] >= score[:, None]).sum(axis=1) - 1
            keep = score >= self.floor[anchor, slot]
            if self.num is not None:
                keep &= _at_least(score, self.limits[anchor, slot], self.num, self.den)
            self.held.append((anchor[keep], slot[keep], score[keep], ids[part][row[keep]]))
            self.n_held += int(keep.sum())
            if self.n_held > HELD:
                self.cut()

    def cut(self):
        anchor, slot, score, ids = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -score, slot, anchor))
        anchor, slot, score, ids = anchor[order], slot[order], score[order], ids[order]
        group = anchor * self.limits.shape[1] + slot
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[: len(group)]
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        full = rank == self.k - 1
        self.floor[anchor[full], slot[full]] = score[full]
        keep = rank < self.k
        self.held, self.n_held = [(anchor[keep], slot[keep], score[keep], ids[keep])], int(keep.sum())

    def found(self):
        if not self.held:
            return
        self.cut()
        anchor, slot, score, ids = self.held[0]
        yield pa.RecordBatch.from_arrays([pa.array(self.uids[anchor]), pa.array(slot, pa.int32()), pa.array(ids), pa.array(score)], ["anchor", "slot", "vec_id", "score"])


def _matrix(vectors, dims):
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def _search(k, same, num, den):
    def search(batches):
        """Rows come sorted by cell, anchors before the rows of their cell."""
        cell, slots, waiting = None, None, []
        for b in batches:
            cells = np.stack([b[c].to_numpy() for c in ("dims", "block", "stripe")], axis=1)
            kinds = b["is_row"].to_numpy(zero_copy_only=False)
            marks = np.c_[cells, kinds]
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                here, part = tuple(cells[begin].tolist()), b.slice(begin, end - begin)
                if here != cell:
                    if slots:
                        yield from slots.found()
                    cell, slots, waiting = here, None, []
                if not kinds[begin]:
                    waiting.append(part)
                    continue
                if slots is None and waiting:
                    limits = [x for w in waiting for x in w["limits"].to_pylist()]
                    width = max(map(len, limits))
                    limits = np.array([x + [-_MOST - 1] * (width - len(x)) for x in limits], np.int64)
                    uids, labels = (np.concatenate([w[c].to_numpy() for w in waiting]) for c in ("uid", "label"))
                    slots = Slots(uids, labels, np.concatenate([_matrix(w["v"], here[0]) for w in waiting]), limits, k, same, num, den)
                    waiting = []
                if slots:
                    slots.add(part["uid"].to_numpy(), part["vec_id"].to_numpy(), part["label"].to_numpy(), _matrix(part["v"], here[0]))
        if slots:
            yield from slots.found()

    return search


def _best(rows, anchors, k, same, num=None, den=None):
    """The k best rows of each anchor and slot: anchor (uid), slot, rank, vec_id, score. `anchors` has limits besides the columns of rows."""
    n, n_anchors = rows.count(), anchors.count()
    blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    stripes = max(1, -(-n // max(STRIPE_ROWS, 64 * isqrt(n))))
    dealt = lambda seed, m: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    columns = ["dims", "block", "stripe", "is_row", "uid", "vec_id", "label", "v", "limits"]
    held = anchors.withColumns({"block": dealt(1, blocks), "is_row": F.lit(False)}).withColumn("stripe", every(stripes))
    past = rows.withColumns({"stripe": dealt(2, stripes), "is_row": F.lit(True), "limits": F.lit(None).cast("array<long>")}).withColumn("block", every(blocks))
    cells = held.select(columns).union(past.select(columns)).repartition("dims", "block", "stripe").sortWithinPartitions("dims", "block", "stripe", "is_row")
    found = cells.mapInArrow(_search(k, same, num, den), _FOUND)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _vectors(table: DataFrame, scale: float, label: Column) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def whole(e):
        e = F.least(F.greatest(e * F.lit(float(scale)), F.lit(-1e308)), F.lit(1e308))
        return F.when(F.abs(e) < 2.0**52, F.floor(e).cast("double")).otherwise(e)

    rows = table.where("label is not null and embedding is not null").where(finite)
    return rows.select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("vec_id").cast("long"), F.lit(_MOST)).alias("vec_id"),
        label.cast("long").alias("label"), F.size("embedding").alias("dims"), F.transform(x, whole).alias("v"))


def mine_hard_negatives(vectors: DataFrame, anchors: str, n_positives: int = 5, k: int = 5, num: int = 4, den: int = 5, scale: float = 256.0, label: Column | None = None) -> DataFrame:
    """For each anchor and each of its positives the k best rows of other labels scoring from num/den of the positive's score up to it.

    `vectors` has vec_id, label and embedding; `anchors` is a condition on vec_id; `label` may stand for another label than
    the column's. Components become floor(scale * x); a score is the integer inner product with the anchor. An anchor's
    positives are its `n_positives` best other rows of its label. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score; a positive whose window is empty has no row.

    Rows with a null label or vector or a null or non-finite component take no part. Vectors meet only those of the same
    length; empty ones score 0. Ties go to the smaller vec_id, null last. Repeated rows are rows of their own, also as
    anchors and positives. Scores beyond a long are cut to its range. Other columns are not read.
    """
    ready(vectors.sparkSession)
    rows = saved(_vectors(vectors, scale, F.col("label") if label is None else label), "vectors")
    asked = rows.where(anchors).where(F.col("vec_id") < _MOST)
    positives = saved(_best(rows, asked.withColumn("limits", F.array(F.lit(_MOST))), n_positives, True), "positives")
    limits = positives.groupBy(F.col("anchor").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"))
    asked = saved(asked.join(limits.select("uid", F.col("s.score").alias("limits")), "uid"), "limited")
    negatives = _best(rows, asked, k, False, num, den)
    # At most n_positives x k rows an anchor: from here on the slots of an anchor are one sorted array.
    slots = negatives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "vec_id", "score"))).alias("slots"))
    windows = positives.select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    answers = windows.join(slots, "anchor").join(asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    wide = lambda c: c.cast("decimal(20,0)")
    suffix = F.slice(F.filter("slots", lambda x: x["slot"] >= F.col("window")), 1, k)
    inside = F.filter(suffix, lambda x: wide(x["score"]) * den >= wide(F.col("positive_score")) * num)
    out = answers.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("place", "x"))
    id_of = lambda c: F.when(c < _MOST, c)
    return out.select(
        "anchor_id", id_of(F.col("positive_id")).alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"),
        id_of(F.col("x.vec_id")).alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))
