"""Exact top-k inner products by KD-trees over shards.

A shard's tree splits at medians and keeps the tight bounding box of every node. A query visits nodes best-first by the
largest inner product that its box allows and stops when that falls below the k-th score it already has. The k-th score
found in one shard is passed on to the search of all other shards.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import ready, saved

#: Vectors of one shard, of one leaf, and queries of one block.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 4096, 256, 512
_NO_ID = (1 << 63) - 1


def _floor(e):
    """Floor as double, for values beyond a long too (those are whole already)."""
    return F.when(F.abs(e) < 2.0**52, F.floor(e).cast("double")).otherwise(e)


class Tree:
    """Integer vectors in leaves of neighbours; boxes, children and ranges by node."""

    def __init__(self, uids, ids, vectors):
        self.low, self.high, self.kids, self.range, self.least_id = [], [], [], [], []
        self.order = np.arange(len(ids))
        self.vectors, self.ids, self.uids = vectors, ids, uids
        self._grow(0, len(ids))
        self.vectors, self.ids, self.uids = vectors[self.order], ids[self.order], uids[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.exact = len(vectors[0]) * float(np.abs(vectors).max(initial=0)) if len(ids) else 0.0

    def _grow(self, start, end):
        at = len(self.kids)
        own = self.order[start:end]
        part = self.vectors[own]
        self.low.append(part.min(axis=0))
        self.high.append(part.max(axis=0))
        self.range.append((start, end))
        self.least_id.append(int(self.ids[own].min()))
        self.kids.append(())
        widest = int(np.argmax(self.high[at] - self.low[at]))
        if end - start > LEAF_ROWS and self.high[at][widest] > self.low[at][widest]:
            middle = (end - start) // 2
            self.order[start:end] = own[np.argpartition(part[:, widest], middle)]
            self.kids[at] = (self._grow(start, start + middle), self._grow(start + middle, end))
        return at

    def search(self, queries, query_uids, k, floors):
        """For each query the best (score, id) pairs of this shard that may be among its k best; `floors`: k-th scores so far."""
        small = self.exact * float(np.abs(queries).max(initial=0)) < 2**52
        kind = np.float64 if small else object
        to = lambda x: x if small else np.array([[int(v) for v in row] for row in x], object)
        q, vectors, low, high = to(queries), to(self.vectors), to(self.low), to(self.high)
        bounds = np.maximum(q, 0).dot(high.T) + np.minimum(q, 0).dot(low.T)
        for row, own_uid, floor, bound in zip(q, query_uids, floors, bounds):
            scores, ids, worst = np.empty(0, kind), np.empty(0, np.int64), _NO_ID
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < floor:
                    break
                if -top == floor and len(ids) >= k and self.least_id[node] > worst:
                    continue
                if self.kids[node]:
                    for kid in self.kids[node]:
                        heapq.heappush(heap, (-bound[kid], kid))
                    continue
                start, end = self.range[node]
                got = vectors[start:end].dot(row)
                keep = (got >= floor) & (self.uids[start:end] != own_uid)
                if not keep.any():
                    continue
                scores, ids = np.r_[scores, got[keep]], np.r_[ids, self.ids[start:end][keep]]
                best = np.lexsort((ids, -scores))[:k] if small else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k])
                scores, ids = scores[best], ids[best]
                if len(ids) == k:
                    floor, worst = max(floor, scores[-1]), int(ids[-1]) if scores[-1] >= floor else worst
            yield scores, ids


def _trees(rows):
    rows = rows.sort_values("uid")
    tree = Tree(rows["uid"].to_numpy(), rows["vec_id"].to_numpy(), np.array(rows["v"].tolist(), np.float64))
    return pd.DataFrame({"dims": [int(rows["dims"].iloc[0])], "shard": [int(rows["shard"].iloc[0])], "tree": [pickle.dumps(tree)]})


def _blocks(rows):
    rows = rows.sort_values("uid")
    queries = (rows["uid"].to_numpy(), np.array(rows["v"].tolist(), np.float64), rows["floor"].to_numpy(float))
    return pd.DataFrame({"dims": [int(rows["dims"].iloc[0])], "home": [int(rows["home"].iloc[0])], "queries": [pickle.dumps(queries)]})


def _search(k):
    def search(batches):
        for b in batches:
            for tree, queries in zip(b["tree"], b["queries"]):
                uids, vectors, floors = pickle.loads(queries)
                out = [[], [], []]
                for uid, (scores, ids) in zip(uids, pickle.loads(tree).search(vectors, uids, k, floors)):
                    out[0] += [uid] * len(ids)
                    out[1] += ids.tolist()
                    out[2] += [int(max(min(s, _NO_ID), -_NO_ID)) for s in scores]
                yield pd.DataFrame(dict(zip(("q_uid", "vec_id", "score"), out)), dtype="int64")

    return search


def exact_top_k(vectors: DataFrame, queries: str, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k best partners of every query by integer inner product: query_id, rank, vec_id, score.

    `vectors` has vec_id and embedding; `queries` is a condition on vec_id. Components become floor(scale * x). Ties go to
    the smaller vec_id (null last). A vector that is null, empty or holds a null or non-finite component takes no part.
    Vectors meet only those of the same length. Repeated rows are rows of their own: a query skips only its own row. Scores
    beyond a long are cut to its range. Fewer partners than k give fewer rows. Other columns are not read.
    """
    ready(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where("embedding is not null and size(embedding) > 0").where(finite)
    rows = rows.select("vec_id", F.transform(x, lambda e: _floor(e * F.lit(float(scale)))).alias("v"))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("uid"), F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), F.size("v").alias("dims"), "v"), "vectors")
    n = rows.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-rows.where(queries).count() // BLOCK_ROWS))
    trees = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).groupBy("dims", "shard").applyInPandas(_trees, "dims int, shard int, tree binary")
    trees = saved(trees, "trees")
    asked = rows.where(queries).where(F.col("vec_id") < _NO_ID).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    homes = trees.groupBy("dims").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    asked = asked.join(homes, "dims").withColumn("home", F.element_at("shards", (F.col("block") % F.size("shards") + 1).cast("int")))
    asked = saved(asked.drop("shards"), "queries")

    def packed(q):
        return q.groupBy("dims", "block").applyInPandas(_blocks, "dims int, home int, queries binary")

    first = packed(asked.withColumn("floor", F.lit(float("-inf")))).withColumnRenamed("home", "shard")
    first = saved(first.join(trees, ["dims", "shard"]).select("tree", "queries").mapInPandas(_search(k), "q_uid long, vec_id long, score long"), "first")
    floors = first.groupBy("q_uid").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n"))
    carried = asked.join(floors, asked.uid == floors.q_uid, "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))))
    others = packed(carried.select(*asked.columns, "floor")).join(homes, "dims").withColumn("shard", F.explode("shards")).where("shard <> home")
    rest = others.select("dims", "shard", "queries").join(trees, ["dims", "shard"]).select("tree", "queries").mapInPandas(_search(k), "q_uid long, vec_id long, score long")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    names = asked.select(F.col("uid").alias("q_uid"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "q_uid").select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") < _NO_ID, F.col("vec_id")).alias("vec_id"), "score")
