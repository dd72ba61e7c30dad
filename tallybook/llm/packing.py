"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Pieces are dealt by a row number into blocks of a bounded size, so a block is one unit of work at any input size. On each
block several islands evolve packings; a crossover injects whole well-filled bins of one parent into the other, drops the
bins that hold a piece twice and puts the displaced pieces back by best fit. Elites move to the neighbour island by a join,
a second epoch follows, and the best island's packing counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import ready, saved, text_or_empty
from tallybook.llm.word_ids import batch_rows, word_ids

#: Pieces of one block, islands on each, packings on an island, crossovers in an epoch.
BLOCK_PIECES, ISLANDS, POPULATION, CROSSOVERS = 4000, 2, 6, 12
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path, end_id, capacity):
    def pieces(batches):
        encoder = word_ids(path)
        for b in batches:
            texts, ids = b["text"].to_pylist(), b["doc_id"].to_pylist()
            for part in batch_rows(texts):
                flat, counts = encoder.encode(texts[part])
                rows, at = [], 0
                for doc_id, n in zip(ids[part], counts):
                    own = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        rows.append((doc_id, k, start, len(piece), zlib.crc32(piece.tobytes())))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.keep_first()

    return pieces


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document: its ids and an end id, cut only where longer.

    A null or empty text is the end id alone. Repeated rows give repeated pieces; other columns are not read.
    """
    ready(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_pieces(tokenizer_path, end_id, capacity), _PIECES)


class Packing:
    """Bins of piece numbers, each at most `capacity` long in all."""

    def __init__(self, lengths, capacity):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[tuple[int, int]] = []  # (free, bin), sorted

    def add_bin(self, items):
        free = self.capacity - sum(self.lengths[i] for i in items)
        insort(self.room, (free, len(self.bins)))
        self.bins.append(list(items))

    def best_fit(self, items):
        for i in items:
            n = self.lengths[i]
            at = bisect_left(self.room, (n, -1))
            if at < len(self.room):
                free, b = self.room.pop(at)
                self.bins[b].append(i)
                insort(self.room, (free - n, b))
            else:
                self.add_bin([i])
        return self

    def fitness(self):
        """Fewer bins first; among equals, bins that are full or nearly empty."""
        return -len(self.bins), sum((self.capacity - free) ** 2 for free, _ in self.room)

    def by_fill(self):
        return [self.bins[b] for _, b in self.room]


def crossover(a: Packing, b: Packing, rng) -> Packing:
    """Whole well-filled bins of b in a; bins of a that hold one of their pieces go, and what else they held is best-fitted."""
    filled = b.by_fill()
    pool = filled[: max(1, len(filled) // 2)]
    chosen = [pool[k] for k in sorted(rng.choice(len(pool), size=max(1, len(pool) // 3), replace=False))]
    inside = {i for items in chosen for i in items}
    child, displaced = Packing(a.lengths, a.capacity), []
    for items in chosen:
        child.add_bin(items)
    for items in a.bins:
        if inside.isdisjoint(items):
            child.add_bin(items)
        else:
            displaced += [i for i in items if i not in inside]
    return child.best_fit(sorted(displaced, key=a.lengths.__getitem__, reverse=True))


def evolve(lengths: list[int], capacity: int, seed: int, elites=()) -> Packing:
    """One epoch on an island: best-fit starts in noisy descending order, elites from elsewhere, then crossovers."""
    rng = np.random.default_rng(seed)
    goal = -(-sum(lengths) // capacity)
    sizes = np.array(lengths)
    population = []
    for items in elites:
        p = Packing(lengths, capacity)
        for bin_items in items:
            p.add_bin(bin_items)
        population.append(p)
    while len(population) < POPULATION:
        noise = 0 if not population else rng.uniform(0, 0.05 * capacity, len(sizes))
        order = np.argsort(-(sizes + noise), kind="stable").tolist()
        population.append(Packing(lengths, capacity).best_fit(order))
        if len(population[-1].bins) <= goal:
            break
    population.sort(key=Packing.fitness, reverse=True)
    for _ in range(CROSSOVERS):
        if len(population[0].bins) <= goal or len(population) < 2:
            break
        i, j = rng.choice(len(population), size=2, replace=False)
        child = crossover(population[i], population[j], rng)
        if child.fitness() > population[-1].fitness():
            population[-1] = child
            population.sort(key=Packing.fitness, reverse=True)
    return population[0]


def _layout(packing: Packing):
    """Bin number of every piece, in piece order."""
    out = [0] * len(packing.lengths)
    for b, items in enumerate(packing.bins):
        for i in items:
            out[i] = b
    return out


_ELITE = "block int, island int, n_bins int, uids array<long>, bins array<int>"


def _epoch(capacity, epoch):
    def run(key, items, elites):
        if not len(items):
            return pd.DataFrame({c: [] for c in ("block", "island", "n_bins", "uids", "bins")})
        block, island = map(int, key)
        items = items.sort_values("uid")
        lengths = items["length"].astype(int).tolist()
        brought = []
        for bins in elites["bins"]:
            groups: dict[int, list[int]] = {}
            for i, b in enumerate(bins):
                groups.setdefault(int(b), []).append(i)
            brought.append(list(groups.values()))
        best = evolve(lengths, capacity, (block * 31 + island) * 7 + epoch, brought)
        return pd.DataFrame({"block": [block], "island": [island], "n_bins": [len(best.bins)], "uids": [items["uid"].tolist()], "bins": [_layout(best)]})

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequence and place of every piece: the input's columns plus sequence_id (long, unique) and offset (long).

    Pieces of the full capacity have a sequence of their own. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = saved(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length"))
    blocks = max(1, -(-short.count() // BLOCK_PIECES))
    items = short.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    items = saved(items.withColumn("island", F.explode(F.lit(list(range(ISLANDS))))), "items").groupBy("block", "island")
    none = spark.createDataFrame([], _ELITE).groupBy("block", "island")
    first = saved(items.cogroup(none).applyInPandas(_epoch(capacity, 1), _ELITE), "elites")
    moved = first.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
    arrived = first.union(moved).groupBy("block", "island")
    second = items.cogroup(arrived).applyInPandas(_epoch(capacity, 2), _ELITE)
    best = second.groupBy("block").agg(F.min(F.struct("n_bins", "island", "uids", "bins")).alias("b"))
    placed = best.select("block", F.explode(F.arrays_zip("b.uids", "b.bins")).alias("p")).select(
        F.col("p.uids").alias("uid"), (F.col("block").cast("long") * BLOCK_PIECES * 8 + F.col("p.bins")).alias("sequence_id"))
    joined = pieces.join(placed, "uid", "left").withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("uid")))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("offset", F.coalesce(before, F.lit(0).cast("long"))).drop("uid")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
