"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are cut at half depth, both halves again, and so on; all pieces of one recursion level are worked on by one Spark
job. Going up, every aligned segment of 2^k turns gets a name made of the names of its halves. Going down, the cut prefix of
every piece (the turns before the cut) is named from the prefix that the piece starts with and its upper half, so that level
k names the prefixes whose length is an odd multiple of 2^k; equal names are one node. Totals are grafted upward in the same
recursion: the totals of a lower forest are added to the nodes at the cut, first within the aligned blocks of each level, then
from the blocks below. Level k holds about 1/2^k of the turns, so both recursions together move a few times the turns,
however deep one conversation is, and every join but one is between unique keys.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import looked_up, ready, saved

#: Turns of one conversation that one key of a join stands for, and (as a power of 2) the ids of one piece of an id list.
CHUNK_TURNS, ID_BITS = 4096, 12
_ROOT = (0, 0)
_NAME = ["n1", "n2"]


def _hashed(*c) -> list[Column]:
    """Two 64-bit hashes with seeds of their own: a name."""
    return [F.xxhash64(F.lit(seed), *c).alias(n) for seed, n in enumerate(_NAME, 1)]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first; equal turns by a hash of role and text), the turn's name n1, n2, and its code points.

    Null roles and texts count as empty. Rows without conv_id take no part; other columns are not read. Positions come from
    range partitions of all turns, so that a conversation of any length is numbered by many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *_hashed(role, text), F.char_length(text).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), "n1", "n2"]
    rows = saved(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    counts = rows.groupBy("conv_id", "part").count()
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.sum("count").over(earlier)).where("before > 0").select("conv_id", "part", "before")
    # Only a conversation that goes on from one range partition into the next has such a row: fewer rows than partitions.
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    numbered = rows.withColumn("place", place).join(F.broadcast(before), ["conv_id", "part"], "left")
    return numbered.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), *_NAME, "chars")


def with_shared_heads(turns: DataFrame, group: int, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first `head` turns of conversation c - c % group, then c's own turns after its first `head`.

    `head` is an expression of conv_id that gives at most `most`. Returns the turns and (conv_id, len) of all conversations, turnless ones included.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = saved(sizes.select("conv_id", "n", head.cast("long").alias("h"), base.alias("base")), "conversations")
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = saved(convs.select("conv_id", "base", "n", "h", "taken"), "rebuilt")
    heads = turns.where((F.col("pos") <= most) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "base")
    heads = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos <= taken").select("conv_id", "pos", *_NAME, "chars")
    moved = convs.where("h <> taken and n > h").select("conv_id", (F.col("h") - F.col("taken")).alias("back"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / CHUNK_TURNS))).alias("chunk"))
    own = turns.where(F.col("pos") > head).withColumn("chunk", F.floor(F.col("pos") / CHUNK_TURNS))
    own = own.join(moved, ["conv_id", "chunk"], "left").select("conv_id", (F.col("pos") - F.coalesce("back", F.lit(0))).alias("pos"), *_NAME, "chars")
    lens = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    return saved(heads.union(own), "turns"), saved(lens, "lens")


def _is_multiple(c: str, bit: int, odd: bool | None = None) -> Column:
    """Whether c is a multiple of 2^bit and, if asked, an odd (even) one."""
    out = F.col(c).bitwiseAND(F.lit((1 << bit) - 1)) == 0
    return out if odd is None else out & ((F.col(c).bitwiseAND(F.lit(1 << bit)) != 0) if odd else (F.col(c).bitwiseAND(F.lit(1 << bit)) == 0))


def _segments(turns: DataFrame, levels: int) -> list[DataFrame]:
    """For each level k the whole segments of 2^k turns: conv_id, start (turns before), name, and chars of the last turn."""
    out = [turns.select("conv_id", (F.col("pos") - 1).alias("start"), *_NAME, "chars")]
    for k in range(levels - 1):
        upper = F.col("start").bitwiseAND(F.lit(1 << k)) == 0
        of = lambda half, c, n: F.max(F.when(half, F.col(c))).alias(n)
        halves = out[k].groupBy("conv_id", F.col("start").bitwiseAND(F.lit(~((1 << k + 1) - 1))).alias("start")).agg(
            of(upper, "n1", "u1"), of(upper, "n2", "u2"), of(~upper, "n1", "l1"), of(~upper, "n2", "l2"), of(~upper, "chars", "chars"))
        out.append(saved(halves.where("l1 is not null").select("conv_id", "start", *_hashed("u1", "u2", "l1", "l2"), "chars"), "segments"))
    return out


def _prefixes(turns: DataFrame, levels: int) -> DataFrame:
    """conv_id, p, name and last turn's chars of every prefix of p >= 1 turns, the longest pieces cut first."""
    segments, known = _segments(turns, levels), None
    for k in reversed(range(levels)):
        upper = segments[k].where(_is_multiple("start", k + 1)).withColumnsRenamed({"n1": "s1", "n2": "s2"})
        if known is None:
            named = upper.select("*", *[F.lit(x).cast("long").alias(n) for n, x in zip(_NAME, _ROOT)])
        else:
            named = upper.join(known.select("conv_id", F.col("p").alias("start"), *_NAME), ["conv_id", "start"], "left").fillna(0, _NAME)
        named = saved(named.select("conv_id", (F.col("start") + (1 << k)).alias("p"), *_hashed("n1", "n2", "s1", "s2"), "chars"), "prefixes")
        known = named if known is None else known.union(named)
    return known


def _ancestors(nodes: DataFrame, prefixes: DataFrame, k: int) -> DataFrame:
    """name and depth of every node at a multiple of 2^k, with the name a1, a2 of its ancestor 2^k levels above."""
    below = nodes.where(_is_multiple("depth", k)).select(*_NAME, "depth", "conv_id", (F.col("depth") - (1 << k)).alias("p"))
    above = prefixes.where(_is_multiple("p", k)).select("conv_id", "p", F.col("n1").alias("a1"), F.col("n2").alias("a2"))
    return below.join(above, ["conv_id", "p"], "left").fillna(0, ["a1", "a2"]).select(*_NAME, "depth", "a1", "a2")


def _sums(rows: DataFrame) -> DataFrame:
    """leaves and saved added up by name."""
    return rows.groupBy(*_NAME).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _grafted(own: DataFrame, above: list[DataFrame]) -> DataFrame:
    """Totals of all nodes strictly below each node (name, leaves, saved); nodes with none may be missing."""

    def lifted(totals, k, odd):
        """Totals of nodes at odd or even multiples of 2^k, moved to their ancestors 2^k above."""
        where = above[k].where(_is_multiple("depth", k, odd))
        return where.join(totals, _NAME).select(F.col("a1").alias("n1"), F.col("a2").alias("n2"), "leaves", "saved")

    def at(totals, k, odd=None):
        return totals.where(_is_multiple("depth", k, odd))

    def with_depth(totals):
        depths = above[0].select(*_NAME, "depth").union(above[0].sparkSession.createDataFrame([(*_ROOT, 0)], "n1 long, n2 long, depth long"))
        return totals.join(depths, _NAME)

    # Within aligned blocks: level k has the totals of the 2^k levels below a node, for nodes at multiples of 2^k.
    first = above[0].join(own, _NAME).select(F.col("a1").alias("n1"), F.col("a2").alias("n2"), "leaves", "saved")
    block = [saved(with_depth(_sums(first)), "grafts")]
    for k in range(len(above)):
        kept = at(block[k], k + 1).select(*_NAME, "leaves", "saved")
        forest = lifted(at(block[k], k, True).select(*_NAME, "leaves", "saved"), k, True)
        block.append(saved(with_depth(_sums(kept.union(forest))), "grafts"))
    # From the blocks below: a node at an odd multiple of 2^k gets what the nodes 2^k below it have in all.
    done = at(block[-1], len(above)).select(*_NAME, "leaves", "saved")
    for k in reversed(range(len(above))):
        own_block = at(block[k], k, True).select(*_NAME, "leaves", "saved")
        done = done.union(saved(_sums(own_block.union(lifted(done, k, False))), "totals"))
    return done


def _id_digests(batches):
    """SHA-256 of each node's id list; rows come sorted by node and place, so that pieces are streamed and never joined."""
    state, digest = None, None
    out: list[list] = [[], [], []]

    def close():
        for column, value in zip(out, (*state, digest.hexdigest())):
            column.append(value)

    for b in batches:
        for n1, n2, ids in zip(b["n1"].to_pylist(), b["n2"].to_pylist(), b["ids"].to_pylist()):
            if state == (n1, n2):
                digest.update(b",")
            else:
                if state:
                    close()
                state, digest = (n1, n2), hashlib.sha256()
            digest.update(ids.encode())
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], [*_NAME, "ends_sha256"])
            out = [[], [], []]
    if state:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], [*_NAME, "ends_sha256"])


def prefix_trie(turns: DataFrame, lens: DataFrame | None = None) -> DataFrame:
    """One row per node of the trie of all sequences: every distinct sequence of first d turns, from the textless root on.

    `turns` is what `ordered_turns` gives: conv_id, pos from 1 without gaps, name, chars. `lens` (conv_id, len) has all
    conversations where turnless ones are to count; by default those with turns. Returns conv_id (smallest member), depth,
    parent_conv_id (the parent's smallest member; root: null), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (summed over the subtree: (n_convs - 1) x code points of the node's last turn) and ends_sha256
    (of the ids that end here, ascending, comma-joined). Equal conversations share all their nodes; very long texts are
    hashed and never moved. Without any conversation there is no node, not even the root. A turn is named by 128 bits of
    hashes; a collision is not checked again.
    """
    spark = ready(turns.sparkSession)
    if lens is None:
        lens = saved(turns.groupBy("conv_id").agg(F.max("pos").alias("len")), "lens")
    n, least, deepest = lens.agg(F.count("*"), F.min("conv_id"), F.max("len")).first()
    levels = max(1, int(deepest or 0).bit_length())
    prefixes = _prefixes(turns, levels)
    nodes = prefixes.groupBy(*_NAME, F.col("p").alias("depth")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = saved(nodes, "nodes")
    above = [saved(_ancestors(nodes, prefixes, k), "ancestors") for k in range(levels)]

    children = above[0].groupBy(F.col("a1").alias("n1"), F.col("a2").alias("n2")).agg(F.count("*").alias("n_children"))
    children = saved(children, "children")
    root = spark.createDataFrame([(*_ROOT, 0, least, n, 0)] if n else [], "n1 long, n2 long, depth long, conv_id long, n_convs long, chars long")
    all_nodes = nodes.select(*root.columns).union(root).join(children, _NAME, "left").fillna(0, ["n_children"])
    all_nodes = saved(all_nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
    below = _grafted(all_nodes.where("depth > 0").select(*_NAME, "leaves", "saved"), above)

    ends = lens.join(prefixes.select("conv_id", F.col("p").alias("len"), *_NAME), ["conv_id", "len"], "left").fillna(0, _NAME)
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))).alias("ids")
    pieces = ends.groupBy(*_NAME, F.shiftright("conv_id", ID_BITS).alias("piece")).agg(ids)
    digests = pieces.repartition(*_NAME).sortWithinPartitions(*_NAME, "piece").select(*_NAME, "ids").mapInArrow(_id_digests, "n1 long, n2 long, ends_sha256 string")

    totals = below.select(*_NAME, F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    out = all_nodes.join(totals, _NAME, "left").join(digests, _NAME, "left").join(above[0].select(*_NAME, "a1", "a2"), _NAME, "left")
    out = saved(out.select(
        "conv_id", "depth", "a1", "a2", "n_convs", "n_children", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "trie")
    parents = all_nodes.select(F.col("n1").alias("a1"), F.col("n2").alias("a2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("uses"))
    out = looked_up(out, parents, ["a1", "a2"], "uses")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """`prefix_trie` of a table of conv_id, turn, role and text as it stands."""
    return prefix_trie(saved(ordered_turns(conversations), "turns"))
