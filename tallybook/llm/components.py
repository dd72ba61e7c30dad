"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import saved


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(a, b)`; root is the smallest node of its component.

    Each step joins every node with the smallest neighbour it knows, so a component of any size is never gathered: all
    state is an edge table in the shared folder. Self-loops and nulls are ignored; nodes without edges do not appear.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = saved(e, "edges")
    last = _state(e)
    while last[0]:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = saved(moved.union(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = _state(e)
        if now == last:
            break
        last = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
