"""Rows in the order of their ids over many tasks: range buckets, each with a look at the row that follows it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a bucket aims at, and the most buckets (a bucket is streamed, never held whole).
BUCKET_ROWS, MAX_BUCKETS = 1000, 4096
_LEAST = -(1 << 63)


def in_id_order(rows: DataFrame, descending: bool = False, next_row: bool = False) -> DataFrame:
    """`rows` dealt to range buckets of doc_id and sorted inside each partition by bucket and doc_id.

    Adds bucket (int, its rank in the order), ahead (boolean) and order_id (long). With `next_row`, each bucket ends with a
    copy of the first row of the bucket that follows it (the last bucket: of the very first row), marked ahead. A null doc_id
    counts as the smallest id; equal ids are ordered by text. Only bucket bounds pass through the driver.
    """
    order_id = F.coalesce(F.col("doc_id"), F.lit(_LEAST))
    ids = rows.select(order_id.alias("order_id"))
    n = ids.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    bounds = np.empty(0, np.int64)
    if buckets > 1:
        shares = F.lit([i / buckets for i in range(1, buckets)])
        bounds = np.unique(np.array(ids.agg(F.percentile_approx("order_id", shares, 20 * buckets)).first()[0], np.int64))

    def place(x):
        at = np.searchsorted(bounds, np.asarray(x, np.int64), side="left")
        return len(bounds) - at if descending else at

    @F.pandas_udf("int")
    def bucket_of(x: pd.Series) -> pd.Series:
        return pd.Series(place(x).astype("int32"))

    out = rows.withColumn("order_id", order_id)
    if not next_row:
        out = out.withColumn("bucket", bucket_of("order_id")).withColumn("ahead", F.lit(False))
    else:
        edge = F.max if descending else F.min
        firsts = sorted(ids.withColumn("bucket", bucket_of("order_id")).groupBy("bucket").agg(edge("order_id")).collect())
        before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

        @F.pandas_udf("array<int>")
        def buckets_of(x: pd.Series) -> pd.Series:
            return pd.Series([[int(b), before[i]] if i in before else [int(b)] for b, i in zip(place(x), x)])

        out = out.select("*", F.posexplode(buckets_of("order_id")).alias("copy", "bucket")).withColumn("ahead", F.col("copy") > 0).drop("copy")
    key = F.col("order_id").desc() if descending else F.col("order_id")
    return out.repartition("bucket").sortWithinPartitions("bucket", "ahead", key, "text")
