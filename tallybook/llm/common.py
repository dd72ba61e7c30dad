"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.sources.sinks import scratch_path

#: Largest number of rows a side may have to be broadcast (8 to 16 bytes a row); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: A key with more than this part of all rows is a hot one; there are fewer of those than this number.
HOT_KEYS = 1000
#: Bytes that one Arrow batch aims at: a worker holds its texts several times over while it works on it.
BATCH_BYTES = 4 << 20
_SHIPPED: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers and bound what one Arrow batch holds, long texts included."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="tallybook-"), "tallybook.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among `ids` (one column `key`); the ids are broadcast only below BROADCAST_ROWS."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if small else ids, key, "left_semi")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], uses: str) -> DataFrame:
    """`rows` left-joined with `table`, which has one row per key and in `uses` how many of `rows` have it (`uses` goes).

    A table of up to BROADCAST_ROWS / 4 rows is broadcast. Beyond that a key may have any share of the rows: fewer than
    HOT_KEYS keys can have more than 1/HOT_KEYS of all uses, and these are broadcast; the others meet in a shuffle. The
    table should be a saved one, as it is read more than once.
    """
    n, total = table.agg(F.count("*"), F.sum(uses)).first()
    if n <= BROADCAST_ROWS // 4:
        return rows.join(F.broadcast(table.drop(uses)), keys, "left")
    hot = F.col(uses) * HOT_KEYS > total
    frequent = F.broadcast(table.where(hot).drop(uses))
    rare = rows.join(frequent.select(*keys), keys, "left_anti").join(table.where(~hot).drop(uses), keys, "left")
    return rare.unionByName(rows.join(frequent, keys))


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
