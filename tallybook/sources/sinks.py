"""Writing the ledger: partitioned append, output records and JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.columns import month_key
from tallybook.functions.merchants import display_merchant
from tallybook.session import checkpoint_root
from tallybook.sources.versions import remove


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared checkpoint folder and read back, for what several parts of a plan read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append partitioned by month.

    Rows are rebalanced by month: the number of files follows the size of a month (`spark.sql.adaptive.advisoryPartitionSizeInBytes`),
    so a month of any size is spread over tasks and small months share one.
    """
    rows.withColumn("ym", month_key()).hint("rebalance", F.col("ym")).write.mode("append").partitionBy("ym").parquet(path)


def delete_from_ledger(path: str, rows: DataFrame) -> list[str]:
    """Take the given rows (user_id, transaction_id) out of a ledger that `append_ledger` wrote; returns the months rewritten.

    Only months that hold such a row are read whole and replaced, from a copy in the shared folder, so that a task or job that
    runs again finds its input; the files of all other months stay as they are. A month without a row left loses its folder.
    """
    spark = rows.sparkSession
    gone = stored(rows.select("user_id", "transaction_id").distinct(), "deleted")
    ledger = spark.read.parquet(path)
    keys = ["user_id", "transaction_id"]
    months = sorted(r[0] for r in ledger.join(gone, keys, "left_semi").select(F.col("ym").cast("string")).distinct().collect())
    if not months:
        return []
    left = stored(ledger.filter(F.col("ym").cast("string").isin(months)).join(gone, keys, "left_anti"), "left")
    left.hint("rebalance", F.col("ym")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path)
    remaining = {r[0] for r in left.select(F.col("ym").cast("string")).distinct().collect()}
    for month in months:
        if month not in remaining:
            remove(spark, f"{path}/ym={month}")
    return months


def output_record(rows: DataFrame) -> DataFrame:
    """The record a client reads, with a display merchant and defaulted fields."""
    shown = F.coalesce(F.nullif(display_merchant("description"), F.lit("")), F.col("description"), F.lit(""))
    return rows.select(
        "transaction_id", F.col("transaction_date").cast("string").alias("date"), "description", shown.alias("merchant"), "amount",
        F.lit("USD").alias("currency"), "category", "transaction_type", "bank_source", F.coalesce(F.col("is_fixed"), F.lit(False)).alias("is_fixed"))


def write_json_records(rows: DataFrame, path: str) -> None:
    output_record(rows).write.mode("append").json(path)
