"""Incremental ingest and running totals as Structured Streaming queries.

A statement may come at any time after its days, so nothing is dropped for its age: each micro-batch is checked against
the stored ledger, of which only the months around the batch's days are read. Every sink write is keyed by its batch id, so
a batch that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallybook.columns import cents
from tallybook.operators.dedup import DRIFT_DAYS, first_by_id, first_in_batch, new_by_similarity, trusted_id, with_fingerprint
from tallybook.sources.versions import add_version, current_version

#: Month folders, written so that no reader takes them for dates, and the folder of rows without a date.
MONTH = "'m'yyyy-MM"
UNDATED = "undated"
#: First hexadecimal digits of a fingerprint that name its folder in the index of external ids.
ID_DIGITS = 1


def statement_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """File-source stream of statement rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _short(rows: DataFrame) -> DataFrame:
    """Fingerprints as 32 bytes instead of 64 digits, which no compression halves in a shuffle."""
    return rows.withColumn("fingerprint", F.unhex("fingerprint"))


def new_rows(rows: DataFrame, stored: list[DataFrame]) -> DataFrame:
    """Rows of a batch that no stored ledger has by fingerprint or similarity, after the duplicates in the batch.

    The batch has short fingerprints and one row per external id; a ledger's are digits.
    """
    for ledger in stored:
        past = _short(ledger if "fingerprint" in ledger.columns else with_fingerprint(ledger))
        rows = rows.join(past.select("user_id", "fingerprint").distinct(), ["user_id", "fingerprint"], "left_anti")
        rows = new_by_similarity(rows, past)
    return first_in_batch(rows, ids_are_first=True)


def start_ingest(stream: DataFrame, ledger_path: str, checkpoint: str, history: DataFrame | None = None) -> StreamingQuery:
    """Append new rows to the ledger, month by month; `history` is a ledger from before the stream, checked in every batch.

    Rows without an external id can only repeat within days, so they meet the stored months around them. An external id may
    come again at any time: ids that ever came in are kept in an index beside the ledger (`ids_path`), in folders by the
    first hexadecimal digits of the fingerprint, and a batch reads the folders of its own ids. So the ledger is the same
    however the rows are split into batches, as long as their order is.
    """
    ids_path = f"{ledger_path.rstrip('/')}-ids"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        printed = with_fingerprint(batch)
        bucket = F.substring("fingerprint", 1, ID_DIGITS)
        ids = _short(printed.filter(trusted_id() != "").select("user_id", "fingerprint", bucket.alias("bucket")))
        fresh, earlier = first_by_id(_short(printed)), [] if history is None else [history]
        if batch_id > 0:
            buckets = [r[0] for r in ids.select("bucket").distinct().collect()]  # at most 16 ** ID_DIGITS
            known = _before(spark, ids_path, batch_id, ids.schema).filter(F.col("bucket").isin(buckets))
            fresh = fresh.join(known.select("user_id", "fingerprint").distinct(), ["user_id", "fingerprint"], "left_anti")
            months = batch.select(F.explode(F.array(*[F.date_format(F.date_add("transaction_date", d), MONTH) for d in (-DRIFT_DAYS, DRIFT_DAYS)])).alias("ym")).distinct()
            stored = _before(spark, ledger_path, batch_id, printed.withColumn("ym", F.lit("")).schema)
            earlier.append(stored.join(months.union(_undated(spark)), "ym", "left_semi").drop("ym"))
        fresh = new_rows(fresh, earlier).withColumn("fingerprint", F.lower(F.hex("fingerprint"))).withColumn("ym", F.coalesce(F.date_format("transaction_date", MONTH), F.lit(UNDATED)))
        fresh.write.mode("overwrite").partitionBy("ym").parquet(f"{ledger_path}/batch={batch_id}")
        ids.distinct().repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{ids_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _undated(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(UNDATED).alias("ym"))


def _before(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    """Rows that earlier batches wrote below a path; a batch may have written none."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(f"{path}/batch=*")
    return rows.filter(F.col("batch") < batch_id).drop("batch")


def month_totals_stream(stream: DataFrame, event_time: str = "ts") -> DataFrame:
    """Running totals per user and month; one state row per group."""
    return stream.groupBy("user_id", F.date_format(event_time, "yyyy-MM").alias("ym")).agg(F.sum(cents("amount")).alias("cents"), F.count(F.lit(1)).alias("txn_count"))


def start_month_totals(stream: DataFrame, path: str, checkpoint: str, event_time: str = "ts", fanout: int = 8) -> StreamingQuery:
    """Changed groups of each batch as a version; full levels of versions are merged (`versions.add_version`)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        add_version(batch, path, batch_id, ["user_id", "ym"], fanout)

    out = month_totals_stream(stream, event_time).writeStream.outputMode("update").foreachBatch(write)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    return current_version(spark, path, ["user_id", "ym"])
