"""The events table as a stream of statement rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.sources.sinks import scratch_path
from tallybook.streaming import ingest as ing
from tallybook.workload import sqltext as s
from tallybook.workload.registry import query


def event_rows(t):
    """Event rows shaped as ledger rows; the stream reads the events file through a glob."""
    stream = ing.statement_stream(t.spark, f"{t.dir}/events*.parquet", t.events.schema)
    return stream.select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value")).cast("decimal(18,2)").alias("amount"))


#: Four uploads: three parts of the events, then a part of them again: two days later, a month later under the same external
#: id, or a week later as new rows. Some ids repeat within an upload and from one to the next.
UPLOADS = 4
ARRIVALS = """select '' || user_id as user_id, event_id % 3 as part, cast(ts as date) as transaction_date, cast(round(value) as bigint) * 100 as cents, event_type as description,
 case when event_id % 4 = 0 then concat('EXT-', 10000 + event_id % 971) end as ext_id, concat(event_id % 3, '/', 1000000000 + event_id) as seq from events
 union all select '' || user_id, 3, cast(ts as date) + (case event_id % 15 when 0 then 2 when 5 then 31 else 7 end), cast(round(value) as bigint) * 100, upper(event_type),
 case when event_id % 15 = 5 and event_id % 4 = 0 then concat('EXT-', 10000 + event_id % 971) end, concat('3/', 1000000000 + event_id) from events where event_id % 5 = 0"""
_FOLD = """list_reduce(list_transform(list({'seq': seq, 'day': transaction_date, 'text': lower(trim(description)), 'fp': fp} order by seq), lambda r: [r]),
 lambda kept, x: case when len(list_filter(kept, lambda k: k.fp = x[1].fp or (cents <> 0 and k.text = x[1].text and abs(k.day - x[1].day) <= 3))) > 0 then kept else list_concat(kept, x) end)"""


@query(
    "l1_incremental_ingest",
    f"""with inc as ({ARRIVALS}), st as (select text, stem from (select text, {s.stem_cols('text')} from (select event_type as text from events union select upper(event_type) from events))),
fi as (select inc.*, stem, sha256(case when ext_id is not null then concat_ws('|', 'app', 'app', ext_id) else concat_ws('|', 'app', 'app', '' || transaction_date, (cents // 100) || '.0', stem) end) as fp from inc join st on description = text),
firsts as (select * from fi where ext_id is null union all select * from fi where ext_id is not null qualify row_number() over (partition by user_id, fp order by seq) = 1)
select user_id, k.fp as fingerprint, k.seq as seq from (select user_id, unnest({_FOLD}) k from firsts group by user_id, cents, stem)""",
)
def l1(t):
    """The rows arrive as four files, one micro-batch each; the same ledger as one fold over all rows gives."""
    t.events.createOrReplaceTempView("events")
    source, path = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "ingest")
    rows = t.spark.sql(ARRIVALS).withColumns({"amount": (F.col("cents") / 100).cast("decimal(18,2)"), "bank_source": F.lit("app"), "account_name": F.lit("app")}).drop("cents")
    for part in range(UPLOADS):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
    stream = ing.statement_stream(t.spark, source, t.spark.read.parquet(source).schema, files_per_batch=1)
    ing.start_ingest(stream, path, scratch_path(t.spark, "ingest-state")).awaitTermination()
    return t.spark.read.parquet(path).select("user_id", "fingerprint", "seq")


@query("l2_running_month_totals", "select user_id::varchar as user_id, strftime(ts, '%Y-%m') as ym, (sum(round(value)) * 100)::bigint as cents, count(*) as txn_count from events group by 1, 2")
def l2(t):
    path = scratch_path(t.spark, "totals")
    ing.start_month_totals(event_rows(t), path, scratch_path(t.spark, "totals-state")).awaitTermination()
    return ing.current_totals(t.spark, path)
