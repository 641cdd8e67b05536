"""Streams over the events table, run to its end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import shared_dir
from ..session import read
from ..streaming import findings
from .registry import query


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that is there now, through the shared folder: results and the query's checkpoint."""
    at = f"{shared_dir(stream.sparkSession)}/rulemill/stream-{uuid.uuid4().hex}"
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def events_of(spark, sf_dir) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    # as a pattern, since a stream's path may otherwise not be a single file
    return findings.timed(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) filter (event_type = 'error') as fires, count(*) as applies from events group by 1, 2")
def stream_windows(spark, sf_dir):
    """Firing by hour and type."""
    w = findings.firing_by_window(events_of(spark, sf_dir).withColumn("status", F.col("event_type")), "event_type", "status")
    return run_to_end(w, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "fires", "applies")


@query("""
    with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
    select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from s group by user_id, k""")
def stream_sessions(spark, sf_dir):
    """Sessions of users, closed by half an hour without events."""
    s = run_to_end(findings.sessions(events_of(spark, sf_dir), "user_id"), "complete")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select distinct user_id, event_type from events")
def stream_unique(spark, sf_dir):
    """One finding a user and type: what the stream has within its watermark arrives at once."""
    return run_to_end(findings.unique_findings(events_of(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), "append")
