"""Streams over the events table, read as files; each result equals its batch query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.cut import shared_folder
from ..sources.tables import table
from ..streaming import streams


def _folder(spark) -> str:
    """Where checkpoints and outputs go: below the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = streams.file_stream(spark, schema, f"{sf}/events.parque[t]")  # a pattern: the table may be a file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_log(spark, sf):
    folder = _folder(spark)
    streams.append_log(_events(spark, sf).select("event_id", "event_type"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_visits(spark, sf):
    folder = _folder(spark)
    q = streams.upsert_batches(_events(spark, sf).select("user_id", "ts", "event_type"), f"{folder}/t", ["user_id", "event_type"], "ts", f"{folder}/state")
    q.awaitTermination()
    return streams.newest_version(spark, f"{folder}/t").select("user_id", "event_type", "ts")


def stream_pages(spark, sf):
    folder = _folder(spark)
    pages = _events(spark, sf).select(F.col("event_type").alias("root"), F.col("user_id").alias("page"), F.floor(F.col("value")).alias("fingerprint"), F.col("ts").alias("updated"))
    seen = streams.page_stream(pages, late="60 days").drop("updated")
    seen.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_lifetimes(spark, sf):
    """Lives of users' event types that ended, by two days without an event."""
    folder = _folder(spark)
    lives = streams.lifetimes(_events(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "2 days", "1 hour")
    lives.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


QUERIES = {f.__name__: f for f in (stream_log, stream_visits, stream_pages, stream_lifetimes)}

ORACLE = {
    "stream_lifetimes": """WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
      l AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS life FROM g)
      SELECT user_id, event_type, min(ts) AS started, max(ts) AS last, count(*) AS n FROM l GROUP BY user_id, event_type, life HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_log": "SELECT event_id, event_type FROM events",
    "stream_visits": "SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL",
    "stream_pages": "SELECT DISTINCT event_type AS root, user_id AS page, CAST(floor(value) AS BIGINT) AS fingerprint FROM events",
}
