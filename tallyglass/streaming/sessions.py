"""Sessions, interval joins and run histories of event streams, drained into tables and equal to their batch queries.

Rows leave these operators when the watermark has passed them, so the last ones would wait for rows that never come. A
stream that is drained is therefore closed by marks: once all input has been read, a row of a time far ahead is added to a
second, empty source and the query is run on from its checkpoint; that moves the watermark, and a second mark makes the run
in which what is behind it leaves. Marks are read after everything else, whatever number of triggers the input takes, and
never reach a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder

AHEAD = ["2200-01-01", "2300-01-01"]


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n): events of a user that follow each other within `gap`."""
    held = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    rows = held.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end"))
    return rows.select("user_id", "session_start", "session_end", "n")


def follow_ups(causes: DataFrame, effects: DataFrame, within: str = "3 hours", late: str = "4 hours") -> DataFrame:
    """(user_id, cause_id, effect_id): effects of a user at most `within` after a cause; state is dropped behind the watermark."""
    a = causes.withWatermark("ts", late).select(F.col("user_id").alias("u"), F.col("event_id").alias("cause_id"), F.col("ts").alias("t0"))
    b = effects.withWatermark("ts", late).select("user_id", F.col("event_id").alias("effect_id"), F.col("ts").alias("t1"))
    return a.join(b, F.expr(f"u = user_id and t1 >= t0 and t1 <= t0 + interval {within}")).select("user_id", "cause_id", "effect_id")


def run_history(runs: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The runs' keys, once each: a report that comes again within the watermark is dropped, and its state after it."""
    return runs.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys)


def drained(spark: SparkSession, build: Callable[[DataFrame], DataFrame], events: DataFrame, name: str) -> DataFrame:
    """The rows of `build` over a stream of events and, after all of them, the closing marks.

    events is a stream with columns ts and user_id; rows without a user_id are dropped when the result is read, as a filter
    within the stream would be pushed down to the source and keep the marks from the watermark.
    """
    folder = f"{shared_folder(spark)}/tallyglass/{name}-{uuid.uuid4().hex}"
    marks, shape = f"{folder}/marks", events.schema
    spark.createDataFrame([], shape).coalesce(1).write.parquet(marks)
    both = events.unionByName(spark.readStream.schema(shape).parquet(marks))
    rows = build(both)
    for close in (None, *AHEAD):
        if close:
            mark = spark.range(1).select(*[(F.lit(close).cast("timestamp") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
            mark.coalesce(1).write.mode("append").parquet(marks)
        query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").filter("user_id is not null")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in rows.dtypes])


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(drained(spark, lambda e: sessions(e), _events(spark, sf), "sessions"))


def stream_follow_ups(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases at most three hours after a click of the same user."""
    return drained(spark, lambda e: follow_ups(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'")), _events(spark, sf), "follow-ups")


def stream_run_history(spark: SparkSession, sf: str) -> DataFrame:
    """A user's runs by the hour: reports of the same hour and kind are one run."""
    keyed = lambda e: e.withColumn("hour", F.date_trunc("hour", "ts"))
    return _plain(drained(spark, lambda e: run_history(keyed(e), ["user_id", "event_type", "hour"]), _events(spark, sf), "runs"))


QUERIES = {"stream_sessions": stream_sessions, "stream_follow_ups": stream_follow_ups, "stream_run_history": stream_run_history}
ORACLES = {
    "stream_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
 SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM b GROUP BY user_id, k""",
    "stream_follow_ups": "SELECT b.user_id, a.event_id AS cause_id, b.event_id AS effect_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 3 HOUR",
    "stream_run_history": "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events",
}
