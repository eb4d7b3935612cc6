"""Streams over the same operators: windowed counts with late data, and review state from an append-only log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type; state older than the watermark is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def latest_state(log: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """Current status per key of an insert-only log; equal times go to the larger status."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(at, status)).alias("status"), F.count(F.lit(1)).alias("n_changes"))


def run_to_table(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Drain the available input into a table of the shared folder: each trigger writes the groups that it changed.

    A trigger that runs again after a failure writes the same place again. The last trigger's row of a group counts.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/tallyglass/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/trigger={n}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(f"{stream.schema.toDDL()}, trigger long").parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("r")).select(*keys, "r.*")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return run_to_table(event_windows(_events(spark, sf), "1 day"), "event_windows", ["window_start", "event_type"])


def stream_review_state(spark: SparkSession, sf: str) -> DataFrame:
    return run_to_table(latest_state(_events(spark, sf), "user_id", "ts", "event_type"), "review_state", ["user_id"])


QUERIES = {"stream_event_windows": stream_event_windows, "stream_review_state": stream_review_state}
ORACLES = {
    "stream_event_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_review_state": "SELECT user_id, arg_max(event_type, (ts, event_type)) AS status, count(*) AS n_changes FROM events GROUP BY 1",
}
