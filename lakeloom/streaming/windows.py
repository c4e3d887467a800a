"""Windowed counts over a stream of events, and their batch twins. These go beyond a lake's index; they feed its profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over Parquet files of events; ts becomes a timestamp in the session's zone."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling or sliding windows; rows later than `late` behind the latest are dropped
    in a stream."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    held = events.withWatermark("ts", late) if events.isStreaming else events
    found = held.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, n): runs of a user's events with no gap of `gap` or more."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    found = held.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("session_start"), "n")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now into a memory table and returns it; for results that fit the driver."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
