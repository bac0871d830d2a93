"""Event-time operators that run as batch or stream, and micro-batch ingestion of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by event-time windows; late events are dropped beyond the watermark of a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(user_id, start, stop, n) of runs of events less than ``gap`` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once an event_id, with state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def ingest(changes: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Hand each micro-batch of changed files to ``apply`` (rows of one path: the last wins); all there is, or every so often."""

    def batch(df: DataFrame, n: int) -> None:
        last = df.groupBy("path").agg(F.max_by(F.struct(*(c for c in df.columns if c != "path")), "ts").alias("row"))
        apply(last.select("path", "row.*"), n)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def running(spark: SparkSession) -> list[dict]:
    """Name, id and state of the session's streams."""
    return [{"name": q.name, "id": q.id, "active": q.isActive, "status": q.status["message"]} for q in spark.streams.active]
