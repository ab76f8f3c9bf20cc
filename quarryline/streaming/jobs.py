"""Structured Streaming forms of job tracking (section 2.12), and windowed counts as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def job_state(updates: DataFrame) -> DataFrame:  # ST1: the latest status of each job; batch, or streaming in update mode
    latest = F.max_by(F.struct("status", "progress", "ts"), "ts")
    return updates.groupBy("job_id").agg(latest.alias("x"), F.min("ts").alias("created_at")).select("job_id", "x.status", "x.progress", F.col("x.ts").alias("updated_at"), "created_at")


def merged_progress(updates: DataFrame) -> DataFrame:  # ST1: a partial update leaves the other fields as they were
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    return updates.groupBy("job_id").agg(last("current"), last("total"), last("message"))


def publish(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):  # ST2
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(send)
    return (writer.trigger(availableNow=True) if once else writer).start()


def subscribe(snapshot: DataFrame, updates: DataFrame) -> DataFrame:  # ST3: where each job stood, then its updates that are newer
    first = snapshot.select("job_id", "status", F.col("updated_at").alias("ts"))
    newer = updates.join(first.select("job_id", F.col("ts").alias("seen")), "job_id", "left").where("seen is null or ts > seen").select("job_id", "status", "ts")
    return newer.withColumn("is_last", F.col("status").isin(*TERMINAL))


def completed_between(before: DataFrame, now: DataFrame) -> DataFrame:  # ST7: active at the last poll and not at this one
    active = lambda df: df.where(~F.col("status").isin(*TERMINAL)).select("job_id")
    return active(before).join(active(now), "job_id", "left_anti")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts by event time, with a watermark so that state stays bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("since"), "event_type", "n")
