"""Streaming ingest: files of wire events to an append-only table, and live views over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fold import last_value
from ..sources import wire


def event_stream(spark: SparkSession, folder: str, tenant_id: int | None = None, files_per_batch: int = 100) -> DataFrame:
    """Events from JSON files dropped into a folder; bad rows are dropped, see ``bad_rows``."""
    raw = spark.readStream.schema(wire.RAW).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return wire.convert(raw, tenant_id, strict=False)


def bad_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that ingest cannot take: the dead letters."""
    raw = spark.read.schema(wire.RAW).json(folder)
    return raw.where("trace_id is null or span_id is null or try_cast(ts as bigint) is null or try_cast(seq as bigint) is null or ext_span_id is null")


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_micros(F.expr("ts div 1000")))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Retries within the delay are dropped with bounded state; the fold drops the rest when read."""
    return with_event_time(events).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["ext_span_id", "seq", "event_type"])


def append(events: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a Parquet table, one atomic commit a micro-batch."""
    writer = events.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def live_spans(events: DataFrame) -> DataFrame:
    """Running fold of each span for update mode: its lifecycle as it stands."""
    order = F.struct("seq", "ts")
    return events.groupBy("trace_id", "span_id").agg(
        last_value("status", order).alias("status"),
        last_value("duration_ns", order).alias("duration_ns"),
        F.bool_or(F.col("event_type") == 1).alias("has_start"),
        F.bool_or(F.col("event_type") == 2).alias("has_end"),
        F.count("*").alias("event_count"),
    )


def live_sessions(events: DataFrame) -> DataFrame:
    """Running totals of each session for update mode."""
    return events.where("session_id is not null").groupBy("session_id").agg(
        F.approx_count_distinct("trace_id").alias("traces"),
        F.count("*").alias("events"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.count_if(F.coalesce(F.col("status") != 0, F.lit(False))).alias("errors"),
    )
