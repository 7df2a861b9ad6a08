"""Structured Streaming over call files and event tables: the batch kernels, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import step_windows


def stream_calls(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of call files (cell_id, chr, pos, c, t) as they arrive in a folder."""
    return spark.readStream.schema("cell_id bigint, chr string, pos bigint, c bigint, t bigint").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_windows(calls: DataFrame, step: int) -> DataFrame:
    """Site counts by cell and window so far; the state is one row for each window that was seen."""
    return step_windows(calls, step).groupBy("cell_id", "chr", "start", "end").agg(F.count_if(F.col("c") != 0).alias("m"), F.count_if(F.col("t") != 0).alias("u"), F.sum(F.col("c") + F.col("t")).alias("n"))


def event_windows(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by tumbling or sliding window and type; what comes later than `late` is dropped from a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a folder, each file once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
