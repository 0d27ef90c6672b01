"""Streaming variants: windowed counts of an event stream and incremental document loads.

Streams go beyond batch loading; late rows are dropped behind the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemograph.operators.chunking import heading_sections

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows, for batches and for streams."""
    watermarked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = watermarked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_deliveries(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once; a stream remembers ids until the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, started, ended, n): runs of a user's events without a pause longer than the gap."""
    watermarked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = watermarked.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def load_documents(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Markdown files as they arrive, as sections in Parquet; a file is loaded once."""
    files = spark.readStream.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def load(batch: DataFrame, batch_id: int) -> None:
        heading_sections(batch, "path", "text").withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    return named.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
