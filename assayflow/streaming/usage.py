"""Streams: papers as they arrive, and token usage in event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import precheck


def usage_windows(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, users and value by window and type; on a stream, late rows are dropped after `late`."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, late)
    w = F.window(time, width)
    sums = rows.groupBy(w.alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value")
    )
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "users", "value")


def stream_usage(spark: SparkSession, path: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Closed windows of a folder of Parquet files, appended as Parquet; ends when all files are read."""
    schema = spark.read.parquet(path).schema
    rows = usage_windows(spark.readStream.schema(schema).parquet(path), **options)
    return rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def stream_papers(spark: SparkSession, root: str, checkpoint: str, sink: Callable[[DataFrame, int], None], **rules) -> StreamingQuery:
    """Pre-check of papers as their full.md arrives; a paper is read once, also after a restart."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "full.md").load(root)
    papers = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("paper_name"), F.col("value").alias("text"))
    return (
        precheck(papers, **rules).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
