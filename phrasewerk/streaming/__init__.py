"""Structured Streaming: the same operators fed by file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of events as a stream; ts becomes a timestamp with time zone, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows; *late* is the watermark of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    by = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def latest_status(log: DataFrame, keys: list[str], status: str, time: str, tie: str) -> DataFrame:
    """(keys..., status, time): the last status of each key; equal times go by the larger *tie*."""
    return log.groupBy(*keys).agg(F.max(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col(status).alias("s"))).alias("m")).select(*keys, F.col("m.s").alias(status), F.col("m.t").alias(time))


def for_each_batch(stream: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs *add* on every micro-batch that is there now, then ends; restarts go on from *checkpoint*."""
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id string, text string") -> DataFrame:
    """JSON-lines files of documents as a stream."""
    return spark.readStream.schema(schema).json(path)


def add_documents(engine, process: str, stream: DataFrame, checkpoint: str):
    """Takes the documents of a stream into a process as they come; a batch that was interrupted is taken again, which changes nothing that it had done: phrases that are there are retained, documents that a node has are not added twice."""
    return for_each_batch(stream, lambda batch, _: engine.add_documents(process, batch), checkpoint)
