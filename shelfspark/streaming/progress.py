"""Job events as streams: latest states, distinct pages, and counts in windows of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def distinct_events(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key; keys are forgotten when their events can no longer come."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values in windows of event time."""
    window = F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def drain(stream: DataFrame, checkpoint: str, sink: str | Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs a stream over all that is there, to Parquet or a function of batches, and stops. A restart goes on where it ended."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if callable(sink) else writer.format("parquet").option("path", sink)).start()
    query.awaitTermination()
    return query


def follow(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every_ms: int = 1000, mode: str = "update") -> StreamingQuery:
    """Runs a stream on and on, looking for what is new so often (from 200 ms to 10 s); the caller stops it."""
    every = max(200, min(every_ms, 10_000))
    return stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(processingTime=f"{every} milliseconds").foreachBatch(sink).start()
