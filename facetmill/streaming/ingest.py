"""Streams of records and events. An extension: the batch operators do not depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landing(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a landing directory as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).format(kind).load(path)


def new_records(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: state is kept for ``delay`` only."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """kind, window_start, n, total of a stream or a table: events later than ``delay`` are left out of a stream."""
    e = events.withWatermark(at, delay) if events.isStreaming else events
    g = e.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(kind, F.col("w.start").alias("window_start"), "n", "total")


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now and ends; the checkpoint makes a rerun take only new files."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
