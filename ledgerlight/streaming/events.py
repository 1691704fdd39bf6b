"""Daily totals of an event stream by event time.

Files arrive late and twice. A watermark closes a day once events ``delay`` later have been seen, copies of an
event within it are dropped, and closed days are appended to a table, each once. The state holds the
open days' totals and the IDs within the watermark, so it does not grow with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """New files under ``path`` as a stream of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def daily_windows(
    events: DataFrame, time: str = "ts", key: str = "event_id", by: tuple[str, ...] = (), value: Column | None = None, delay: str = "1 day", length: str = "1 day"
) -> DataFrame:
    """(day, by, events, total) per window of event time; each ``key`` counts once within ``delay``.

    Rows without a time belong to no window. ``total`` sums ``value`` exactly if it is a decimal.
    """
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).where("_time is not null").withWatermark("_time", delay)
    once = timed.dropDuplicatesWithinWatermark([key])
    totals = [F.count(F.lit(1)).alias("events")] + ([F.sum(value).alias("total")] if value is not None else [])
    grouped = once.groupBy(F.window("_time", length).alias("_window"), *by).agg(*totals)
    return grouped.select(F.col("_window.start").alias("day"), *by, *[F.col(c) for c in ("events", "total")[: len(totals)]])


def start_daily(totals: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append closed windows to the Parquet table at ``path``; ``once`` takes in what is there and stops."""
    writer = totals.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
