"""Partition layout, skew and timing reports."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_BYTES = 128 * 2**20
TIMING_SCHEMA = "section string, scenario string, operation string, seconds double"


def configure(
    spark: SparkSession, shuffle_partitions: int | None = None, shuffle_bytes: int | None = None
) -> SparkSession:
    """Session settings this library counts on; nothing else in it changes the session.

    Adaptive execution merges small shuffle partitions and splits skewed ones, also where the
    join's output partitioning is used by a later step. ``shuffle_bytes``, the size of the largest
    shuffle expected, sets enough partitions for 128 MB each, so that a task sorts in memory;
    adaptive execution merges those that turn out small.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_bytes is not None:
        shuffle_partitions = max(shuffle_partitions or 1, -(-shuffle_bytes // PARTITION_BYTES))
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in settings.items():
        spark.conf.set(name, value)
    return spark


def spread(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """``n`` partitions, by hash of ``cols`` or evenly without any.

    A hash of few values leaves partitions empty and puts a hot value into one; the reports below
    show that. Use it only where a later step groups or joins on the same columns.
    """
    return df.repartition(n, *cols)


def shrink(df: DataFrame, n: int) -> DataFrame:
    """Merge into at most ``n`` partitions without a shuffle."""
    return df.coalesce(n)


def hold(df: DataFrame) -> DataFrame:
    """Keep a frame that several actions use; spills to disk, and lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release(df: DataFrame) -> None:
    df.unpersist()


def partition_counts(df: DataFrame) -> DataFrame:
    """(partition, rows) of the non-empty partitions."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def partition_report(df: DataFrame, label: str, sample: int = 5) -> DataFrame:
    """One row: label, number of partitions and the row counts of the first ``sample`` of them."""


    def count(batches):
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"partition": pa.array([part], pa.int32()), "rows": pa.array([rows], pa.int64())})

    # A task tells its rows even if it has none, so one pass counts the partitions too.
    counts = df.select(F.lit(True).alias("row")).mapInArrow(count, "partition int, rows long")
    first = F.sort_array(F.collect_list(F.when(F.col("partition") < sample, F.struct("partition", "rows"))))
    return counts.agg(
        F.lit(label).alias("label"), F.count(F.lit(1)).cast("int").alias("count"), F.transform(first, lambda x: x["rows"]).alias("sample_distribution")
    )


def skew_report(df: DataFrame, key: str, top: int = 5) -> DataFrame:
    """The ``top`` most frequent keys, their share of all rows and their ratio to the median count.

    A hot key moves the mean, not the median. The median keeps the distinct counts in one task,
    which are at most the square root of twice the rows.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.agg(F.struct(F.sum("count").alias("rows"), F.median("count").alias("median"))).scalar()
    return (
        counts.orderBy(F.desc("count"), key)
        .limit(top)
        .select(key, "count", (F.col("count") / totals["rows"]).alias("share"), (F.col("count") / totals["median"]).alias("ratio_to_median"))
    )


def timed(operation: Callable[[], object], runs: int = 3, warm_up: bool = True) -> tuple[object, float]:
    """Run an action once to warm up, then ``runs`` times: its result and the median seconds."""
    result = operation() if warm_up else None
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        result = operation()
        seconds.append(time.perf_counter() - start)
    return result, statistics.median(seconds)


@dataclass
class TimingLog:
    """Collects timings of named actions and returns them as a frame."""

    runs: int = 3
    rows: list[tuple[str, str, str, float]] = field(default_factory=list)

    def run(self, section: str, scenario: str, operation: str, action: Callable[[], object], once: bool = False):
        """Time ``action``, which must trigger a Spark action, and return its result.

        ``once`` times the first run alone, as for filling a cache.
        """
        result, seconds = timed(action, 1, warm_up=False) if once else timed(action, self.runs)
        self.rows.append((section, scenario, operation, round(seconds, 4)))
        return result

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, TIMING_SCHEMA)
