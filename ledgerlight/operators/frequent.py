"""The most frequent keys of a column with very many values, exactly, without counting all of them.

Each task keeps a bounded number of counters: when there are too many, the smallest count that has to go is
taken off all of them, and what was taken off in total is the task's error. Summaries add up: a key's
true count lies between its summed counters and those plus the summed errors. They name the few
candidates, which a second scan counts exactly. If the errors are so large that a key outside the
summaries could belong to the top, all keys are counted instead.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.staging import stage
from ledgerlight.operators.joins import fits_broadcast


def _reduced(counts: Counter, counters: int) -> tuple[Counter, int]:
    """At most ``counters`` of the counts, each less what the next largest one had, and that amount."""
    order = counts.most_common(counters + 1)
    if len(order) <= counters:
        return counts, 0
    off = order[counters][1]
    return Counter({k: n - off for k, n in order[:counters] if n > off}), off


def frequent_summary(df: DataFrame, key: str, counters: int = 1_000) -> DataFrame:
    """(value, low, error, rows): counters of every task, and one row per task with its error and rows.

    Task rows have ``error``, value rows do not. Null is a value like others. Summaries of days can be stored
    and put together by :func:`merge_summaries`.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("value", kind), T.StructField("low", T.LongType()), T.StructField("error", T.LongType()), T.StructField("rows", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        error, rows, arrow = 0, 0, None
        for batch in batches:
            column = batch.column(0)
            arrow, rows = column.type, rows + len(column)
            found = column.value_counts()
            counts.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))
            if len(counts) > 4 * counters:
                counts, off = _reduced(counts, counters)
                error += off
        if arrow is None:
            return
        counts, off = _reduced(counts, counters)
        n = len(counts)
        columns = [pa.array([*counts, None], arrow), pa.array([*counts.values(), 0], pa.int64()), pa.array([None] * n + [error + off], pa.int64()), pa.array([None] * n + [rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["value", "low", "error", "rows"])

    return df.select(key).mapInArrow(run, schema)


def merge_summaries(summaries: DataFrame) -> tuple[DataFrame, int, int]:
    """(value, low) summed over all summaries, the summed error, and the rows they cover."""
    whole = summaries.agg(F.sum("error"), F.sum("rows")).first()
    return summaries.where("error is null").groupBy("value").agg(F.sum("low").alias("low")), whole[0] or 0, whole[1] or 0


def top_keys(df: DataFrame, key: str, top: int = 5, counters: int = 1_000) -> DataFrame:
    """The ``top`` most frequent values of ``key``: (key, count, share of all rows); ties by value.

    Exact whatever the data: two scans with bounded state where a few keys stand out, a count of all
    keys where none does.
    """
    summary, error, rows = merge_summaries(stage(frequent_summary(df, key, counters), "frequent"))
    summary = stage(summary, "frequent-merged")
    lows = [r.low for r in summary.orderBy(F.desc("low")).limit(top).select("low").collect()]
    counted = df.select(F.col(key).alias("_key"))
    # Fewer counters than asked for and nothing lost: these are all the keys.
    settled = error == 0 or (len(lows) == top and error < lows[-1])
    if settled:
        wanted = summary.where(F.col("low") + error >= (lows[-1] if len(lows) == top else 0)).select("value")
        if fits_broadcast(wanted, 64 << 20):
            counted = counted.join(F.broadcast(wanted), F.col("_key").eqNullSafe(F.col("value")), "left_semi")
    exact = counted.groupBy("_key").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "_key").limit(top)
    return exact.select(F.col("_key").alias(key), "count", (F.col("count") / rows).alias("share"))
