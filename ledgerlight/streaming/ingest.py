"""Incremental ingestion: new order files are cleaned and added to the order table as they arrive.

The batch functions run unchanged on each batch of files. An order counts as new when its ID is not
in the table yet. That check keeps no state in the stream, loses no late order, and makes a batch
that is repeated after a failure add nothing twice. Outlier bounds need the whole table, so the
stream takes bounds computed on the cleaned history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.operators.cleaning import OrderRules, unique_orders
from ledgerlight.sources.schemas import ORDERS


def order_stream(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = ORDERS, max_files: int = 1000
) -> DataFrame:
    """New files under ``path`` as a stream of raw orders.

    A stream takes CSV columns by position; a file whose header has other names, or another order,
    stops it instead of being read into the wrong columns.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.options(header=True, enforceSchema=False).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def new_orders(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``table``.

    Only the key column of the table is read. It is cut down to the keys of the batch first, so a
    batch that is small enough to broadcast needs no shuffle of the table.
    """
    seen = table.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(seen, key, "left_anti")


def clean_batch(
    batch: DataFrame, rules: OrderRules = OrderRules(), bounds: tuple[float, float] | None = None
) -> DataFrame:
    """Unique, repaired orders of one batch, within the given amount bounds if there are any."""
    clean = unique_orders(batch, rules)
    return clean if bounds is None else clean.filter(F.col(rules.amount).between(*bounds))


def start_ingest(
    orders: DataFrame,
    path: str,
    checkpoint: str,
    rules: OrderRules = OrderRules(),
    bounds: tuple[float, float] | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Clean each batch of the stream and append its new orders to the Parquet table at ``path``.

    ``once`` takes in what is there and stops, for a scheduled job. The checkpoint folder holds
    which files were read, so a restarted job skips none.
    """
    spark = orders.sparkSession
    schema = clean_batch(spark.createDataFrame([], orders.schema), rules, bounds).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)

    def append(batch: DataFrame, _: int) -> None:
        table = batch.sparkSession.read.schema(schema).parquet(path)
        new_orders(clean_batch(batch, rules, bounds), table, rules.key).write.mode("append").parquet(path)

    writer = orders.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
