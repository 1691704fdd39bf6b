"""Numbers for the values of category columns, however many there are.

The dictionary is a table: distinct values in ascending order, numbered over ranges of that order. It
never reaches the driver. Rows take their number by a join whose form follows from the dictionary's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.staging import stage
from ledgerlight.operators.joins import fits_broadcast
from ledgerlight.operators.running import Ordered


def category_dictionary(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """(value, index, rows): the distinct non-null values of ``col``, numbered from 0 in ascending order."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    numbered = Ordered(counts, ["value"], partitions).with_columns(place="_place")
    return stage(numbered.select("value", (F.col("_place") - 1).alias("index"), "rows"), "dictionary")


def encode(df: DataFrame, dictionary: DataFrame, col: str, name: str | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """Add the index of ``col`` as ``name`` (``<col>_idx``); unseen and null values get the next free number.

    A dictionary of at most ``max_bytes`` goes to every executor. A larger one is merged: both sides
    are plain shuffles, so adaptive execution splits the rows of a value that holds very many.
    """
    known = dictionary.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
    unseen = (dictionary.agg(F.max("index")).first()[0] if dictionary.head(1) else -1) + 1
    side = F.broadcast(known) if fits_broadcast(known, max_bytes) else known.hint("merge")
    found = df.join(side, F.col(col) == F.col("_value"), "left")
    return found.withColumn(name or f"{col}_idx", F.coalesce("_index", F.lit(unseen))).drop("_value", "_index")
