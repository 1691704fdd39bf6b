"""Joins of a large fact table with a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive_dimension(df: DataFrame, key: str, **attributes) -> DataFrame:
    """The distinct values of ``key`` with constant attributes."""
    dim = df.select(key).distinct()
    return dim.withColumns({n: v if isinstance(v, Column) else F.lit(v) for n, v in attributes.items()})


def join_merge(fact: DataFrame, dim: DataFrame, on: str, salts: int = 1) -> DataFrame:
    """Inner join by sorting and merging both sides, for a dimension of any size.

    ``salts`` splits every key of the fact table into that many parts and repeats each dimension
    row for all of them. Use it when the key has few values or one holds much of the table: 25
    states would otherwise mean 25 tasks.
    """
    if salts <= 1:
        return fact.join(dim.hint("merge"), on)
    # The salt depends on the row and its input partition only, so a retried task sends each row
    # to the same place; the partition number spreads rows that are copies of each other.
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *fact.columns), F.lit(salts)).cast("int")
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return fact.withColumn("_salt", spread).join(copies.hint("merge"), [on, "_salt"]).drop("_salt")


def fits_broadcast(dim: DataFrame, max_bytes: int) -> bool:
    """Whether the rows of ``dim``, written as text, take at most ``max_bytes`` bytes."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dim.columns])))
    return (dim.agg(F.sum(size)).first()[0] or 0) <= max_bytes


def join_broadcast(fact: DataFrame, dim: DataFrame, on: str, max_bytes: int = 64 << 20, salts: int = 32) -> DataFrame:
    """Inner join that sends ``dim`` to every executor, after a check of its size in bytes.

    A larger dimension is joined by :func:`join_merge` instead; both give the same rows. The check
    reads the dimension once more, so pass a stored table, not a long derivation.
    """
    if fits_broadcast(dim, max_bytes):
        return fact.join(F.broadcast(dim), on)
    return join_merge(fact, dim, on, salts)
