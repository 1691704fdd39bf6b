"""Samples and splits that depend on the rows, not on how they are partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.columns import hash_bucket

_RANGE = 2**32
_STEPS = 2**16


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Spark's own sample without replacement; changes when the partitioning does."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_fraction(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose key hash falls into the first ``fraction`` of the hash range."""
    return df.filter(hash_bucket(key, seed) < int(fraction * _RANGE))


def hash_split(
    df: DataFrame, key: Sequence[str], frac: float = 0.8, seed: int = 42, name: str = "is_train"
) -> DataFrame:
    """Mark about ``frac`` of the keys as training rows.

    All rows of a key fall on the same side. No shuffle.
    """
    return df.withColumn(name, hash_bucket(key, seed) < int(frac * _RANGE))


def split(df: DataFrame, key: Sequence[str], frac: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``hash_split`` as two frames."""
    marked = hash_split(df, key, frac, seed, "_train")
    return marked.filter("_train").drop("_train"), marked.filter("NOT _train").drop("_train")


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the smallest key hash, in no particular order.

    ``key`` should identify a row; rows with equal hashes are ordered by the key.

    A plain ``orderBy(hash).limit(n)`` sends ``n`` rows of every input partition to one task. Here
    a count per hash range (65,536 rows at most) finds the range that holds the n-th row. Only the
    rows of that range are sorted: those of all smaller ranges belong to the sample as they are.
    """
    hashed = df.withColumn("_hash", hash_bucket(key, seed))
    step = F.floor(F.col("_hash") / (_RANGE // _STEPS))
    counts = hashed.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    # No partition: at most 65,536 rows.
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("step")))
    last = upto.filter(F.col("upto") >= n).orderBy("step").first()
    if last is None:
        return df
    below = hashed.filter(step < last["step"])
    rest = hashed.filter(step == last["step"]).orderBy("_hash", *key).limit(n - (last["upto"] - last["n"]))
    return below.unionByName(rest).drop("_hash")
