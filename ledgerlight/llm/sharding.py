"""Two-pass external shuffle into shards.

Pass one scatters records over buckets of a stated size by a seeded hash of the record. Pass two
sorts a task's records by bucket and into an order that does not depend on how they arrived, reads one
bucket after the other and shuffles it with Fisher and Yates' algorithm. Bucket after bucket, the
shuffled records have a position in one random order of the whole table; position p goes to slot
p // shards of shard p % shards, so the shards' row counts differ by one at most.

Bucket counts are taken from the hash column before any text moves, so a record moves once. A bucket's
first position, the running sum of the counts before it, travels as a row of its own that sorts
before the bucket's records, so neither the driver nor a task holds a number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators.running import Ordered

LAW = "rows"


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniformly random order of 0 .. n-1: each place swaps with itself or an earlier one."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else []):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle_shards(
    docs: DataFrame, shards: int = 8, seed: int = 20240501, bucket_bytes: int = 8 << 20, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows (doc_id, text, other columns) with ``size``, ``bucket``, ``shard`` and ``slot``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1. Input columns named like an output are
    replaced. Equal seeds give equal results for equal rows, however they are partitioned; rows that
    are equal in ID and text share a bucket, in the order of their other columns. No rows give no rows.
    """
    other = [c for c in docs.columns if c.lower() not in {"size", "bucket", "shard", "slot", "_a", "_b", "_first"}]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    rows = docs.select(*other, size.alias("size"), F.xxhash64(F.lit(seed), doc_id, text).alias("_a"), F.xxhash64(F.lit(seed + 1), text, doc_id).alias("_b"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod("_a", F.lit(buckets)).cast("bigint"))
    counts = Ordered(rows.groupBy("bucket").agg(F.count("*").alias("n")), ["bucket"]).with_columns(running={"upto": ("sum", "n")})
    heads = counts.select("bucket", (F.col("upto") - F.col("n")).alias("_first"))
    schema = T.StructType([*docs.select(*other).schema.fields, *(T.StructField(n, t) for n, t in (("size", T.LongType()), ("bucket", T.LongType()), ("shard", T.IntegerType()), ("slot", T.LongType())))])

    def shuffled(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.Table.from_batches(pieces)
        first, bucket = one.column("_first")[0].as_py(), one.column("bucket")[0].as_py()
        one = one.slice(1).take(pa.array(fisher_yates(one.num_rows - 1, seed * 1_000_003 + bucket)))
        place = np.arange(one.num_rows, dtype=np.int64) + first
        out = one.drop_columns(["_a", "_b", "_first"])
        out = out.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))
        yield from out.to_batches(max_chunksize=2_000)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            which = batch.column("bucket").to_numpy()
            edges = np.r_[0, np.flatnonzero(which[1:] != which[:-1]) + 1, len(which)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == b:
                    continue
                if held and held[0].column("bucket")[0].as_py() != which[a]:
                    yield from shuffled(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from shuffled(held)

    both = rows.unionByName(heads, allowMissingColumns=True)
    ties = [f.name for f in docs.select(*other).schema.fields if f.name not in (doc_id, text) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = ["bucket", F.col("_first").asc_nulls_last(), "_a", "_b", *(f"`{c}`" for c in ties)]
    return both.repartition(buckets, "bucket").sortWithinPartitions(*order).mapInArrow(shuffle, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; within a shard, files hold consecutive buckets in slot order."""
    shuffled.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
