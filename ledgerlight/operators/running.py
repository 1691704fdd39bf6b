"""Row numbers, running aggregates and lags over a whole table in one order.

A window without a key sends all rows to one task. Here the table is dealt by ranges of the order,
sorted within its partitions and stored with each row's partition and position. Windows then run per
partition, and what a partition needs from those before it is one small row: how many rows they hold,
their sums and extremes, and their last few rows. The driver sees one such row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.staging import stage

_PART, _AT = "_part", "_at"
_LOCAL_BITS = 33  # of monotonically_increasing_id
_MERGE = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": min, "max": max}


class Ordered:
    """A stored table in one order: ``by`` ascending, nulls first, ties by all other columns that have an order.

    Equal rows may be dealt to different partitions, so no value of the order is too frequent.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], partitions: int | None = None):
        taken = {_PART, _AT} & set(df.columns)
        if taken:
            raise ValueError(f"columns {sorted(taken)} are taken")
        ties = [f.name for f in df.schema.fields if f.name not in by and not isinstance(f.dataType, (T.MapType, T.VariantType, T.BinaryType))]
        keys = [*by, *ties]
        salted = df.withColumn("_salt", F.monotonically_increasing_id())
        dealt = salted.repartitionByRange(partitions, *keys, "_salt") if partitions else salted.repartitionByRange(*keys, "_salt")
        row = F.monotonically_increasing_id()
        numbered = dealt.sortWithinPartitions(*keys, "_salt").drop("_salt").withColumn("_row", row)
        place = [F.shiftright("_row", _LOCAL_BITS).cast("int").alias(_PART), F.col("_row").bitwiseAND((1 << _LOCAL_BITS) - 1).alias(_AT)]
        self.columns = df.columns
        self.rows = stage(numbered.select(*df.columns, *place), "ordered")
        self.sizes = {r[0]: r[1] for r in self.rows.groupBy(_PART).agg(F.count(F.lit(1))).collect()}

    @property
    def total(self) -> int:
        return sum(self.sizes.values())

    def _carried(self, running: Mapping[str, tuple[str, str]]) -> DataFrame:
        """Per partition: rows before it and the aggregates of those rows."""
        fields = [T.StructField(_PART, T.IntegerType()), T.StructField("_before", T.LongType())]
        found = {}
        if running:
            aggs = [getattr(F, kind)(col).alias(name) for name, (kind, col) in running.items()]
            per_part = self.rows.groupBy(_PART).agg(*aggs)
            fields += [T.StructField(f"_carry_{n}", per_part.schema[n].dataType) for n in running]
            found = {r[_PART]: r for r in per_part.collect()}
        rows, before, carry = [], 0, dict.fromkeys(running)
        for part in sorted(self.sizes):
            rows.append((part, before, *(carry[n] for n in running)))
            before += self.sizes[part]
            for n, (kind, _) in running.items():
                new = found[part][n]
                carry[n] = new if carry[n] is None else carry[n] if new is None else _MERGE[kind](carry[n], new)
        return self.rows.sparkSession.createDataFrame(rows, T.StructType(fields))

    def with_columns(
        self, place: str | None = None, running: Mapping[str, tuple[str, str]] | None = None, shifts: Mapping[str, tuple[str, int]] | None = None
    ) -> DataFrame:
        """The table with new columns.

        ``place``: the row number from 1. ``running``: name to (``sum``, ``count``, ``min`` or ``max``,
        column) over all rows up to this one; nulls are passed over. ``shifts``: name to (column, n), the
        value n rows earlier, or later for a negative n; null where there is no such row.
        """
        running, shifts = dict(running or {}), dict(shifts or {})
        along = Window.partitionBy(_PART).orderBy(_AT)
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = self.rows.withColumns(
            {n: getattr(F, kind)(col).over(upto) for n, (kind, col) in running.items()}
            | {n: (F.lag(col, k) if k >= 0 else F.lead(col, -k)).over(along) for n, (col, k) in shifts.items()}
        )
        # One row per partition: as many as the shuffle has partitions.
        found = found.join(F.broadcast(self._carried(running)), _PART)
        for n, (kind, _) in running.items():
            own, carry = F.col(n), F.col(f"_carry_{n}")
            both = {"sum": F.coalesce(own + carry, own, carry), "count": own + F.coalesce(carry, F.lit(0)), "min": F.least(own, carry), "max": F.greatest(own, carry)}
            found = found.withColumn(n, both[kind].cast(found.schema[n].dataType))
        number = F.col("_before") + F.col(_AT)
        found = found.withColumn("_number", number)
        if shifts:
            found = self._across(found, shifts)
        kept = [F.col(f"`{c}`") for c in self.columns]
        extra = [(F.col("_number") + 1).alias(place)] if place else []
        return found.select(*kept, *extra, *running, *shifts)

    def _across(self, found: DataFrame, shifts: Mapping[str, tuple[str, int]]) -> DataFrame:
        """Fill the shifts that reach into another partition from the rows next to its border."""
        far = max(abs(k) for _, k in shifts.values())
        parts = sorted(self.sizes)
        firsts = accumulate((self.sizes[p] for p in parts), initial=0)
        sizes = self.rows.sparkSession.createDataFrame([(p, self.sizes[p], first) for p, first in zip(parts, firsts)], f"{_PART} int, _size long, _first long")
        near_border = self.rows.join(F.broadcast(sizes), _PART).where((F.col(_AT) < far) | (F.col(_AT) >= F.col("_size") - far))
        border = stage(near_border.select((F.col("_first") + F.col(_AT)).alias("_target"), *{c: F.col(f"`{c}`").alias(f"_from_{c}") for c, _ in shifts.values()}.values()), "borders")
        found = found.join(F.broadcast(sizes.select(_PART, "_size")), _PART)
        for n, (col, k) in shifts.items():
            outside = (F.col(_AT) < k) if k >= 0 else (F.col(_AT) >= F.col("_size") + k)
            # At most 2 * far rows per partition.
            side = border.select(F.col("_target"), F.col(f"_from_{col}").alias("_value"))
            found = found.withColumn("_target", F.when(outside, F.col("_number") - k)).join(F.broadcast(side), "_target", "left")
            found = found.withColumn(n, F.when(outside, F.col("_value")).otherwise(F.col(n))).drop("_target", "_value")
        return found


def first_share(df: DataFrame, by: Sequence[str], frac: float = 0.8, name: str = "is_train", partitions: int | None = None) -> DataFrame:
    """Mark the first ``floor(n * frac)`` rows of the whole table in the order ``by``."""
    ordered = Ordered(df, by, partitions)
    return ordered.with_columns(place="_place").withColumn(name, F.col("_place") <= int(ordered.total * frac)).drop("_place")


def shifted(df: DataFrame, by: Sequence[str], col: str, ns: Mapping[str, int], partitions: int | None = None) -> DataFrame:
    """Values of ``col`` n rows earlier (later for a negative n) in the order ``by``, by new column name."""
    return Ordered(df, by, partitions).with_columns(shifts={name: (col, n) for name, n in ns.items()})


def changes(df: DataFrame, by: Sequence[str], col: str, name: str = "diff") -> DataFrame:
    """Change of ``col`` against the previous row of the table; null on the first."""
    return shifted(df, by, col, {"_previous": 1}).withColumn(name, F.col(col) - F.col("_previous")).drop("_previous")
