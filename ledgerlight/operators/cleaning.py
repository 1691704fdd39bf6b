"""Row cleaning for order tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.columns import numeric_columns
from ledgerlight.functions.staging import stage
from ledgerlight.operators.quantiles import iqr_filter


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns; names that are absent are ignored."""
    return df.drop(*cols)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Return ``df``, or raise an error that names the missing columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of ``cols`` (default: any column)."""
    return df.dropna(subset=list(cols) if cols else None)


def fill_missing(df: DataFrame, defaults: Mapping[str, object] | float = 0) -> DataFrame:
    """Fill nulls, per column from a mapping or in every numeric column with one number."""
    if isinstance(defaults, Mapping):
        return df.fillna({c: v for c, v in defaults.items() if c in df.columns})
    return df.fillna(defaults, subset=numeric_columns(df))


def range_filter(df: DataFrame, col: str, low, high) -> DataFrame:
    """Rows with ``low <= col <= high``; nulls are dropped."""
    return df.filter(F.col(col).between(low, high))


def equals_filter(df: DataFrame, col: str, value) -> DataFrame:
    """Rows whose ``col`` equals ``value``."""
    return df.filter(F.col(col) == value)


def mask(df: DataFrame, condition: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Keep every row, but null all columns where ``condition`` is not true.

    Columns in ``keep`` are left as they are.
    """
    return df.select(
        *[F.col(c) if c in keep else F.when(condition, F.col(c)).alias(c) for c in df.columns]
    )


def absolute(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.abs(F.col(col)))


def clamp_min(df: DataFrame, col: str, low) -> DataFrame:
    """Raise values below ``low`` to ``low``; null stays null."""
    c = F.col(col)
    bound = F.lit(low).cast(df.schema[col].dataType)
    return df.withColumn(col, F.when(c < bound, bound).otherwise(c))


def parse_date(df: DataFrame, col: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Text to date; null where the text does not fit. Dates and timestamps lose their time."""
    c = F.col(col)
    if not isinstance(df.schema[col].dataType, T.StringType):
        parsed = c.cast("date")
    elif fmt == "yyyy-MM-dd":
        # The same dates as try_to_date, by Spark's faster parser of this one format.
        parsed = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
    else:
        parsed = F.try_to_date(c, fmt)
    return df.withColumn(col, parsed)


def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """One row per key: the first by ``order_by``, by default every other column.

    ``row_number() = 1`` lets Spark keep one row per key in each input partition before the
    shuffle, so a key that holds a third of all rows sends one row per partition.
    """
    if order_by is None:
        order_by = [c for c in df.columns if c not in keys]
    if not order_by:
        return df.select(*keys).distinct()
    first = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, missing) from one pass."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols]))
    )


@dataclass(frozen=True)
class OrderRules:
    """Names and defaults for :func:`clean_orders`. The values shown are those of the order table."""

    key: str = "OrderID"
    date: str = "OrderDate"
    amount: str = "TotalAmount"
    quantity: str = "Quantity"
    date_format: str = "yyyy-MM-dd"
    min_quantity: int = 1
    drop: tuple[str, ...] = ("CustomerID", "ProductID")
    defaults: Mapping[str, object] = field(
        default_factory=lambda: {"Discount": 0.0, "Tax": 0.0, "ShippingCost": 0.0}
    )
    iqr_factor: float | None = 1.5
    rel_err: float | None = None


def normalise_orders(df: DataFrame, rules: OrderRules = OrderRules()) -> DataFrame:
    """Column pruning, parsing, sign and lower-bound repair and defaults; no rows are removed."""
    df = parse_date(df.drop(*rules.drop), rules.date, rules.date_format)
    if rules.defaults:
        # Before the clamp: a default of 0 for the quantity must not escape it.
        df = fill_missing(df, rules.defaults)
    return clamp_min(absolute(df, rules.amount), rules.quantity, rules.min_quantity)


def unique_orders(df: DataFrame, rules: OrderRules = OrderRules()) -> DataFrame:
    """Normalised orders that have key, date and amount, one row per key.

    Rows are checked after parsing, so that a date that cannot be read does not come back as
    null, and before the deduplication, so that a broken copy never displaces a good one and
    fewer rows are shuffled.
    """
    normal = normalise_orders(df, rules).dropna(subset=[rules.key, rules.date, rules.amount])
    return dedup(normal, [rules.key])


def clean_orders(
    df: DataFrame, rules: OrderRules = OrderRules(), shape: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The cleaned order table: :func:`unique_orders` without IQR outliers in the amount.

    The deduplicated rows are written once to the shared folder. The quantile passes then read
    one column of that copy and the outlier bounds are pushed down to its scan; the shuffle runs
    once however many passes follow. ``shape`` is applied before the rows are written: a caller that
    reads them several times stores what it needs of them, computed once. It keeps every row and the amount.
    """
    unique = unique_orders(df, rules)
    unique = shape(unique) if shape else unique
    if rules.iqr_factor is None:
        return unique
    return iqr_filter(stage(unique, "orders"), rules.amount, rules.iqr_factor, rules.rel_err)


def cleaning_report(raw: DataFrame, rules: OrderRules = OrderRules()) -> DataFrame:
    """One row: rows in, rejected for a missing key, date or amount, duplicates, repaired, kept.

    Every count comes from one scan and one grouping by key; IQR outliers are not included.
    """
    before = raw.withColumn("_low", F.col(rules.quantity) < rules.min_quantity).withColumn(
        "_negative", F.col(rules.amount) < 0
    )
    normal = normalise_orders(before, rules)
    valid = F.col(rules.key).isNotNull() & F.col(rules.date).isNotNull() & F.col(rules.amount).isNotNull()
    per_key = (
        normal.groupBy(rules.key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(valid).alias("valid"),
            F.count_if(F.coalesce(F.col("_negative"), F.lit(False))).alias("negative"),
            F.count_if(F.coalesce(F.col("_low"), F.lit(False))).alias("low"),
        )
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return per_key.agg(
        total(F.col("n")).alias("rows_in"),
        total(F.col("n") - F.col("valid")).alias("rejected"),
        total(F.greatest(F.col("valid") - 1, F.lit(0))).alias("duplicates"),
        total(F.col("negative")).alias("negative_amounts"),
        total(F.col("low")).alias("low_quantities"),
        F.count_if(F.col("valid") > 0).alias("rows_out"),
    )


