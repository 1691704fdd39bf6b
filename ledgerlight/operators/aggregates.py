"""Grouped totals, period roll-ups, key-value summaries and top-k reports.

All of them are declarative aggregates: Spark adds up each input partition before the shuffle,
so the shuffle carries at most one row per key and partition and a hot key costs nothing extra.
Report totals over all rows come from a scalar subquery, not from a window without partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.columns import period_label
from ledgerlight.functions.sums import SCALE, exact_average, exact_sum


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def top_rows(df: DataFrame, by: str, ties: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows with the largest ``by``; equal values are ordered by ``ties``."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def first_rows(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows in an explicit order, for inspection; a frame has no order of its own."""
    return df.orderBy(*order_by).limit(n)


def revenue_by(
    df: DataFrame,
    keys: str | Sequence[str],
    measure: str = "TotalAmount",
    name: str = "revenue",
    order: str | None = "desc",
    top: int | None = None,
    scale: int | None = SCALE,
) -> DataFrame:
    """Sum of ``measure`` per key, ordered by it or, with ``top``, only the largest ones."""
    keys = _names(keys)
    totals = df.groupBy(*keys).agg(exact_sum(measure, scale).alias(name))
    if top is not None:
        return top_rows(totals, name, keys, top)
    if order is None:
        return totals
    return totals.orderBy(F.desc(name) if order == "desc" else F.asc(name), *keys)


def category_performance(
    df: DataFrame, key: str = "Category", measure: str = "TotalAmount", count: str = "OrderID"
) -> DataFrame:
    """Revenue, number of orders and average order value per category, best first."""
    return (
        df.groupBy(key)
        .agg(
            exact_sum(measure).alias("total_revenue"),
            F.count(count).alias("order_count"),
            exact_average(measure).alias("avg_order_value"),
        )
        .orderBy(F.desc("total_revenue"), key)
    )


def _by_period(df: DataFrame, date: str, period: str, separator: str, label: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates per period, in order of the label.

    Rows are grouped by the first day of their period (or the quarter's number). The text label is
    made once per group, not once per row.
    """
    day = F.col(date).cast("date")
    if period == "quarter":
        key, text = F.quarter(day), F.concat(F.lit("Q"), F.col("_period").cast("string"))
    else:
        text = period_label("_period", period, separator)
        key = F.trunc(day, "month" if period == "month" else "quarter")
    grouped = df.groupBy(key.alias("_period")).agg(*[c.alias(n) for n, c in aggs.items()])
    return grouped.orderBy("_period").select(text.alias(label), *aggs)


def revenue_by_period(
    df: DataFrame,
    date: str = "OrderDate",
    measure: str = "TotalAmount",
    period: str = "month",
    separator: str = " ",
    label: str = "period",
) -> DataFrame:
    """Revenue per ``month``, ``year_quarter`` or ``quarter``, in order of the label."""
    return _by_period(df, date, period, separator, label, {"revenue": exact_sum(measure)})


def period_stats(df: DataFrame, ts: str, measure: str, period: str = "month", label: str = "month_year") -> DataFrame:
    """Count, sum, minimum, maximum and mean of ``measure`` per period."""
    aggs = {
        "record_count": F.count(measure),
        "total_price": exact_sum(measure),
        "min_price": F.min(measure),
        "max_price": F.max(measure),
        "avg_price": exact_average(measure),
    }
    return _by_period(df, ts, period, " ", label, aggs)


def daily_totals(
    df: DataFrame,
    date: str = "OrderDate",
    measure: str = "TotalAmount",
    keys: Sequence[str] = (),
    name: str = "value",
    scale: int | None = SCALE,
) -> DataFrame:
    """One row per key and day with the sum of ``measure``."""
    return df.groupBy(*keys, F.col(date).cast("date").alias("date")).agg(exact_sum(measure, scale).alias(name))


def daily_demand(
    df: DataFrame,
    keys: Sequence[str] = ("ProductID", "State"),
    date: str = "OrderDate",
    quantity: str = "Quantity",
    amount: str = "TotalAmount",
) -> DataFrame:
    """Quantity and sales per day and key."""
    return df.groupBy(F.col(date).alias("order_date"), *keys).agg(
        F.sum(quantity).alias("daily_quantity"), exact_sum(amount).alias("daily_total_sales")
    )


def key_totals(df: DataFrame, key: str, value: str, factor: float = 1.0) -> DataFrame:
    """Total per key, times ``factor`` (1.1 for a ten per cent uplift), in key order."""
    total = exact_sum(value)
    return df.groupBy(key).agg((total if factor == 1.0 else total * F.lit(factor)).alias("total")).orderBy(key)


def key_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """All values of each key as (key, value, copies).

    The same bag of values as a list per key, but no task ever holds the list of one key.
    """
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("copies"))


def key_ranges(df: DataFrame, key: str, value: str) -> DataFrame:
    """Number of values, smallest and largest value per key."""
    return (
        df.groupBy(key)
        .agg(F.count(value).alias("entries"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
        .orderBy(key)
    )


def key_counts(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Rows per key, most frequent first; ``top`` limits the report."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), key) if top is None else top_rows(counts, "count", [key], top)


def key_averages(df: DataFrame, key: str, value: str, digits: int = 2) -> DataFrame:
    """Average per key, rounded half up."""
    return df.groupBy(key).agg(F.round(exact_average(value), digits).alias("average")).orderBy(key)


def key_partials(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total, count): partial results that can be stored, united and merged later."""
    return df.groupBy(key).agg(
        exact_sum(value).alias("total"), F.count(value).alias("count")
    )


def merge_partials(partials: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Averages per key from the union of any number of :func:`key_partials`."""
    total = F.sum("total").cast("double")
    return (
        partials.groupBy(key).agg(F.round(F.try_divide(total, F.sum("count")), digits).alias("average")).orderBy(key)
    )


def share(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: rows, matching rows and their percentage."""
    hits = F.count_if(F.coalesce(predicate, F.lit(False)))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        hits.alias("matching"),
        F.try_divide(F.lit(100.0) * hits, F.count(F.lit(1))).alias("percentage"),
    )


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage of each value, nulls left out, most frequent first."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percentage", F.lit(100.0) * F.col("count") / total).orderBy(F.desc("count"), col)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count) for several text columns from one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("column", F.desc("count"), "value")
    )


def bag_union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, duplicates kept, columns matched by name."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, of all columns or the given ones."""
    return (df.select(*cols) if cols else df).distinct()
