"""Unusual days of daily series, by a robust seasonal decomposition per key.

A daily value is trend plus weekly season plus remainder. Trend is a centred moving median over three
periods, which neither an unusual day nor the ends of the series pull along, season the median of what is left per day of the period, and a day is unusual if its remainder
lies far from the median remainder, in units of the median absolute deviation. Medians are exact:
a key holds at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns a median absolute deviation into the standard deviation of a normal distribution.
MAD_SCALE = 1.4826


def decompose(daily: DataFrame, keys: Sequence[str] = (), date: str = "date", value: str = "value", period: int = 7) -> DataFrame:
    """Add ``trend``, ``seasonal`` and ``remainder`` to a series with one row per key and day.

    ``daily`` has no gaps (``series.calendar_fill``). The moving median takes the days there are near
    both ends. Season medians are centred so that they add nothing on average. All steps share the keys'
    partitioning: one shuffle.
    """
    if period < 2:
        raise ValueError(f"a period has at least two days, not {period}")
    whole = Window.partitionBy(*keys)
    near = whole.orderBy(date).rowsBetween(-(3 * period // 2), 3 * period // 2)
    phase = F.pmod(F.datediff(F.col(date), F.lit("1970-01-05").cast("date")), F.lit(period))
    found = daily.withColumns({"_near": F.sort_array(F.collect_list(F.col(value).cast("double")).over(near)), "_phase": phase})
    middle = F.get("_near", F.floor((F.size("_near") - 1) / 2).cast("int")) + F.get("_near", F.floor(F.size("_near") / 2).cast("int"))
    found = found.withColumn("trend", middle / 2).drop("_near")
    found = found.withColumn("_left", F.col(value) - F.col("trend"))
    found = found.withColumn("_seasons", F.array(*(F.median(F.when(F.col("_phase") == k, F.col("_left"))).over(whole) for k in range(period))))
    there = F.filter("_seasons", lambda s: s.isNotNull())
    mean = F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, s: a + s), F.size(there))
    found = found.withColumn("seasonal", F.get("_seasons", F.col("_phase")) - mean)
    return found.withColumn("remainder", F.col("_left") - F.col("seasonal")).drop("_phase", "_left", "_seasons")


def flag_anomalies(decomposed: DataFrame, keys: Sequence[str] = (), least: float = 3.5) -> DataFrame:
    """Add ``score``, the robust z-value of the remainder, and ``is_anomaly`` where it is beyond ``least``.

    Where more than half of a key's remainders are equal the deviation is 0: the score is null, and any
    other remainder is an anomaly. Remainders below a billionth of the key's largest value are rounding.
    """
    whole = Window.partitionBy(*keys)
    off = decomposed.withColumn("_off", F.abs(F.col("remainder") - F.median("remainder").over(whole)))
    off = off.withColumns({"_mad": F.median("_off").over(whole), "_least": 1e-9 * F.max(F.abs("trend")).over(whole)})
    flat = F.col("_mad") <= F.col("_least")
    score = F.when(~flat, F.col("_off") / (MAD_SCALE * F.col("_mad")))
    flagged = F.coalesce(F.when(flat, F.col("_off") > F.col("_least")).otherwise(score > least), F.lit(False))
    return off.withColumns({"score": score, "is_anomaly": flagged}).drop("_off", "_mad", "_least")


def anomaly_alerts(flagged: DataFrame, keys: Sequence[str], date: str = "date", max_days: int = 0) -> DataFrame:
    """Per key: days, unusual days, the last and the most unusual one, and ``alert`` if there are more than ``max_days``."""
    bad = F.col("is_anomaly")
    worst = F.max(F.when(bad, F.struct(F.coalesce("score", F.lit(float("inf"))).alias("score"), F.col(date).alias("day"))))
    return (
        flagged.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("days"), F.count_if(bad).alias("anomalies"), F.max(F.when(bad, F.col(date))).alias("last_anomaly"), worst.alias("_worst"))
        .withColumns({"worst_day": F.col("_worst.day"), "alert": F.col("anomalies") > max_days})
        .drop("_worst")
    )
