"""Data quality, model metrics, drift and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality_report(df: DataFrame, rules: Mapping[str, Column], max_share: float = 0.0) -> DataFrame:
    """One row per rule: rows, violations, their share, and whether the share is acceptable.

    ``rules`` maps a name to a condition that is true for a bad row. All rules are counted in
    one pass; a condition that is null does not count as a violation.
    """
    names = list(rules)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.coalesce(rules[n], F.lit(False))).alias(f"v{i}") for i, n in enumerate(names)],
    )
    rows = [F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(names)]
    share = F.coalesce(F.try_divide(F.col("violations"), F.col("rows")), F.lit(0.0))
    return (
        counts.select("rows", F.inline(F.array(*rows)))
        .select("rule", "rows", "violations", share.alias("share"))
        .withColumn("passed", F.col("share") <= max_share)
    )


def missing_rules(cols: Sequence[str]) -> dict[str, Column]:
    """A rule per column that finds its nulls."""
    return {f"{c} missing": F.col(c).isNull() for c in cols}


def range_rules(ranges: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    """A rule per column that finds values outside its range."""
    return {f"{c} out of range": ~F.col(c).between(low, high) for c, (low, high) in ranges.items()}


def type_rules(types: Mapping[str, str]) -> dict[str, Column]:
    """A rule per text column that finds values that cannot be read as its type."""
    return {
        f"{c} not {kind}": F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull() for c, kind in types.items()
    }


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """rows, rmse, mse, mae and r2 of a prediction, overall or per group.

    r2 is 0 where the label does not vary. One pass, without collecting rows: the spread of the
    label is the population variance times the number of rows.
    """
    y = F.col(label).cast("double")
    e = F.col(prediction).cast("double") - y
    valid = df.filter(e.isNotNull())
    spread = F.var_pop(y) * F.count(F.lit(1))
    metrics = [
        F.count(F.lit(1)).alias("rows"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(F.count(F.lit(1)) > 0, F.coalesce(F.lit(1.0) - F.try_divide(F.sum(e * e), spread), F.lit(0.0))).alias("r2"),
    ]
    return valid.groupBy(*by).agg(*metrics) if by else valid.agg(*metrics)


def model_health(metrics: DataFrame, max_rmse: float = 1000.0) -> DataFrame:
    """Add ``status`` (HEALTHY below ``max_rmse``, else DEGRADED) and ``action_required``."""
    healthy = F.coalesce(F.col("rmse") < max_rmse, F.lit(False))
    return metrics.withColumns(
        {"status": F.when(healthy, "HEALTHY").otherwise("DEGRADED"), "action_required": ~healthy}
    )


def drift(metrics: DataFrame, period: str, metric: str = "rmse") -> DataFrame:
    """Metric per period with its change against the first and the previous period.

    ``metrics`` holds one row per period, so the window without partition stays small.
    """
    order = Window.orderBy(period)
    first = F.first(metric).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    previous = F.lag(metric).over(order)
    return metrics.withColumns(
        {
            "baseline": first,
            "change_from_baseline": F.try_divide(F.col(metric) - first, first),
            "change_from_previous": F.try_divide(F.col(metric) - previous, previous),
        }
    )


def alerts(drifted: DataFrame, max_change: float = 0.1, worse: str = "higher") -> DataFrame:
    """Add ``alert``: the metric is worse than its baseline by more than ``max_change``.

    ``worse`` says which way that is: ``higher`` for errors, ``lower`` for r2.
    """
    if worse not in ("higher", "lower"):
        raise ValueError(f"worse is higher or lower, not {worse!r}")
    change = F.col("change_from_baseline")
    return drifted.withColumn("alert", F.coalesce((change if worse == "higher" else -change) > max_change, F.lit(False)))
