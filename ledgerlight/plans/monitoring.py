"""Prediction metrics, model health, drift, data quality and partition layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions.columns import period_label
from ledgerlight.operators import quality
from ledgerlight.operators.partitioning import partition_counts, partition_report
from ledgerlight.plans.sql import RAW, SALES
from ledgerlight.sources.sales import raw_orders, sales_view, table

# A fixed formula stands in for a model, so that metrics can be compared with SQL.
_PREDICTION = "Quantity * UnitPrice * (1.0D - Discount)"


def _scored(spark, sf):
    cols = ["OrderDate", "Quantity", "UnitPrice", "Discount", "TotalAmount", "PaymentMethod"]
    return sales_view(spark, sf, cols).withColumn("prediction", F.expr(_PREDICTION))


def _rounded(df):
    digits = {"rmse": 6, "mse": 2, "mae": 6, "r2": 9, "baseline": 6}
    changes = {"change_from_baseline": 9, "change_from_previous": 9}
    return df.withColumns({c: F.round(c, d) for c, d in (digits | changes).items() if c in df.columns})


def _drift(spark, sf, metric="rmse"):
    scored = _scored(spark, sf).withColumn("month", F.trunc("OrderDate", "month"))
    metrics = quality.regression_metrics(scored, "TotalAmount", "prediction", ["month"])
    return quality.drift(metrics.select(period_label("month", "month").alias("month"), "rows", metric), "month", metric)


def _quality(spark, sf):
    rules = {
        **quality.missing_rules(["TotalAmount", "Quantity", "Discount"]),
        **quality.range_rules({"TotalAmount": (0, 1e9), "Quantity": (1, 1000), "Discount": (0, 1)}),
        "OrderDate not date": F.try_to_date("OrderDate", "yyyy-MM-dd").isNull(),
    }
    return quality.quality_report(raw_orders(spark, sf), rules, max_share=0.06)


def _partition_report(spark, sf):
    """All eight counts are asked for, so their sum must be the table's rows."""
    report = partition_report(table(spark, sf, "orders").repartition(8, "o_orderkey"), "after_repartition", sample=8)
    counts = F.col("sample_distribution")
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return report.select("label", F.col("count").cast("bigint").alias("partitions"), F.size(counts).cast("bigint").alias("listed"), total.alias("rows"), (F.array_min(counts) > 0).alias("all_used"))


QUERIES = {
    "regression_metrics": lambda spark, sf: _rounded(
        quality.regression_metrics(_scored(spark, sf), "TotalAmount", "prediction")
    ),
    "regression_metrics_by_group": lambda spark, sf: _rounded(
        quality.regression_metrics(_scored(spark, sf), "TotalAmount", "prediction", ["PaymentMethod"])
    ),
    "model_health": lambda spark, sf: _rounded(
        quality.model_health(
            quality.regression_metrics(_scored(spark, sf), "TotalAmount", "prediction", ["PaymentMethod"]), 40_000
        )
    ),
    "drift_by_month": lambda spark, sf: _rounded(_drift(spark, sf)),
    "drift_alerts": lambda spark, sf: quality.alerts(_drift(spark, sf)).select("month", "alert"),
    "drift_alerts_r2": lambda spark, sf: quality.alerts(_drift(spark, sf, "r2"), worse="lower").select("month", "alert"),
    "quality_report": _quality,
    "partition_counts": lambda spark, sf: partition_counts(table(spark, sf, "orders").repartition(8, "o_orderkey")).agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("partitions")
    ),
    "partition_report": _partition_report,
}

_SCORED = f"""(SELECT *, "TotalAmount" AS y, "Quantity" * "UnitPrice" * (1.0::DOUBLE - "Discount") - "TotalAmount" AS e,
               strftime("OrderDate", '%Y-%m') AS month FROM ({SALES}))"""
_METRICS = """COUNT(*) AS rows, ROUND(sqrt(AVG(e * e)), 6) AS rmse, ROUND(AVG(e * e), 2) AS mse,
              ROUND(AVG(abs(e)), 6) AS mae, ROUND(1 - SUM(e * e) / (VAR_POP(y) * COUNT(*)), 9) AS r2"""
_DRIFT = f"""WITH m AS (SELECT month, COUNT(*) AS rows, sqrt(AVG(e * e)) AS rmse FROM {_SCORED} GROUP BY 1),
  d AS (SELECT *, first_value(rmse) OVER (ORDER BY month) AS baseline, lag(rmse) OVER (ORDER BY month) AS previous FROM m)"""

_RULES = {
    "TotalAmount missing": '"TotalAmount" IS NULL',
    "Quantity missing": '"Quantity" IS NULL',
    "Discount missing": '"Discount" IS NULL',
    "TotalAmount out of range": '"TotalAmount" NOT BETWEEN 0 AND 1e9',
    "Quantity out of range": '"Quantity" NOT BETWEEN 1 AND 1000',
    "Discount out of range": '"Discount" NOT BETWEEN 0 AND 1',
    "OrderDate not date": """try_strptime("OrderDate", '%Y-%m-%d') IS NULL""",
}

ORACLES = {
    "regression_metrics": f"SELECT {_METRICS} FROM {_SCORED}",
    "regression_metrics_by_group": f"""SELECT "PaymentMethod", {_METRICS} FROM {_SCORED} GROUP BY 1""",
    "model_health": f"""SELECT *, CASE WHEN rmse < 40000 THEN 'HEALTHY' ELSE 'DEGRADED' END AS status,
        NOT (rmse < 40000) AS action_required
        FROM (SELECT "PaymentMethod", {_METRICS} FROM {_SCORED} GROUP BY 1)""",
    "drift_by_month": _DRIFT
    + """SELECT month, rows, ROUND(rmse, 6) AS rmse, ROUND(baseline, 6) AS baseline,
         ROUND((rmse - baseline) / baseline, 9) AS change_from_baseline,
         ROUND((rmse - previous) / previous, 9) AS change_from_previous FROM d""",
    "drift_alerts": _DRIFT + "SELECT month, COALESCE((rmse - baseline) / baseline > 0.1, FALSE) AS alert FROM d",
    "drift_alerts_r2": f"""WITH m AS (SELECT month, 1 - SUM(e * e) / (VAR_POP(y) * COUNT(*)) AS r2 FROM {_SCORED} GROUP BY 1),
        d AS (SELECT *, first_value(r2) OVER (ORDER BY month) AS baseline FROM m)
        SELECT month, COALESCE(-(r2 - baseline) / baseline > 0.1, FALSE) AS alert FROM d""",
    "partition_counts": "SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST(8 AS BIGINT) AS partitions FROM orders",
    "partition_report": "SELECT 'after_repartition' AS label, CAST(8 AS BIGINT) AS partitions, CAST(8 AS BIGINT) AS listed, COUNT(*) AS rows, COUNT(*) > 0 AS all_used FROM orders",
    "quality_report": " UNION ALL ".join(
        f"""SELECT '{name}' AS rule, COUNT(*) AS rows, COUNT(*) FILTER ({test}) AS violations,
            CAST(COUNT(*) FILTER ({test}) AS DOUBLE) / COUNT(*) AS share,
            CAST(COUNT(*) FILTER ({test}) AS DOUBLE) / COUNT(*) <= 0.06::DOUBLE AS passed FROM ({RAW})"""
        for name, test in _RULES.items()
    ),
}
