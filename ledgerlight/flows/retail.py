"""The demand-forecasting flow on an order file: ingest, analyse, train, optimise, monitor.

Each step takes frames or paths and writes under ``<base>/<layer>/...``; all share the caller's
session, which none of them stops. Steps meet only in the cleaned table (``silver/orders``) and the
saved models (``gold/models``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.columns import categorical_columns, numeric_columns
from ledgerlight.functions.staging import stage, staged
from ledgerlight.operators import aggregates as agg
from ledgerlight.operators import anomalies, drift, joins, models, partitioning, profile, quality, quantiles, sampling
from ledgerlight.operators import series as ts
from ledgerlight.operators.cleaning import OrderRules, clean_orders, cleaning_report
from ledgerlight.sources import readers, schemas, sinks

# The product is kept: the demand features need it.
RULES = OrderRules(drop=("CustomerID",), defaults={"Discount": 0.0, "Tax": 0.0, "ShippingCost": 0.0, "UnitPrice": 0.0})
SUMMARY = ("TotalAmount", "Quantity", "Discount", "ShippingCost")


def ingest(
    spark: SparkSession, raw_path: str, base: str, rules: OrderRules = RULES, log: sinks.SinkLog | None = None
) -> DataFrame:
    """Clean an order CSV into ``silver/orders``, check the copy, and export it as CSV as well.

    Columns are found by the header. Rows that cannot be read go to ``bronze/order_rejects``, and
    ``logs/cleaning_report`` tells what became of the others.
    """
    log = log or sinks.SinkLog()
    with staged():
        read = stage(readers.read_csv(spark, raw_path, schemas.ORDERS, keep_corrupt=True), "raw-orders")
        rejects = read.where(F.col(readers.CORRUPT).isNotNull()).select(F.col(readers.CORRUPT).alias("record"))
        log.run("bronze/order_rejects", lambda: sinks.write_parquet(rejects, sinks.layer_path(base, "bronze", "order_rejects")))
        raw = read.where(F.col(readers.CORRUPT).isNull()).drop(readers.CORRUPT)
        report = cleaning_report(raw, rules).withColumn("rejected_rows", F.lit(rejects.count()))
        log.run("logs/cleaning_report", lambda: sinks.write_records(report, sinks.layer_path(base, "logs", "cleaning_report")))
        clean = clean_orders(raw, rules)
        path = sinks.layer_path(base, "silver", "orders")
        seen: list[bool] = []
        log.run("silver/orders", lambda: seen.append(sinks.write_observed(clean, path).first().matches))
        if seen != [True]:
            raise RuntimeError(f"{path} does not hold the rows that were written")
    stored = readers.read_parquet(spark, path)
    export = sinks.layer_path(base, "silver", "orders_csv")
    log.run("silver/orders_csv", lambda: sinks.write_csv(stored, export), required=False)
    return stored


def reports(orders: DataFrame) -> dict[str, DataFrame]:
    """All reports and chart tables on the cleaned orders."""
    numbers = numeric_columns(orders)
    categories = categorical_columns(orders, exclude=("ProductName", "OrderID", "ProductID"))
    daily = agg.daily_totals(orders)
    return {
        "business_summary": profile.describe_typed(orders, SUMMARY, quartiles=True),
        "category_performance": agg.category_performance(orders),
        "daily_sales": daily.orderBy("date"),
        "monthly_revenue": agg.revenue_by_period(orders, period="month"),
        "quarterly_revenue": agg.revenue_by_period(orders, period="year_quarter"),
        "quarter_summary": agg.revenue_by_period(orders, period="quarter"),
        "outlier_statistics": quantiles.outlier_stats(orders, numbers),
        "skewness_kurtosis": profile.shape_stats(orders, numbers),
        "correlation_matrix": profile.corr_matrix(orders, numbers),
        "top_10_cities": agg.revenue_by(orders, "City", top=10),
        "top_10_products": agg.revenue_by(orders, "ProductName", top=10),
        "state_sales": agg.revenue_by(orders, "State"),
        "payment_methods": agg.value_shares(orders, "PaymentMethod"),
        "category_counts": agg.value_counts(orders, categories),
        "histograms": profile.histogram(orders, numbers),
        "amount_density": profile.density(orders, "TotalAmount"),
        "scatter_sample": sampling.hash_sample(orders.select("OrderID", *numbers), ["OrderID"], 4500),
    }


def analyse(orders: DataFrame, base: str) -> dict[str, DataFrame]:
    """Write every report to ``gold/analysis/<name>``."""
    found = reports(orders)
    for name, report in found.items():
        sinks.write_report(report, sinks.layer_path(base, "gold", f"analysis/{name}"))
    return found


def train(
    orders: DataFrame, base: str, estimators: Mapping[str, Estimator] | None = None
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit and save the models, and rate them and the daily forecast on rows not used to fit."""
    fit, test = sampling.split(models.add_features(orders), ["OrderID"])
    fitted, board = models.train_all(fit, test, models=estimators)
    for name, model in fitted.items():
        sinks.save_model(model, sinks.layer_path(base, "gold", f"models/{name}"))
    forecast = ts.ar_forecast(agg.daily_totals(orders), method="likelihood").filter("status = 'ok'")
    arima = quality.regression_metrics(forecast, "actual", "forecast").filter("rows > 0")
    # Errors per order and per day do not compare: each target is ranked for itself.
    daily = arima.withColumns({"model": F.lit("AR_5_1"), "target": F.lit("daily total")})
    board = board.withColumn("target", F.lit("order")).unionByName(daily).orderBy("target", "rmse", "model")
    sinks.write_report(board, sinks.layer_path(base, "gold", "analysis/model_accuracies"))
    return fitted, board


def optimise(orders: DataFrame, base: str, partition_rows: int = 1_000_000, salts: int = 32, runs: int = 3) -> DataFrame:
    """Measure layout, caching and join forms, write revenue per state and category, log it all.

    Rows are dealt by state and salt into partitions of about ``partition_rows``, and only the
    columns that are used are held. The names of sections and operations are record values.
    """
    orders = orders.select("OrderID", "State", "Category", "TotalAmount")
    spark, log = orders.sparkSession, partitioning.TimingLog(runs)
    partitions = max(1, -(-orders.count() // partition_rows))
    salted = orders.withColumn("_salt", F.pmod(F.xxhash64("OrderID"), F.lit(salts)))
    spread = partitioning.spread(salted, partitions, "State", "_salt").drop("_salt")
    layout = partitioning.partition_report(orders, "before_repartition").unionByName(
        partitioning.partition_report(spread, "after_repartition")
    )
    log.run("Caching", "before", "uncached_count", spread.count)
    held = partitioning.hold(spread)
    try:
        log.run("Caching", "after", "first_cached_count", held.count, once=True)
        log.run("Caching", "after", "cached_count", held.count)
    finally:
        partitioning.release(held)
    with staged():
        states = stage(joins.derive_dimension(orders, "State", Region="Standard"), "states")
        form = "broadcast_join" if joins.fits_broadcast(states, 64 << 20) else "merge_join"
        log.run("Join", "before", "shuffle_join", lambda: joins.join_merge(orders, states, "State", salts=salts).count())
        log.run("Join", "after", form, lambda: joins.join_broadcast(orders, states, "State", salts=salts).count())
    revenue = agg.revenue_by(orders, ["State", "Category"])
    path = sinks.layer_path(base, "gold", "optimized_data")
    log.run("Write", "after", "optimized_csv_write", lambda: sinks.write_report(revenue, path))
    timings = log.to_df(spark)
    skew = partitioning.skew_report(orders, "Category")
    for name, frame in (("timings", timings), ("partitions", layout), ("skew_report", skew)):
        sinks.write_records(frame, sinks.layer_path(base, "logs", f"optimization/{name}"))
    return timings


def watch(orders: DataFrame, keys: tuple[str, ...] = ("State",)) -> dict[str, DataFrame]:
    """Alerts on the data itself: keys with unusual days, and inputs whose distribution moved since the first month."""
    daily = ts.calendar_fill(agg.daily_totals(orders, keys=keys), keys=keys)
    unusual = anomalies.anomaly_alerts(anomalies.flag_anomalies(anomalies.decompose(daily, keys), keys), keys)
    inputs = [c for c in (*SUMMARY, "UnitPrice", "Tax") if c in orders.columns]
    first = orders.agg(F.min("OrderDate").alias("day")).first().day
    begin = F.trunc(F.lit(first).cast("date"), "month")
    edges = drift.baseline_edges(orders.where(F.trunc("OrderDate", "month") == begin), inputs)
    counted = stage(drift.period_histograms(orders, F.trunc("OrderDate", "month"), edges), "input-histograms")
    return {"anomalies": unusual, "input_drift": drift.distribution_drift(counted, F.col("period") == begin, edges)}


def monitor(
    spark: SparkSession, orders: DataFrame, base: str, run: str, model: str = "Gradient_Boosting", max_rmse: float = 1000.0
) -> DataFrame:
    """Load a saved model, score the orders outside its training split, write the manifest and the data alerts."""
    loaded = readers.load_model(sinks.layer_path(base, "gold", f"models/{model}"))
    _, held_out = sampling.split(orders, ["OrderID"])
    metrics = quality.regression_metrics(models.score(loaded, held_out), "TotalAmount", "prediction")
    health = quality.model_health(metrics, max_rmse)
    for name, found in watch(orders).items():
        sinks.write_records(found, sinks.layer_path(base, "logs", f"monitoring/{name}"))
    sinks.write_manifest(health, sinks.layer_path(base, "logs", "manifest"), run, f"Spark_ML_{model}", base)
    return readers.read_manifest(spark, sinks.layer_path(base, "logs", "manifest"))


def run_all(
    spark: SparkSession, raw_path: str, base: str, run: str, estimators: Mapping[str, Estimator] | None = None
) -> DataFrame:
    """All five steps in order; returns the manifest."""
    orders = ingest(spark, raw_path, base)
    with staged():
        return _after(spark, orders, base, run, estimators)


def _after(spark, orders, base, run, estimators) -> DataFrame:
    analyse(orders, base)
    fitted, _ = train(orders, base, estimators)
    optimise(orders, base)
    return monitor(spark, orders, base, run, model=list(fitted)[-1])
