import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from ledgerlight.flows import listings, retail
from ledgerlight.sources import readers, schemas, sinks
from ledgerlight.sources.sales import listing_lines, raw_orders, sales_view


@pytest.fixture(scope="module")
def order_csv(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    raw = raw_orders(spark, sf).withColumns({"CustomerID": F.lit("c"), "ProductID": F.lit("p")})
    path = f"file:{tmp_path_factory.mktemp('raw')}/orders"
    sinks.write_csv(raw.select(*schemas.ORDERS.names), path)
    return path


def test_retail_flow(spark, order_csv, tmp_path):
    base = f"file:{tmp_path}"
    small = dict(featuresCol="scaledFeatures", labelCol="TotalAmount")
    estimators = {"Linear_Regression": LinearRegression(**small), "Gradient_Boosting": GBTRegressor(**small, maxIter=2, seed=1)}
    manifest = retail.run_all(spark, order_csv, base, "run-1", estimators).first()
    assert manifest.model_type == "Spark_ML_Gradient_Boosting" and manifest.status == "DEGRADED" and manifest.action_required

    orders = readers.read_parquet(spark, f"{base}/silver/orders")
    assert orders.filter("TotalAmount < 0 OR Quantity < 1 OR OrderDate IS NULL OR Discount IS NULL").count() == 0
    assert orders.count() == orders.select("OrderID").distinct().count()
    # The exported CSV holds the cleaned rows, not the raw ones.
    assert readers.read_csv(spark, f"{base}/silver/orders_csv").count() == orders.count()

    category = readers.read_csv(spark, f"{base}/gold/analysis/category_performance")
    assert category.agg(F.sum("order_count")).first()[0] == orders.count()
    accuracies = readers.read_csv(spark, f"{base}/gold/analysis/model_accuracies")
    assert {r.model for r in accuracies.collect()} == {*estimators, "AR_5_1"}
    assert spark.read.json(f"{base}/logs/optimization/timings").count() == 6
    assert spark.read.json(f"{base}/logs/optimization/partitions").count() == 2
    states = spark.read.json(f"{base}/logs/monitoring/anomalies")
    assert states.count() == orders.select("State").distinct().count() and "alert" in states.columns
    moved = spark.read.json(f"{base}/logs/monitoring/input_drift")
    months = orders.select(F.trunc("OrderDate", "month")).distinct().count()
    assert moved.count() == months * moved.select("column").distinct().count() and moved.agg(F.sum("rows")).first()[0] % orders.count() == 0
    assert len(list((tmp_path / "gold" / "analysis").iterdir())) == len(retail.reports(orders)) + 1
    assert spark.range(1).count() == 1  # the session is still open


def test_listing_flow(spark, sf, tmp_path):
    lines = spark.createDataFrame([(schemas.LISTINGS_HEADER,)], "value string").union(listing_lines(spark, sf))
    lines.coalesce(1).write.text(f"file:{tmp_path}/raw")
    rows = listings.parse(spark, f"file:{tmp_path}/raw", f"file:{tmp_path}")
    report = spark.read.json(f"file:{tmp_path}/logs/listing_report").first()
    rejects = spark.read.parquet(f"file:{tmp_path}/bronze/listing_rejects").count()
    assert report.rows_out == rows.count() and rejects == report.bad_field_count + report.bad_missing + report.bad_number
    assert report["lines"] == rejects + report.header_lines + report.duplicates + report.rows_out
    found = {name: frame.count() for name, frame in listings.reports(rows).items()}
    assert found["company_salaries"] == rows.count() and found["top_8_locations"] == 8
    assert found["average_by_location"] == found["total_by_location"] == rows.select("Location").distinct().count()


def test_view_columns(spark, sf):
    assert sales_view(spark, sf).columns == schemas.ORDERS.names
