"""Writing, copying and checking tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.staging import staging_folder
from ledgerlight.operators.aggregates import revenue_by, revenue_by_period
from ledgerlight.operators.cleaning import unique_orders
from ledgerlight.operators.quality import model_health, regression_metrics
from ledgerlight.plans.listings import LINES
from ledgerlight.plans.sales import ORACLES as SALES_ORACLES
from ledgerlight.plans.sql import SALES, UNIQUE
from ledgerlight.sources.readers import read_csv, read_lines, read_manifest
from ledgerlight.sources.sales import listing_lines, raw_orders, sales_view, table
from ledgerlight.sources.sinks import (
    SinkLog, layer_path, transfer, write_csv, write_manifest, write_observed, write_parquet, write_records, write_report,
)

_COUNTS = ("expected_rows", "written_rows", "matches")


def _path(spark, layer, name):
    return layer_path(staging_folder(spark), layer, f"{name}-{uuid.uuid4().hex}")


def _verified_parquet(spark, sf):
    df = sales_view(spark, sf)
    return write_observed(df, _path(spark, "silver", "sales")).select(*_COUNTS)


def _verified_csv(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return write_observed(df, _path(spark, "silver", "orders-csv"), write_csv, "csv").select(*_COUNTS)


def _transferred(spark, sf):
    path = _path(spark, "gold", "orders")
    transfer(spark, f"{sf}/orders.parquet", "parquet", path)
    return spark.read.parquet(path)


def _transferred_csv(spark, sf):
    """Texts with blanks, quotes and line breaks, through CSV and back."""
    csv, back = _path(spark, "gold", "documents-csv"), _path(spark, "gold", "documents")
    schema = table(spark, sf, "documents").schema
    transfer(spark, f"{sf}/documents.parquet", "parquet", csv, "csv", multi_line=True)
    transfer(spark, csv, "csv", back, schema=schema, multi_line=True)
    return spark.read.parquet(back).select("doc_id", "text", "lang")


def _transferred_events(spark, sf):
    """Microseconds through CSV and back."""
    csv, back = _path(spark, "gold", "events-csv"), _path(spark, "gold", "events")
    transfer(spark, f"{sf}/events.parquet", "parquet", csv, "csv")
    transfer(spark, csv, "csv", back, schema=table(spark, sf, "events").schema)
    return spark.read.parquet(back)


def _orders_by_name(spark, sf):
    """Raw orders written with another column order and one more column, read by their names."""
    raw, path = raw_orders(spark, sf), _path(spark, "bronze", "orders-csv")
    write_csv(raw.select(F.lit("extra").alias("CustomerName"), *reversed(raw.columns)), path)
    wanted = T.StructType([raw.schema[c] for c in raw.columns])
    return unique_orders(read_csv(spark, path, wanted))


def _lines_read_back(spark, sf):
    """Listing lines written as text files and scanned."""
    path = _path(spark, "bronze", "listings")
    listing_lines(spark, sf).write.text(path)
    return read_lines(spark, path)


def _report_read_back(spark, sf):
    """A report as one CSV file, read by its header."""
    path = _path(spark, "gold", "state-sales")
    report = revenue_by(sales_view(spark, sf, ["State", "TotalAmount"]), "State")
    write_report(report, path)
    return read_csv(spark, path, report.schema)


def _records_read_back(spark, sf):
    """Run metrics as JSON records."""
    path = _path(spark, "logs", "metrics")
    write_records(revenue_by_period(sales_view(spark, sf, ["OrderDate", "TotalAmount"]), period="quarter"), path)
    return spark.read.json(path)


def _manifest(spark, sf):
    """Health of a fixed formula through a run manifest."""
    scored = sales_view(spark, sf, ["Quantity", "UnitPrice", "TotalAmount"]).withColumn("prediction", F.expr("Quantity * UnitPrice"))
    path = _path(spark, "logs", "manifest")
    write_manifest(model_health(regression_metrics(scored, "TotalAmount", "prediction"), 1000.0), path, "run-1", "Formula", "local")
    return read_manifest(spark, path)


def _sink_outcomes(spark, sf):
    """A required write and an optional one that cannot succeed, with the rows that each left."""
    orders, log = table(spark, sf, "orders"), SinkLog()
    good, bad = _path(spark, "gold", "kept"), _path(spark, "gold", "nested")
    log.run("orders", lambda: write_parquet(orders, good))
    log.run("orders_nested", lambda: write_csv(orders.select(F.array("o_orderkey")), bad), required=False)
    kept = spark.read.parquet(good).agg(F.lit("orders").alias("sink"), F.count(F.lit(1)).alias("rows"))
    return log.to_df(spark).join(F.broadcast(kept), "sink", "left").select("sink", "required", "status", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))


QUERIES = {
    "lines_read_back": _lines_read_back, "report_read_back": _report_read_back, "records_read_back": _records_read_back,
    "manifest_read_back": _manifest, "sink_outcomes": _sink_outcomes,
    "transfer_csv": _transferred_csv, "transfer_csv_events": _transferred_events, "csv_orders_by_name": _orders_by_name, "write_verified": _verified_parquet, "write_verified_csv": _verified_csv, "transfer": _transferred,
}

ORACLES = {
    "lines_read_back": LINES + "SELECT value FROM lines",
    "report_read_back": SALES_ORACLES["state_sales"],
    "records_read_back": SALES_ORACLES["quarter_revenue"],
    "manifest_read_back": f"""SELECT 'run-1' AS pipeline_run, 'Formula' AS model_type, 'local' AS deployment_source,
        ROUND(sqrt(AVG(e * e)), 4) AS rmse, ROUND(1 - SUM(e * e) / (VAR_POP(y) * COUNT(*)), 4) AS r2, 'DEGRADED' AS status, TRUE AS action_required
        FROM (SELECT "TotalAmount" AS y, "Quantity" * "UnitPrice" - "TotalAmount" AS e FROM ({SALES}))""",
    "sink_outcomes": """SELECT 'orders' AS sink, TRUE AS required, 'written' AS status, COUNT(*) AS rows FROM orders
        UNION ALL SELECT 'orders_nested', FALSE, 'failed', 0""",
    "transfer_csv": "SELECT doc_id, text, lang FROM documents",
    "transfer_csv_events": "SELECT * FROM events",
    "csv_orders_by_name": UNIQUE,
    "write_verified": "SELECT COUNT(*) AS expected_rows, COUNT(*) AS written_rows, TRUE AS matches FROM lineitem",
    "write_verified_csv": "SELECT COUNT(*) AS expected_rows, COUNT(*) AS written_rows, TRUE AS matches FROM orders",
    "transfer": "SELECT * FROM orders",
}
